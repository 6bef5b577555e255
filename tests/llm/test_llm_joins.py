"""Jaccard join, hard negatives and the conversation trie against brute force, with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoframe.llm import jaccardjoin, negatives, trie

ASCII_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, doc string, n long, mark string, cluster int"


# Jaccard join -------------------------------------------------------------------------------------------------

def shingles(text, size=3):
    ws = WORD.findall((text or "").translate(ASCII_LOWER))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)])


def components(rows, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(text))
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[k + 1:]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                low[y] = x
    return {i: find(i) for i in sets}, {i: sorted(len(s) for s in many) for i, many in sets.items()}


def near_rows(seed=3):
    draw = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one"), (7, "Öl naïve 日本 don't"), (7, "Öl naïve 日本 don't")]
    for base in range(6):
        words = [f"w{draw.randrange(60)}" for _ in range(draw.randrange(30, 200))]
        for _ in range(25):
            copy = list(words)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(1000)}"
            rows.append((len(rows) + 10, " ".join(copy[: len(copy) - draw.randrange(3)])))
    rows += [(900 + k, rows[20][1]) for k in range(30)]
    rows.append((990, " ".join(f"w{draw.randrange(300)}" for _ in range(20000))))
    rows.append((991, rows[-1][1] + " end"))
    return rows


def joined(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1, "m", 2) for i, t in rows], DOCS).repartition(3)
    return jaccardjoin.jaccard_join(docs, **options).collect()


@pytest.mark.parametrize("block", [1_000_000, 3000])
def test_jaccard_join_equals_brute_force(spark, block):
    rows = near_rows()
    component, sizes = components(rows, 90)
    got = joined(spark, rows, block_shingles=block)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == component[r.doc] and r.n_shingles in sizes[r.doc]


def test_jaccard_join_of_awkward_tables(spark):
    assert joined(spark, []) == []
    got = joined(spark, [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (2, None)])
    assert sorted((r.doc is None, r.doc, r.n_shingles, r.component_id) for r in got if r.doc is not None) == [(False, 2, 0, 2), (False, 3, 2, 3)]
    assert [r.component_id for r in got if r.doc is None] == [None, None]


def test_long_lists_keep_candidates_connected(spark):
    # Forty texts share their rarest shingles; every link must lie inside one connected set of groups.
    words = [f"c{k}" for k in range(100)]
    rows = [(k, " ".join(words[: 100 - k % 9])) for k in range(40)]
    component, _ = components(rows, 90)
    assert {r.doc: r.component_id for r in joined(spark, rows)} == component


def test_prefix_sizes_lose_no_pair():
    for n in range(1, 120):
        for m in range(1, n + 1):
            need = math.ceil(90 * (n + m) / 190)
            if need <= m:
                ask, found = jaccardjoin.prefix_sizes(n, 90)[0], jaccardjoin.prefix_sizes(m, 90)[1]
                # Sets with the least overlap that links them, its shingles last in both.
                assert n - need < ask and m - need < found


# Hard negatives -----------------------------------------------------------------------------------------------

def mined(rows, step=100, scale=256, keep=5, share=80):
    """Brute force over (vec_id, vector, label)."""
    good = {(i, l, tuple(math.floor(scale * x) for x in v)) for i, v, l in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, l, q in good:
        if i % step:
            continue
        score = [(-dot(q, w), j, m) for j, m, w in good if j != i]
        for s, j, _ in sorted({x for x in score if x[2] == l})[:keep]:
            fit = sorted({(t, k) for t, k, m in score if m != l and share * -s <= 100 * -t <= 100 * -s})[:keep]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


def vectors(spark, rows):
    frame = spark.createDataFrame([(i, v, l, "x", 7, 8) for i, v, l in rows], "vec_id long, embedding array<float>, label int, id string, q int, window int")
    return frame.repartition(3)


def results(spark, rows, step=100, **options):
    got = negatives.mine(vectors(spark, rows), F.col("vec_id") % step == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_scores_are_inner_products():
    draw = np.random.default_rng(4)
    for low, high in ((-300, 300), (0, 2), (-1, 0), (-(1 << 20), 1 << 20)):
        a, b = draw.integers(low, high, (7, 24)), draw.integers(low, high, (33, 24))
        assert (negatives.scores(negatives.bit_planes(b), negatives.subset_tables(a)) == b @ a.T).all()
    wide, narrow = draw.integers(-9, 9, (3, 32)), draw.integers(-9, 9, (5, 16))
    assert (negatives.scores(negatives.bit_planes(narrow), negatives.subset_tables(wide)) == narrow @ wide[:, :16].T).all()


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "DEAL", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 9)
    draw = np.random.default_rng(9)
    rows = []
    for i in range(500):
        v = (draw.normal(size=16) * 0.2 + 0.3 * (i % 3 == 0)).astype(np.float32)
        rows.append((i, [float(x) for x in (np.round(v, 1) if i % 2 else v)], int(i % 4 if i % 5 else 0)))
    rows += [(1000 + k, rows[3][1], 1) for k in range(40)]  # copies: ties by id
    rows += [rows[10], rows[20], rows[20]]
    rows += [(None, rows[1][1], 1), (2001, None, 1), (2002, rows[1][1], None), (2003, [0.1, None], 1), (2004, [float("nan")] * 16, 1),
             (2010, [float("inf")] * 16, 1), (2020, [], 2), (2030, [0.5] * 9, 2)]
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]
    assert results(spark, rows, 10) == mined(exact, 10)


def test_hard_negatives_of_awkward_tables(spark):
    assert results(spark, []) == []
    assert results(spark, [(100, [1.0, 0.0], 1)]) == []
    assert results(spark, [(100, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.45, 0.0], 2)]) == [(100, 1, 1, 2, 32768, 29440)]
    assert results(spark, [(100, [1.0], 1), (1, [-0.5], 1), (2, [-0.45], 2)]) == []
    with pytest.raises(Exception, match="scaled components"):
        results(spark, [(100, [1e30], 1), (1, [0.5], 1)])


# Trie ---------------------------------------------------------------------------------------------------------

def sig(role, text):
    body = (role or "").encode() + (text or "").encode()
    return hashlib.sha256(f"{len((role or '').encode())}:".encode() + body).hexdigest()


def nodes_of(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), sig(role, text), (role or "", text or "")))
    convs = {c: [x[2] for x in sorted(v, key=lambda z: z[:2])] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    nodes, kids, leaves, saved = collections.defaultdict(list), collections.defaultdict(list), {}, {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(nodes, key=len, reverse=True):
        saved[n] = ((len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0) + sum(saved[k] for k in kids[n])
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
    out = []
    for n, m in nodes.items():
        ends = sorted(c for c in m if len(rebuilt[c]) == len(n))
        out.append((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, conv string, place int")
    return sorted(map(tuple, trie.conversation_trie(frame.repartition(3)).collect()), key=repr)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    monkeypatch.setattr(trie, "CHUNK", 3)
    draw = random.Random(8)
    rows = []
    for c in [*range(60), -7, -5, 203, 2**40]:
        for t in range(draw.randrange(1, 14)):
            text = draw.choice(["", "ja", "né", "go", None, "日本"]) if t else "start"
            rows.append((c, t if draw.random() < 0.9 else None, draw.choice(["user", "user", None]), text))
    rows += [(300, t, "user", f"t{t % 3}") for t in range(100)]  # one long conversation
    rows += [(1000 + 5 * k, t, "u", "same") for k in range(40) for t in range(9)]  # many equal ones
    rows += [(7, 3, "user", "go"), (7, 3, "user", "go"), (None, 1, "user", "lost"), (302, None, None, None)]
    assert trie_of(spark, rows) == nodes_of(rows)


def test_trie_of_awkward_tables(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "u", "x")]) == []
    # A conversation whose own turns all fall to an absent one is a member of the root alone.
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    assert trie_of(spark, [(lone, 0, "u", "x")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
