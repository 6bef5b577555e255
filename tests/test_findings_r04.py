"""Scenes of the fourth review: each failed before its finding was settled."""

import hashlib
import random
from math import ceil, sqrt

import numpy as np
import pyarrow as pa

from phenoframe.llm import substrings
from phenoframe.operators import mainaxis, ordered, runs


def strokes(seed, count):
    """Slanted strokes on a crowded image, all hanging from two places outside; some lie on others."""
    rng, rows = random.Random(seed), []
    for seg in range(count):
        x, y, lean, high = (*rows[-1][2:4], rng.randint(-5, 5), rng.randint(6, 18)) if seg % 6 == 5 else (
            rng.randint(0, 40), rng.randint(0, 50), rng.randint(-5, 5), rng.randint(6, 18))
        rows.append((seg, -1 - seg % 2, x, y, [(x + (2 * lean * k + high) // (2 * high), y + k) for k in range(high + 1)]))
    return rows


def joined(rows):
    """(arrival, tip) pairs that are each other's single nearest, and how many pairs lie near enough, by trying all."""
    def arm(line, d):
        arc = 0.0
        for a, b in zip(line, line[1:]):
            arc += sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)
            if arc >= d:
                return b[0] - line[0][0], b[1] - line[0][1]
        return line[-1][0] - line[0][0], line[-1][1] - line[0][1]

    def length(line):
        return sum(sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) for a, b in zip(line, line[1:]))

    near, fit = 0, []
    for kid, place, _, _, down in rows:
        for tip, other, _, _, line in rows:
            gx, gy = down[0][0] - line[-1][0], down[0][1] - line[-1][1]
            d = sqrt(gx * gx + gy * gy)
            if kid == tip or place != other or gy <= 0 or d > max(length(down), length(line)):
                continue
            near += 1
            up = arm(line[::-1], d)
            if all(gx * dx + gy * dy > abs(gx * dy - gy * dx) for dx, dy in (arm(down, d), (-up[0], -up[1]))):
                fit.append((kid, tip, d))
    def nearest(side):
        out = {}
        for pair in fit:
            out.setdefault(pair[side], []).append((pair[2], pair[1 - side]))
        return {k: [o for d, o in v if d == min(v)[0]] for k, v in out.items()}
    tips, kids = nearest(0), nearest(1)
    return near, {(k, t[0]) for k, t in tips.items() if len(t) == 1 and kids[t[0]] == [k]}


def test_crowded_gaps_are_found_by_the_nearest_ends(spark, monkeypatch):
    rows = strokes(3, 240)
    near, want = joined(rows)
    nodes = spark.createDataFrame(
        [(0, s, p, x, y, *line[-1], None) for s, p, x, y, line in rows],
        "img int, seg long, parent long, upper_x int, upper_y int, lower_x int, lower_y int, upper_junction long")
    points = spark.createDataFrame([(0, s, i, *at) for s, _, _, _, line in rows for i, at in enumerate(line)], "img int, seg long, pos int, x int, y int")
    measured, arm = [], mainaxis._arm
    monkeypatch.setattr(mainaxis, "_arm", lambda ends, *rest: measured.append(ends.count()) or arm(ends, *rest))
    got = mainaxis.forward_gaps(nodes, points, ["img"]).collect()
    assert want and {(r.seg, r.parent) for r in got} == want
    assert sum(measured[::2]) < near / 2


def visible(lines, masked):
    """(line, piece, index, step, x, y) of every sample that is not masked."""
    out = []
    for name, line in lines.items():
        samples = []
        for i, (x, y) in enumerate(line):
            nx, ny = line[min(i + 1, len(line) - 1)]
            n = max(1, ceil(max(abs(nx - x), abs(ny - y))))
            samples += [(i, k, x + (nx - x) * (k / n), y + (ny - y) * (k / n)) for k in range(n)]
        hidden = [(name, round(x), round(y)) in masked for _, _, x, y in samples]
        if not any(hidden):
            out += [(name, 1, i, 0, float(x), float(y)) for i, (x, y) in enumerate(line)]
            continue
        piece, was = 0, True
        for row, now in zip(samples, hidden):
            piece += was and not now
            was = now
            if not now:
                out.append((name, piece, *row))
    return sorted(out)


def test_visible_runs_of_many_samples(spark):
    rng = random.Random(4)
    lines = {k: [(rng.randint(-40, 40) / 2, rng.randint(-60, 60) / 2) for _ in range(rng.randint(1, 9))] for k in range(30)}
    samples = {k: visible({k: line}, set()) for k, line in lines.items()}
    masked = {(k, round(r[4]), round(r[5])) for k in lines if k % 5 for r in samples[k] if rng.random() < 0.5}
    masked |= {(k, rng.randint(-20, 20), rng.randint(-30, 30)) for k in lines if k % 5 for _ in range(300)}
    points = spark.createDataFrame([(k, i, *at) for k, line in lines.items() for i, at in enumerate(line)], "k int, pos long, x double, y double")
    mask = spark.createDataFrame(sorted(masked), "k int, x int, y int")
    got = runs.visible_runs(points, mask, ["k"], "pos", ["k"]).select("k", "piece", "pos", "step", "x", "y").collect()
    assert sorted(map(tuple, got)) == visible(lines, masked)


def test_samples_of_visible_runs_are_not_written(spark, monkeypatch):
    written, cut = [], ordered.cut

    def counted(df, label="step"):
        out = cut(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(ordered, "cut", counted)
    monkeypatch.setattr(runs, "cut", counted, raising=False)
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 5000.0), (1, 2, 6.0, 2.0)], "k int, pos long, x double, y double")
    mask = spark.createDataFrame([(1, 3, 5000), (1, 1, 1200)], "k int, x int, y int")
    pieces = runs.visible_runs(points, mask, ["k"], "pos", ["k"]).groupBy("piece").count().collect()
    assert sorted(map(tuple, pieces)) == [(1, 1200), (2, 3799), (3, 4998)]
    assert max(written) < 20


def kept(rows, length):
    """(document, bytes removed, digest of the rest) by looking at every window of every text."""
    least = {}
    for doc, text in rows:
        for k in range(len(text) - length + 1):
            least[text[k: k + length]] = min(least.get(text[k: k + length], doc), doc)
    out = []
    for doc, text in rows:
        gone = set()
        for k in range(len(text) - length + 1):
            if least[text[k: k + length]] < doc:
                gone |= set(range(k, k + length))
        rest = bytes(b for k, b in enumerate(text) if k not in gone)
        out.append((doc, len(text) - len(rest), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def test_copies_of_whole_texts_take_no_part(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=rng.choice([0, 20, 49, 50, 51, 200, 900]))) for _ in range(40)]
    texts += [t[:300] + "x" + t[200:] for t in texts if len(t) == 900]
    rows = [(i + 100 * k, t) for k in range(6) for i, t in enumerate(texts)]
    rows += [(7, texts[-1]), (7, texts[-1]), (-5, texts[-2][:150])]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(frame).collect()
    assert sorted((r.doc, r.n_removed, r.kept_sha256) for r in got) == kept([(d, t.encode()) for d, t in rows], 50)
    assert all(bytes(r.kept) == b"" and len(r.spans) == 1 for r in got if r.doc >= 100 and r.n_bytes >= 50)
    least = {t: min(d for d, u in rows if u == t) for _, t in rows}
    digests = [(hashlib.sha256(t.encode()).digest(), d, max(e for e, u in rows if u == t)) for t, d in least.items()]
    table = substrings.first_documents(spark.createDataFrame(digests, "digest binary, first long, last long"))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc", "text"])
    worked = set(zip(*substrings._only(batch, table).to_pydict().values()))
    assert worked >= {(d, t) for t, d in least.items()} and len(worked) <= len(least) + 2


def test_equal_stretches_of_a_bucket_are_sorted_once(monkeypatch):
    text = bytes(range(97, 123)) * 3 + b"!!"
    rows = [
        (3, pa.compress(text, "zstd", asbytes=True), np.array([80], "<u4").tobytes(), substrings._planes(np.array([doc])), np.array([5 * doc], "<u8").tobytes(), b"\1", None, None)
        for doc in range(20)]
    part = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), substrings.SENT.types)], schema=substrings.SENT)
    asked, sort = [], substrings.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", lambda raw, start, *rest: asked.append(len(start)) or sort(raw, start, *rest))
    found = substrings._sort_bucket(50)((pa.scalar(3),), part)
    spans = {d: np.frombuffer(s, "<i8").tolist() for d, s in zip(found.column("doc").to_pylist(), found.column("spans").to_pylist())}
    assert spans == {doc: [5 * doc, 5 * doc + 80] for doc in range(1, 20)}
    assert asked == [31]
