"""MinHash near-duplicates with an LSH forest, and exact links on full shingle sets.

1. Every text becomes its set of distinct word shingles. Texts with equal sets are one class, so copies
   cost nothing further. A class has ``trees`` label sequences of min-hashes.
2. Each tree is a sorted order of label sequences, range-partitioned so that no region lands whole in one
   task. Candidates are the neighbours with the longest common prefix and the first row of the region; a
   crowded region is read at the next depth as well, so depth adapts to density. What meets at a seam of
   two partitions is matched in a small second pass. The number of trees makes the chance of missing a
   pair at the threshold, in every tree, less than one in 100,000.
3. Candidates that agree in too few min-hashes are dropped; the rest connect classes to coarse clusters,
   which hold far less than all pairs: one edge per row and depth at most.
4. A cluster's texts meet once, in blocks of bounded size, and links are decided on full sets. Blocks stop
   as soon as only members of one component are left to compare. The cluster's centre is in every block;
   whatever does not reach it there is compared with all other blocks as well. No partner is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm import spans
from phenoframe.llm.session import arrow_batches, cut, partitions
from phenoframe.operators.components import connect

SHINGLE = 5
DEPTH = 3  # labels that candidates share at least
LABELS = 6  # labels of a tree
MISS = 1e-5
CROWD = 16  # rows of a region above which it is also read one level deeper
SLACK = 0.2  # estimates this far below the threshold are still followed
BLOCK_SHINGLES = 1_000_000
SLOTS = 1 << 20  # shingle counts that order the shingles of wide clusters
SALTS = 64  # places in which a text is compared that many pairs ask for
CHUNK = 1000  # members of a shingle's group that one row is compared with in one place


def tree_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** DEPTH))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row; a row of fewer words is one shingle."""
    raw, off = spans.text_bytes(column)
    for i, j in spans.blocks(off):
        part = spans.LOWER[raw[off[i]: off[j]]]
        start, end, row = spans.spans(part, off[i: j + 1] - off[i], spans.NOT_SPACE)
        words = spans.span_hashes(part, start, end)
        counts = np.bincount(row, minlength=j - i)
        at = np.cumsum(counts) - counts
        first = np.flatnonzero(row[: max(0, len(row) - size + 1)] == row[size - 1:])
        full = spans.run_hashes(words, first, size)
        many = np.maximum(counts - size + 1, 0)
        stop = np.cumsum(many)
        for r in range(j - i):
            if counts[r] >= size:
                yield np.unique(full[stop[r] - many[r]: stop[r]])
            elif counts[r]:
                yield spans.run_hashes(words, at[r: r + 1], int(counts[r]))
            else:
                yield np.zeros(0, np.uint64)


class Sketch:
    """Min-hashes of a set as 16-bit labels."""

    def __init__(self, count: int):
        draw = np.random.default_rng(20240229)
        self.flip = draw.integers(0, 1 << 32, count, dtype=np.uint32)
        self.scale = draw.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)

    def __call__(self, members: np.ndarray) -> np.ndarray:
        short = (members >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), 8192):
            value = short[at: at + 8192, None] ^ self.flip
            value *= self.scale
            np.minimum(least, value.min(axis=0), out=least)
        least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return ((least ^ (least >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(16)).astype(np.uint16)


def sketches(docs: DataFrame, doc_id: str, text: str, percent: int, size: int = SHINGLE) -> DataFrame:
    """(doc, n_shingles, digest, labels, low): digest of the whole set, labels of all trees, their low bytes."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    trees = tree_count(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(trees * LABELS)
        for batch in batches:
            n, digest, labels, low = [], [], [], []
            for members in shingle_sets(batch.column(1), size):
                row = sketch(members)
                n.append(len(members))
                digest.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                labels.append(row.astype(">u2").tobytes())
                low.append(row.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, labels, low))],
                ["doc", "n_shingles", "digest", "labels", "low"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(
        spans.tidy(run), f"doc {kind}, n_shingles long, digest binary, labels binary, low binary")


def _neighbours(agree: float):
    """Candidate pairs (a, b) of sorted rows (tree, label, doc, low), and the rows that stand at the seams."""

    def scan(tree, label, low):
        n = len(tree)
        same = np.zeros((n, LABELS), bool)
        same[1:] = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
        common = np.cumprod(same, axis=1).sum(axis=1)
        index = np.arange(n)
        left, right = [np.flatnonzero(common >= DEPTH) - 1], [np.flatnonzero(common >= DEPTH)]
        crowded, heads = np.ones(n, bool), []
        for depth in range(DEPTH, LABELS + 1):
            head = np.maximum.accumulate(np.where(common < depth, index, 0))
            heads.append(head[-1])
            use = np.flatnonzero(crowded & (head != index))
            left.append(head[use])
            right.append(use)
            crowded &= np.bincount(head, minlength=n)[head] > CROWD
        a, b = np.concatenate(left), np.concatenate(right)
        a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
        near = (low[a] == low[b]).mean(axis=1) >= agree if len(a) else np.zeros(0, bool)
        return a[near], b[near], np.unique([*heads, n - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, opening, schema = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            opening = opening if opening is not None else pa.table(batch.slice(0, 1).columns, names=schema.names)
            rows = pa.table(batch.columns, names=schema.names)
            if carry is not None:
                rows = pa.concat_tables([carry, rows])
            rows = rows.combine_chunks()
            n = rows.num_rows
            fixed = lambda name: np.frombuffer(b"".join(rows.column(name).to_pylist()), np.uint8).reshape(n, -1)
            label = fixed("label").copy().view(">u2")
            a, b, kept = scan(rows.column("tree").to_numpy(), label, fixed("low"))
            doc = rows.column("doc").combine_chunks()
            empty = lambda name: pa.nulls(len(a), schema.field(name).type)
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(a)), doc.take(pa.array(b)), empty("tree"), empty("label"), empty("doc"), empty("low")],
                ["a", "b", *schema.names])
            carry = rows.take(pa.array(kept))
        if carry is not None:
            seam = pa.concat_tables([opening, carry]).combine_chunks()
            none = pa.nulls(seam.num_rows, schema.field("doc").type)
            yield pa.RecordBatch.from_arrays(
                [none, none, *(seam.column(x).combine_chunks() for x in schema.names)], ["a", "b", *schema.names])

    return run


def forest_edges(classes: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate edges (a, b) between classes (rep, labels, low)."""
    trees = tree_count(percent)
    width = 2 * LABELS
    entry = classes.select("rep", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring("labels", t * width + 1, F.lit(2 * DEPTH))).alias("region")),
    )).alias("e")).select("rep", "e.tree", "e.region")
    shared = entry.groupBy("tree", "region").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    meets = entry.join(shared, ["tree", "region"]).groupBy("rep").agg(F.collect_list("tree").alias("trees"))
    rows = classes.join(meets, "rep").select("low", F.col("rep").alias("doc"), F.explode("trees").alias("tree"), "labels")
    rows = rows.select("tree", F.substring("labels", F.col("tree") * width + 1, F.lit(width)).alias("label"), "doc", "low")
    kind = classes.schema["rep"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, tree int, label binary, doc {kind}, low binary"
    order = ["tree", "label", "doc"]
    ordered = rows.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)
    agree = percent / 100 - SLACK
    found = cut(ordered.mapInArrow(spans.tidy(_neighbours(agree)), schema), "forest")
    # A handful of rows for each partition.
    seams = found.where("doc is not null").select("tree", "label", "doc", "low").coalesce(1).sortWithinPartitions(*order)
    across = seams.mapInArrow(spans.tidy(_neighbours(agree)), schema)
    return found.select("a", "b").unionByName(across.select("a", "b")).where("a <> b").distinct()


def _linked(shared: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (size + sizes - shared)


class _SetIndex:
    """Counts what one set shares with each of many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.vocabulary, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(self.vocabulary), np.int32)

    def shared(self, members: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.vocabulary, members)
        place = place[place < len(self.vocabulary)] if len(members) and place[-1] == len(self.vocabulary) else place
        place = place[self.vocabulary[place] == members[: len(place)]]
        self.flag[place] = 1
        counts = np.add.reduceat(self.flag[self.codes], self.first)
        self.flag[place] = 0
        return counts


def local_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component of every set (its first member's index), exactly.

    Every link has an end outside the largest component, so sets are compared with all others
    until none outside it is left.
    """
    n = len(sets)
    label = np.arange(n)
    if n == 1:
        return label
    index, asked, at = _SetIndex(sets), np.zeros(n, bool), 0
    while True:
        asked[at] = True
        hit = _linked(index.shared(sets[at]), len(sets[at]), index.sizes, percent)
        hit[at] = True
        joined = np.isin(label, np.unique(label[hit]))
        label[joined] = np.flatnonzero(joined)[0]
        largest = np.bincount(label).argmax()
        rest = np.flatnonzero(~asked & (label != largest))
        if not len(rest):
            return label
        at = int(rest[0])


def _verify(percent: int, size: int):
    """Labels inside each (cluster, block): the smallest member reached, and whether it is the centre's."""

    def run(part):
        part = part.combine_chunks().sort_by([("cluster", "ascending"), ("block", "ascending"), ("doc", "ascending")])
        sets = list(shingle_sets(part.column("text"), size))
        key = np.stack([part.column("cluster_no").to_numpy(), part.column("block").to_numpy()])
        fence = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, part.num_rows]
        label = np.zeros(part.num_rows, np.int64)
        for i, j in zip(fence[:-1], fence[1:]):
            if j > i:
                label[i:j] = i + local_components(sets[i:j], percent)
        doc = part.column("doc").combine_chunks()
        first = doc.take(pa.array(label))
        centre = part.column("cluster").combine_chunks()
        settled = pa.array(np.array(first.to_pylist(), object) == np.array(centre.to_pylist(), object))
        del sets
        spans.release()
        return pa.table({"doc": doc, "label": first, "cluster": centre, "block": part.column("block"), "blocks": part.column("blocks"), "settled": settled})

    return run


def _slots(size: int):
    """How often each slot of the shingle table is hit, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for members in shingle_sets(batch.column(0), size):
                np.add.at(total, (members & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    return run


def prefix_of(members: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Places of a set's first shingles in the order of (rank, hash), and how many of them are index places.

    Two linked sets share one of the larger one's first shingles among the smaller one's index places.
    """
    n = len(members)
    order = np.lexsort((members, rank[(members & np.uint64(SLOTS - 1)).astype(np.int64)]))
    probe = n - -(-percent * n // 100) + 1
    return order[:probe], n - -(-2 * percent * n // (100 + percent)) + 1


def _prefixes(percent: int, size: int, rank: np.ndarray):
    """Rows (token, n, place, indexed) of every text's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, token, n, place, indexed = [], [], [], [], []
            for i, members in enumerate(shingle_sets(batch.column(batch.num_columns - 1), size)):
                first, many = prefix_of(members, rank, percent) if len(members) else (np.zeros(0, np.int64), 0)
                row.append(np.full(len(first), i))
                token.append(members[first].view(np.int64))
                n.append(np.full(len(first), len(members)))
                place.append(np.arange(len(first)))
                indexed.append(np.arange(len(first)) < many)
            if not row:
                continue
            at = pa.array(np.concatenate(row), pa.int64())
            own = [c.take(at) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*own, *(pa.array(np.concatenate(x), t) for x, t in ((token, pa.int64()), (n, pa.int64()), (place, pa.int64()), (indexed, pa.bool_())))],
                [*batch.schema.names[:-1], "token", "n", "place", "indexed"])

    return run


def _linked_pairs(percent: int, size: int):
    """The pairs (a, b) of rows (a, b, text_a, text_b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [
                bool(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
                for x, y in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size))]
            keep = pa.array(np.flatnonzero(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def _checked(docs: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """Candidate pairs (a, b) that are linked. A text that many pairs ask for is read in up to SALTS places."""
    kind = pairs.schema["a"].dataType.simpleString()
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    rows = cut(pairs.where("a <> b").distinct(), "pairs").withColumns({"salt_a": salt("b"), "salt_b": salt("a")})
    for side in ("a", "b"):
        asked = rows.select(side, f"salt_{side}").distinct()
        texts = docs.select(F.col("doc").alias(side), F.col("text").alias(f"text_{side}"))
        rows = rows.join(asked.join(texts, side), [side, f"salt_{side}"])
    linked = rows.select("a", "b", "text_a", "text_b").mapInArrow(spans.tidy(_linked_pairs(percent, size)), f"a {kind}, b {kind}")
    return cut(linked.distinct(), "links")


def wide_links(docs: DataFrame, wide: DataFrame, percent: int, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) between members of a cluster that stand in different blocks and are not both settled.

    ``docs``: doc, text; ``wide``: doc, label (inside the block), cluster, settled. Members meet by the rarest
    shingles of their sets; the order of shingles is by counts in a table of slots, and any order is exact. In a
    group with one shingle all unsettled members are compared with its first ones; only what is then still in
    different components is compared by pairs, in chunks.
    """
    texts = docs.select("doc", "text").join(wide.select("doc").distinct(), "doc")
    counted = texts.select("text").mapInArrow(spans.tidy(_slots(size)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # Counts in steps of an eighth of a power of two, one byte a slot.
    rank = np.zeros(SLOTS, np.uint8)
    for r in counted.select("slot", F.least(F.floor(8 * F.log2("n")), F.lit(255)).cast("int").alias("step")).toLocalIterator():
        rank[r.slot] = r.step
    kind = wide.schema["doc"].dataType.simpleString()
    entry = docs.select("doc", "text").join(wide.select("doc", "label", "cluster", "settled").distinct(), "doc").select(
        "doc", "label", "cluster", "settled", F.xxhash64("cluster").alias("cluster_no"), "text").mapInArrow(
        spans.tidy(_prefixes(percent, size, rank)),
        f"doc {kind}, label {kind}, cluster {kind}, settled boolean, cluster_no long, token long, n long, place long, indexed boolean")
    entry = cut(entry, "prefixes")
    key = ["cluster_no", "token"]
    groups = cut(entry.groupBy(*key).agg(
        F.count("*").alias("many"), F.min(F.when(F.col("settled"), F.col("doc"))).alias("near"),
        F.min(F.when(~F.col("settled"), F.col("doc"))).alias("far")).where("many > 1 and far is not null"), "groups")
    met = cut(entry.join(groups, key), "met")
    star = met.where(f"many > {CROWD} and not settled").select(F.col("doc").alias("a"), F.explode(F.array("near", "far")).alias("b")).where("b is not null")
    stars = _checked(docs, star, percent, size)
    inside = wide.select(F.col("doc").alias("a"), F.col("label").alias("b"))
    joined = connect(inside.unionByName(stars), []).select(F.col("id").alias("doc"), F.col("label").alias("component"))
    centre = joined.select(F.col("doc").alias("cluster"), F.col("component").alias("home"))
    left = met.join(joined, "doc", "left").join(centre, "cluster", "left").select(
        *key, "doc", "n", "place", "indexed", "many", F.coalesce("component", "doc").alias("component"),
        F.coalesce("home", "cluster").alias("home")).withColumn("at_home", F.col("component") == F.col("home"))
    # Of a group whose members are in one component nothing is left to compare.
    mixed = left.groupBy(*key).agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(*key)
    left = cut(left.join(mixed, key), "left")
    chunks = F.ceil(F.col("many") / CHUNK).cast("int")
    own = left.where("indexed").select(
        *key, F.pmod(F.xxhash64("doc"), chunks).cast("int").alias("chunk"), F.col("doc").alias("b"), F.col("n").alias("n_b"),
        F.col("place").alias("place_b"), F.col("component").alias("to"), F.col("at_home").alias("home_b"))
    asking = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(
        *key, "chunk", F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), "component", "at_home")
    # What the two sets can still share after this place has to reach what a link needs.
    bound = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = asking.join(own, [*key, "chunk"]).where(
        (F.col("n_b") <= F.col("n_a")) & (F.col("component") != F.col("to")) & ~(F.col("at_home") & F.col("home_b"))
        & (100 * F.col("n_b") >= percent * F.col("n_a"))
        & ((100 + percent) * bound >= percent * (F.col("n_a") + F.col("n_b")))).select("a", "b")
    return stars.unionByName(_checked(docs, pairs, percent, size))


def verified_labels(
    docs: DataFrame, members: DataFrame, percent: int, size: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(doc, label) for coarse clusters. ``docs``: doc, text; ``members``: doc, cluster, n_shingles."""
    kind = members.schema["doc"].dataType.simpleString()
    sizes = cut(members.groupBy("cluster").agg(F.sum("n_shingles").alias("total")), "sizes")
    total = sizes.agg(F.sum("total")).first()[0] or 0
    buckets = max(1, 2 * total // block_shingles)
    placed = members.drop("n_shingles").join(sizes, "cluster").select(
        "doc", "cluster", F.ceil(F.col("total") / block_shingles).cast("int").alias("blocks")
    ).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    texts = docs.select("doc", "text").join(placed, "doc").select("*", F.xxhash64("cluster").alias("cluster_no"))
    everywhere = F.when(F.col("doc") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    bucket = F.pmod(F.xxhash64("cluster", "block"), F.lit(buckets)).alias("bucket")
    dealt = texts.withColumn("block", F.explode(everywhere)).select("*", bucket)
    schema = f"doc {kind}, label {kind}, cluster {kind}, block int, blocks int, settled boolean"
    local = cut(dealt.groupBy("bucket").applyInArrow(_verify(percent, size), schema), "local")
    whole = local.where("blocks = 1").select("doc", "label")
    wide = local.where("blocks > 1")
    if wide.isEmpty():
        return whole
    edges = wide.select(F.col("doc").alias("a"), F.col("label").alias("b"))
    # The block that owns a centre is the one it hashes to; elsewhere it is only a reference.
    owned = wide.where((F.col("doc") != F.col("cluster")) | (F.col("block") == F.pmod(F.xxhash64("doc"), F.col("blocks"))))
    if not owned.where("not settled").isEmpty():
        edges = edges.unionByName(wide_links(docs, owned, percent, size))
    joined = connect(edges, []).select(F.col("id").alias("doc"), "label")
    alone = wide.select("doc").distinct().join(joined, "doc", "left").select("doc", F.coalesce("label", "doc").alias("label"))
    return whole.unionByName(alone)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, size: int = SHINGLE,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document row: ``doc``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked if their sets share at least ``percent`` of their union; ``component_id`` is the
    smallest id reachable over links. Nulls and texts without words have no shingles and are linked with
    nothing. Repeated rows share a component. Rows without an id are kept and linked with nothing.
    """
    base = cut(sketches(docs, doc_id, text, percent, size), "sketches")
    classes = cut(
        base.where("n_shingles > 0 and doc is not null").groupBy("digest").agg(
            F.min("doc").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"), F.first("low").alias("low")),
        "classes")
    coarse = connect(forest_edges(classes, percent), [])
    members = cut(
        coarse.join(classes.select(F.col("rep").alias("id"), "n_shingles"), "id")
        .select(F.col("id").alias("doc"), F.col("label").alias("cluster"), "n_shingles"), "members")
    plain = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    labels = verified_labels(plain, members, percent, size, block_shingles)
    named = cut(
        classes.select("digest", "rep").join(labels.select(F.col("doc").alias("rep"), "label").distinct(), "rep", "left")
        .select("digest", F.coalesce("label", "rep").alias("component")), "named")
    out = base.select("doc", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)))
