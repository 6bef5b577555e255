"""N-gram Jaccard join by grouped prefixes: which documents share at least a given part of their word n-grams.

1. Shingles are ordered by rarity: counts over all documents in a table of fixed size, then the hash. Any order
   gives the same result; rare ones first keep the lists short.
2. Two linked sets share one of the larger one's first shingles among the smaller one's index places. Documents
   with the same size and the same first shingles collapse into one group, so only groups take part in the join.
3. Groups meet by shingle. Pairs from short lists must pass the length and the position bound. A long list is
   sorted by size and only neighbours within the length bound are paired: between two groups that could link, all
   neighbours pass it, so the pairs still connect them, and no list gives more pairs than it has rows.
4. Connected groups expand to their members (texts with equal sets are one), and members are verified on full sets,
   in blocks of bounded size and between blocks by the exact join of ``neardup.verified_labels``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm import spans
from phenoframe.llm.neardup import BLOCK_SHINGLES, shingle_sets, verified_labels
from phenoframe.llm.session import arrow_batches, cut, partitions
from phenoframe.operators.components import connect
from phenoframe.operators.ordered import ordered_columns

SHINGLE = 3
SLOT_BITS = 22
PART_BITS = 14  # slots of one row of counts
SHORT = 16  # groups of a list that are paired one by one


def _slot(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _counts(size: int):
    """A task's counts of all slots, as rows (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            for members in shingle_sets(batch.column(0), size):
                slot, n = np.unique(_slot(members), return_counts=True)
                total[slot] += n.astype(np.int32)
        for k, part in enumerate(total.reshape(-1, 1 << PART_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])

    return run


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the parts that a task holds, in steps of an eighth of a power of two."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            total.setdefault(part, np.zeros(1 << PART_BITS, np.int64))
            total[part] += np.frombuffer(counts.as_buffer(), np.int32)
    for part, n in total.items():
        step = np.minimum(8 * np.log2(np.maximum(n, 1)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([step.tobytes()], pa.binary())], ["part", "steps"])


def rarity(docs: DataFrame, text: str, size: int = SHINGLE) -> np.ndarray:
    """One byte for each slot: how often its shingles occur in all documents. 4 MB, whatever the corpus."""
    arrow_batches(docs.sparkSession)
    counts = docs.select(F.col(text).alias("text")).mapInArrow(spans.tidy(_counts(size)), "part int, counts binary")
    summed = counts.repartition(partitions(docs.sparkSession), "part").mapInArrow(spans.tidy(_steps), "part int, steps binary")
    out = np.zeros((1 << (SLOT_BITS - PART_BITS), 1 << PART_BITS), np.uint8)
    for row in summed.collect():
        out[row.part] = np.frombuffer(row.steps, np.uint8)
    return out.ravel()


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """How many first shingles of ``n`` a set asks with, and how many it is found by if it is the smaller one."""
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def prefix(members: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    order = np.lexsort((members, rank[_slot(members)]))
    return members[order[: prefix_sizes(len(members), percent)[0]]]


def prefixed(docs: DataFrame, doc_id: str, text: str, percent: int, rank: np.ndarray, size: int = SHINGLE) -> DataFrame:
    """(doc, n, digest, mark, first): size and digest of the set, digest of size and prefix, the prefix itself."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members in shingle_sets(batch.column(1), size):
                first = prefix(members, rank, percent).tobytes() if len(members) else b""
                out.append((len(members), hashlib.blake2b(members.tobytes(), digest_size=16).digest(),
                            hashlib.blake2b(first, digest_size=16, salt=len(members).to_bytes(8, "little")).digest(), first))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary())))],
                ["doc", "n", "digest", "mark", "first"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(
        spans.tidy(run), f"doc {kind}, n long, digest binary, mark binary, first binary")


def _listed(percent: int):
    """Rows (token, group, n, place, indexed) of groups (group, n, first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            first = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            many = np.array([len(x) for x in first])
            row = np.repeat(np.arange(len(n)), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            found = np.array([prefix_sizes(int(k), percent)[1] for k in n])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(first)), batch.column(0).take(pa.array(row)), pa.array(n[row]), pa.array(place),
                 pa.array(place < found[row])], ["token", "group", "n", "place", "indexed"])

    return run


def group_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of groups (group, n, first) that hold all links between members of different groups, or connect them."""
    kind = groups.schema["group"].dataType.simpleString()
    listed = groups.select("group", "n", "first").mapInArrow(
        spans.tidy(_listed(percent)), f"token long, group {kind}, n long, place long, indexed boolean")
    listed = cut(listed, "listed")
    counts = listed.groupBy("token").agg(F.count("*").alias("many")).where("many > 1")
    met = cut(listed.join(counts, "token"), "met")
    short = met.where(F.col("many") <= SHORT)
    larger = short.select("token", F.col("group").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"))
    smaller = short.where("indexed").select("token", F.col("group").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"))
    # What both sets can still share from this place on has to reach what a link needs.
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = larger.join(smaller, "token").where(
        (F.col("a") != F.col("b")) & (F.col("n_b") <= F.col("n_a")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
        & ((100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b")))).select("a", "b")
    long = ordered_columns(
        met.where(F.col("many") > SHORT).select("token", "n", "group"), ["token"], ["n", "group"], lags={"before": F.struct("n", "group")})
    chain = long.where(100 * F.col("before.n") >= percent * F.col("n")).select(F.col("group").alias("a"), F.col("before.group").alias("b"))
    return pairs.unionByName(chain).distinct()


def jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 90, size: int = SHINGLE,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document row: ``doc``, ``n_shingles``, ``component_id``.

    Documents are linked if their sets share at least ``percent`` of their union; ``component_id`` is the smallest id
    reachable over links. A text of fewer words than a shingle is one shingle; nulls and texts without words have
    none and are linked with nothing. Repeated rows share a component. Rows without an id are kept and linked with
    nothing. Other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    rank = rarity(docs, text, size)
    base = cut(prefixed(docs, doc_id, text, percent, rank, size), "prefixed")
    used = base.where("n > 0 and doc is not null")
    groups = cut(used.groupBy("mark").agg(F.min("doc").alias("group"), F.first("n").alias("n"), F.first("first").alias("first")), "groups")
    connected = connect(group_pairs(groups, percent), [])
    homes = groups.select("mark", "group").join(connected.withColumnRenamed("id", "group"), "group", "left").select(
        "mark", F.coalesce("label", "group").alias("cluster"))
    classes = cut(
        used.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("n").alias("n_shingles"), F.first("mark").alias("mark"))
        .join(homes, "mark").drop("mark"), "classes")
    shared = classes.groupBy("cluster").count().where("count > 1").select("cluster")
    members = cut(classes.join(shared, "cluster").select("doc", "cluster", "n_shingles"), "members")
    plain = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    labels = verified_labels(plain, members, percent, size, block_shingles).distinct()
    named = classes.join(labels, "doc", "left").select("digest", F.coalesce("label", "doc").alias("component"))
    # Texts without a set, and rows without an id, have no class.
    out = base.select("doc", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("digest")).alias("digest"))
    return out.join(named, "digest", "left").select("doc", "n_shingles", F.coalesce("component", "doc").alias("component_id"))
