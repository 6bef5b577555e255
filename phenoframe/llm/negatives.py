"""Hard negatives by Four-Russians scoring: exact integer inner products from table lookups.

1. Vectors become integers (floor of a scaled component) and are packed into blocks of bit planes: for each bit of
   the two's complement, one byte holds that bit of eight neighbouring dimensions.
2. An anchor has one table for every eight dimensions: the sum of its components over each of the 256 subsets. A
   candidate's byte indexes the table; shifting by the plane and adding (the sign plane subtracts) gives the score.
3. Anchor blocks meet candidate deals in tasks of bounded size, twice: once inside a label for the positives, which
   fix each anchor's score windows, and once for the negatives inside the windows. A task keeps the best few rows of
   each window, a window function the best of all tasks. Every anchor is scored against every candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.llm import spans
from phenoframe.llm.session import arrow_batches, cut

GROUP = 8  # dimensions of a table: a byte of a bit plane
BLOCK = 1024  # candidates in a packed row
DEAL = 8192  # candidates that meet a block of anchors in one task, on average
ANCHORS = 4096  # anchors of a block, on average
TILE = 256  # candidates, and anchors, scored in one step
LIMIT = 1 << 24  # least component that is refused: a hundred times a score must fit 64 bits
LOWEST = -(1 << 62)


def quantised(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int = 256) -> DataFrame:
    """(id, label, q) of the rows that take part: an id, a label and every component given and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return given.where(finite).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column as rows, filled up with zeros to a multiple of eight numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    wide = max(1, -(-int(lengths.max(initial=0)) // GROUP)) * GROUP
    out = np.zeros((len(lengths), wide), np.int64)
    out[np.arange(wide) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    if len(out) and max(int(out.max()), -int(out.min())) >= LIMIT:
        raise ValueError(f"scaled components must be smaller than {LIMIT}")
    return out


def bit_planes(q: np.ndarray) -> np.ndarray:
    """(planes, groups, rows): bytes of eight dimensions' bits, lowest plane first, the sign plane last."""
    largest = int(np.where(q < 0, ~q, q).max(initial=0))
    out = [np.packbits((q >> b & 1).astype(np.uint8).reshape(len(q), -1, GROUP), axis=2, bitorder="little")[:, :, 0].T
           for b in range(largest.bit_length() + 1)]
    return np.ascontiguousarray(np.stack(out))


def subset_tables(q: np.ndarray, kind=np.int64) -> np.ndarray:
    """(groups, 256, anchors): sums of an anchor's components over every subset of eight dimensions."""
    groups = q.shape[1] // GROUP
    out = np.zeros((groups, 256, len(q)), kind)
    for g in range(groups):
        for d in range(GROUP):
            out[g, 1 << d: 2 << d] = out[g, : 1 << d] + q[:, g * GROUP + d].astype(kind)
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products: tables looked up by plane bytes, shifted and added from the sign plane down."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    groups = min(planes.shape[1], len(tables))
    for b in range(len(planes) - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(tables[g], planes[b, g], axis=0, out=found, mode="clip")
            total += found
        if b == len(planes) - 1:
            np.negative(total, out=total)
    return total


class Best:
    """The highest few (score, id) of each window; rows come in ascending order of id, repeats count once."""

    def __init__(self, lowest: np.ndarray, keep: int):
        self.floor, self.keep = lowest.copy(), keep
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, hit: np.ndarray, value: np.ndarray, ids: np.ndarray, windows: np.ndarray) -> None:
        """``hit``, ``value``: (rows, windows) of this step; ``windows``: their numbers."""
        row, column = np.nonzero(hit)
        if not len(row):
            return
        window = np.r_[self.window, windows[column]]
        score = np.r_[self.score, value[row, column].astype(np.int64)]
        ident = np.r_[self.id, ids[row]]
        order = np.lexsort((ident, -score, window))
        window, score, ident = window[order], score[order], ident[order]
        new = np.r_[True, (window[1:] != window[:-1]) | (score[1:] != score[:-1]) | (ident[1:] != ident[:-1])]
        window, score, ident = window[new], score[new], ident[new]
        first = np.r_[True, window[1:] != window[:-1]]
        place = np.arange(len(window)) - np.maximum.accumulate(np.where(first, np.arange(len(window)), 0))
        good = place < self.keep
        self.window, self.score, self.id = window[good], score[good], ident[good]
        last = place[good] == self.keep - 1
        self.floor[self.window[last]] = np.maximum(self.floor[self.window[last]], self.score[last])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, q) as blocks of bit planes."""
    schema = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("planes", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("bytes", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids, labels = (part.column(k).to_numpy().astype(np.int64) for k in (0, 1))
            planes = bit_planes(matrix(part.column(2)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((ids[0], len(ids), len(planes), ids.tobytes(), labels.tobytes(), planes.tobytes()), schema.types)],
                schema=schema)


class Candidates:
    """The packed blocks of a deal, as arrays in order of id."""

    def __init__(self, table: pa.Table):
        ids, labels, planes = [], [], []
        for row in table.select(["n", "planes", "ids", "labels", "bytes"]).to_pylist():
            ids.append(np.frombuffer(row["ids"], np.int64))
            labels.append(np.frombuffer(row["labels"], np.int64))
            planes.append(np.frombuffer(row["bytes"], np.uint8).reshape(row["planes"], -1, row["n"]))
        deep, wide = max(len(p) for p in planes), max(p.shape[1] for p in planes)
        # More planes repeat the sign; more groups are zero.
        planes = [np.pad(np.concatenate([p, np.repeat(p[-1:], deep - len(p), axis=0)]), ((0, 0), (0, wide - p.shape[1]), (0, 0))) for p in planes]
        self.ids, self.labels, self.planes = np.concatenate(ids), np.concatenate(labels), np.concatenate(planes, axis=2)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.labels, self.planes = self.ids[order], self.labels[order], self.planes[:, :, order]


def _anchors(table: pa.Table) -> tuple[np.ndarray, ...]:
    ids, tags, labels = (table.column(c).to_numpy() for c in ("id", "tag", "label"))
    return ids, tags, labels, matrix(table.column("q"))


def _number_type(q: np.ndarray, planes: int):
    """32 bits, if no sum on the way can pass them."""
    return np.int32 if int(np.abs(q).sum(axis=1).max(initial=0)) << planes < 1 << 31 else np.int64


def _result(ids, tags, label, best: Best, windows: int) -> pa.Table:
    anchor = best.window // windows
    return pa.table({
        "id": ids[anchor], "tag": tags[anchor], "label": label[anchor], "window": (best.window % windows).astype(np.int32),
        "score": best.score, "other": best.id})


def _positives(keep: int):
    """The best rows of an anchor's own label in one deal."""

    def run(deal: pa.Table, block: pa.Table) -> pa.Table:
        ids, tags, labels, q = _anchors(block)
        best = Best(np.full(len(ids), LOWEST), keep)
        if deal.num_rows and len(ids):
            rows = Candidates(deal)
            kind = _number_type(q, len(rows.planes))
            for label in np.unique(labels):
                mine, own = np.flatnonzero(labels == label), np.flatnonzero(rows.labels == label)
                for i in range(0, len(mine), TILE):
                    who = mine[i: i + TILE]
                    tables = subset_tables(q[who], kind)
                    for j in range(0, len(own), TILE):
                        part = own[j: j + TILE]
                        value = scores(rows.planes[:, :, part], tables)
                        hit = (value > best.floor[who]) & (rows.ids[part][:, None] != ids[who])
                        best.add(hit, value, rows.ids[part], who)
            del rows
            spans.release()
        return _result(ids, tags, labels, best, 1)

    return run


def _negatives(keep: int, windows: int):
    """The best rows of other labels in one deal, for each window (low, high) of an anchor's scores."""

    def run(deal: pa.Table, block: pa.Table) -> pa.Table:
        ids, tags, labels, q = _anchors(block)
        low, high = np.full((len(ids), windows), 0), np.full((len(ids), windows), LOWEST)
        for name, bound in (("low", low), ("high", high)):
            for i, values in enumerate(block.column(name).to_pylist()):
                bound[i, : len(values)] = values
        best = Best(low.ravel() - 1, keep)
        if deal.num_rows and len(ids):
            rows = Candidates(deal)
            kind = _number_type(q, len(rows.planes))
            for i in range(0, len(ids), TILE):
                who = np.arange(i, min(i + TILE, len(ids)))
                tables = subset_tables(q[who], kind)
                for j in range(0, len(rows.ids), TILE):
                    part = slice(j, j + TILE)
                    value = scores(rows.planes[:, :, part], tables)
                    other = rows.labels[part][:, None] != labels[who]
                    for w in range(windows):
                        at = who * windows + w
                        hit = (value <= high[who, w]) & (value > best.floor[at]) & other
                        best.add(hit, value, rows.ids[part], at)
            del rows
            spans.release()
        return _result(ids, tags, labels, best, windows)

    return run


def _best_of_all(found: DataFrame, keep: int, rank: str) -> DataFrame:
    order = Window.partitionBy("id", "tag", "window").orderBy(F.desc("score"), "other")
    return found.distinct().withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= keep)


def mine(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 5, share: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of hard negatives.

    For every anchor (rows for which ``is_anchor`` holds) its ``positives`` best other rows of the same label, and
    for each of these the ``negatives`` best rows of other labels whose score reaches ``share`` percent of the
    positive's and does not pass it. Higher scores come first, ties by smaller id. Rows with a null id, label,
    vector or component, or one that is not finite, take no part; shorter vectors count as filled up with zeros.
    Repeated rows count once; rows of one id with other contents are rows of their own, but none of an anchor's
    others. Components of ``LIMIT`` or more after scaling raise ValueError. Other columns are not read.
    """
    spark = rows.sparkSession
    arrow_batches(spark, rows=4 * BLOCK)
    taken = quantised(rows, vec_id, vector, label, scale)
    packed = cut(taken.mapInArrow(
        spans.tidy(_packed), "first long, n long, planes int, ids binary, labels binary, bytes binary"), "packed")
    asked = cut(
        quantised(rows.where(is_anchor), vec_id, vector, label, scale).distinct().withColumn("tag", F.xxhash64("label", "q")), "anchors")
    deals = max(1, -(-(packed.agg(F.sum("n")).first()[0] or 0) // DEAL))
    blocks = max(1, -(-asked.count() // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = packed.withColumn("deal", F.pmod(F.xxhash64("first", "n", "bytes"), F.lit(deals)).cast("int")).withColumn("block", every(blocks))

    def meet(anchors: DataFrame, run) -> DataFrame:
        seated = anchors.withColumn("block", F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)).cast("int")).withColumn("deal", every(deals))
        return dealt.groupBy("block", "deal").cogroup(seated.groupBy("block", "deal")).applyInArrow(
            run, "id long, tag long, label long, window int, score long, other long")

    near = cut(_best_of_all(meet(asked, _positives(positives)), positives, "place").select(
        "id", "tag", (F.col("place") - 1).alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Least score that is allowed: the share of the positive's, rounded up.
    bounds = near.groupBy("id", "tag").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("w")).select(
        "id", "tag", F.transform("w", lambda x: x["positive_score"]).alias("high"),
        F.transform("w", lambda x: -F.floor(-share * x["positive_score"] / F.lit(100).cast("decimal(3,0)")).cast("long")).alias("low"))
    far = _best_of_all(meet(asked.join(bounds, ["id", "tag"]), _negatives(negatives, positives)), negatives, "rank")
    return far.join(near, ["id", "tag", "window"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
