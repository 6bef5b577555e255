"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

1. Benchmark items become windows of ``size`` consecutive words (a shorter item is one window), and
   windows become shingles of three words (or all words of a window with fewer).
2. One pass over the documents keeps the word stretches in which every shingle occurs in the
   benchmark, tested on a bitmap of fixed size, and which are as long as the shortest window.
   Whatever the bitmap lets through by chance is refuted later; nothing true is lost.
3. Shingles are counted over all documents and ordered by rarity. A contained window holds all its
   shingles, so the prefix that a join needs is its rarest one.
4. Distinct stretches join windows on that shingle; the window must start and end inside the stretch
   (positional and length bounds), and its words are compared one by one.

A passage that fills a third of all documents is one stretch text: it is verified once and joined
back by text, so no hot key multiplies rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phenoframe.llm import spans
from phenoframe.llm.session import arrow_batches, cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
CHUNK = 14  # bits of a slot within its chunk of the bitmap
BITS = 22  # 4 million slots, half a megabyte packed, whatever the benchmark's size


def words(text) -> Column:
    """Lower-cased (A-Z only) words of a text; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, ...]:
    raw, off = spans.text_bytes(column)
    raw = spans.LOWER[raw]
    start, end, row = spans.spans(raw, off, spans.ALPHANUMERIC)
    return raw, start, end, row, spans.span_hashes(raw, start, end)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the bitmap, packed, from the places of their slots."""
    for batch in batches:
        packed = []
        for places in batch.column(2).to_pylist():
            bits = np.zeros(1 << CHUNK, bool)
            bits[places] = True
            packed.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary()), batch.column(3)], ["width", "chunk", "bits", "least"])


def _benchmark_slots(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *_, hashes = _word_hashes(batch.column(0).slice(i, 1))
                if len(hashes):
                    width = min(SHINGLE, len(hashes))
                    found = np.unique(_slots(spans.run_hashes(hashes, np.arange(len(hashes) - width + 1), width)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([width], pa.int32()), pa.array([min(len(hashes), size)], pa.int32()),
                         spans.lists(found, np.array([len(found)]), pa.int32())], ["width", "least", "slots"])

    return run


def _stretches(filters: dict[int, np.ndarray], least: int, id_type: pa.DataType):
    """Per row: its id, number of words and the word stretches that may hold a window."""
    piece = pa.struct([("start", pa.int32()), ("stretch", pa.string())])
    schema = pa.schema([("doc", id_type), ("n_words", pa.int64()), ("pieces", pa.list_(piece))])

    def block(ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
        raw, start, end, row, hashes = _word_hashes(text)
        n, rows = len(hashes), len(text)
        counts = np.bincount(row, minlength=rows).astype(np.int64)
        marks = np.zeros(n + 1, np.int32)
        for width, bitmap in filters.items():
            if n < width:
                continue
            first = np.flatnonzero(row[: n - width + 1] == row[width - 1:])
            hit = np.zeros(n, bool)
            hit[first] = bitmap[_slots(spans.run_hashes(hashes, first, width))]
            fence = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            a, b = fence[::2], fence[1::2] + width - 1
            # Runs of starts may go from the last words of one document to the next: none does, as
            # a document's last width - 1 words start no shingle; single words are cut below.
            long = b - a >= (least if width == SHINGLE else width)
            np.add.at(marks, a[long], 1)
            np.add.at(marks, b[long], -1)
        inside = np.r_[False, np.cumsum(marks[:-1]) > 0, False]
        new = np.r_[True, row[1:] != row[:-1], True] if n else np.ones(1, bool)
        a = np.flatnonzero(inside[1:-1] & (~inside[:-2] | new[:-1]))
        b = np.flatnonzero(inside[1:-1] & (~inside[2:] | new[1:])) + 1
        at = np.cumsum(counts) - counts
        pieces = pa.StructArray.from_arrays(
            [pa.array(a - at[row[a]], pa.int32()),
             pa.array([bytes(raw[start[x]: end[y - 1]]) for x, y in zip(a, b)], pa.binary()).cast(pa.string())],
            fields=list(piece))
        ends = np.zeros(rows + 1, np.int32)
        np.cumsum(np.bincount(row[a], minlength=rows), out=ends[1:])
        return pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pieces)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = spans.text_bytes(batch.column(1))
            for i, j in spans.blocks(off):
                yield block(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))

    return run


def _shingles(array, width) -> Column:
    """Shingles of ``width`` words of a word array, in order; none if it is shorter."""
    return F.when(
        F.size(array) >= width,
        F.transform(F.sequence(F.lit(1), F.size(array) - width + 1), lambda i: F.concat_ws(" ", F.slice(array, i, width))),
    ).otherwise(F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, size: int = 13) -> DataFrame:
    """(item, window): every run of ``size`` words of an item, or the whole of a shorter one."""
    listed = items.select(F.col("item").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size)
    )
    return listed.select("item", F.explode(runs).alias("window")).distinct()


def find_windows(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = 13, share: int = 20,
) -> DataFrame:
    """One row per document row: ``doc``, ``n_words``, ``n_hit``, ``items`` (sorted), ``hits``, ``contaminated``.

    A word is hit if it lies in an occurrence of a window of ``size`` consecutive item words; ``hits``
    are (start, length) word spans. A document is contaminated if it has hit words and they are at
    least one in ``share``. Null and empty texts have no words. Repeated rows are judged one by one;
    an empty benchmark hits nothing. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    seen = items.select("text").mapInArrow(spans.tidy(_benchmark_slots(size)), "width int, least int, slots array<int>")
    seen = seen.select("width", "least", F.explode("slots").alias("slot"))
    seen = cut(seen.groupBy("width", "slot").agg(F.min("least").alias("least")), "slots")
    chunks = seen.groupBy("width", F.shiftright("slot", CHUNK).alias("chunk")).agg(
        F.collect_list(F.col("slot").bitwiseAND((1 << CHUNK) - 1)).alias("places"), F.min("least").alias("least"))
    packed: dict[int, np.ndarray] = {}
    least, step = size, 1 << (CHUNK - 3)
    # At most 256 chunks of 2 kB for each of three widths, whatever the benchmark's size.
    for width, chunk, bits, low in chunks.mapInArrow(_bitmaps, "width int, chunk int, bits binary, least int").collect():
        packed.setdefault(width, np.zeros(1 << (BITS - 3), np.uint8))[chunk * step: (chunk + 1) * step] = np.frombuffer(bits, np.uint8)
        least = min(least, low) if width == SHINGLE else least
    kind = docs.schema[doc_id].dataType

    def stretches(batches):
        bitmaps = {k: np.unpackbits(v).view(bool) for k, v in packed.items()}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            yield from _stretches(bitmaps, least, id_type)(iter([batch]))

    base = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(
        spans.tidy(stretches), f"doc {kind.simpleString()}, n_words long, pieces array<struct<start:int,stretch:string>>")
    base = cut(base.withColumn("_row", F.monotonically_increasing_id()), "stretches")
    distinct = cut(
        base.select(F.explode("pieces.stretch").alias("stretch")).groupBy("stretch").agg(F.count("*").alias("n"))
        .withColumn("w", words(F.col("stretch"))), "distinct")
    widths = sorted(packed) or [SHINGLE]
    # Rarity over all documents, then the rarest shingle of every window and where it stands.
    placed = distinct.select(
        "stretch", "w", "n", F.explode(F.flatten(F.array(*[_shingles(F.col("w"), k) for k in widths]))).alias("_s")
    ).select("stretch", "w", "n", F.col("_s").alias("shingle")).distinct()
    rarity = placed.groupBy("shingle").agg(F.sum("n").alias("df"))
    windows = benchmark_windows(items, size)
    parts = windows.select("window").distinct().select(
        "window", F.posexplode(_shingles(F.col("window"), F.least(F.size("window"), F.lit(SHINGLE)))).alias("at", "shingle"))
    prefix = (
        parts.join(rarity, "shingle", "left")
        .groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "at")).alias("p"))
        .select("window", F.col("p.shingle").alias("shingle"), F.col("p.at").alias("at"))
    )
    width = F.size(F.split("shingle", " "))
    where = F.transform(
        F.filter(
            F.transform(_shingles(F.col("w"), width), lambda s, i: F.struct(s.alias("s"), i.alias("i"))),
            lambda p: p["s"] == F.col("shingle")),
        lambda p: p["i"] - F.col("at"))
    met = placed.drop("n").join(prefix, "shingle").select("stretch", "w", "window", F.explode(where).alias("start"))
    met = met.where(
        (F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.size("w"))
    ).where(F.slice("w", F.col("start") + 1, F.size("window")) == F.col("window"))
    met = cut(met.select("stretch", "start", "window"), "met")
    hit = met.groupBy("stretch").agg(F.collect_set(F.struct("start", F.size("window").alias("length"))).alias("runs"))
    named = met.select("stretch", "window").distinct().join(windows, "window").groupBy("stretch").agg(F.collect_set("item").alias("names"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1))))
    found = hit.join(named, "stretch").select("stretch", "runs", "names", F.size(covered).cast("long").alias("covered"))
    of_rows = (
        base.where(F.size("pieces") > 0).select("_row", F.explode("pieces").alias("p"))
        .select("_row", "p.start", "p.stretch").join(found, "stretch")
        .groupBy("_row").agg(
            F.sum("covered").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("items"),
            F.array_sort(F.flatten(F.collect_list(F.transform("runs", lambda r: F.struct((r["start"] + F.col("start")).alias("start"), r["length"].alias("length")))))).alias("hits"))
    )
    out = base.select("_row", "doc", "n_words").join(of_rows, "_row", "left").select(
        "doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,length:int>>")).alias("hits"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
