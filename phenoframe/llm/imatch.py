"""I-Match fingerprints over randomised lexicons.

Terms are counted over all documents in a table of fixed size (terms share a slot by hash, so neither
the table nor its broadcast grows with the corpus). A text keeps its distinct terms whose inverse document
frequency lies in a band, sorted; each of a number of random sub-lexicons keeps some of them and hashes
those. Sub-lexicons come in several densities, so that for short and for long texts some of them keep a few
terms only and survive edits elsewhere in the text.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm import spans
from phenoframe.llm.session import arrow_batches, partitions

SLOTS = 1 << 20
CHUNK = 1 << 14
ORDERS = 32
DENSITIES = tuple(0.5**k for k in range(10))
CODES = ORDERS * len(DENSITIES)
ENOUGH = 16  # informative sub-lexicons that make a density count
_SEEDS = spans.mix(np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LIMITS = [np.uint64(int(d * 65536)) for d in DENSITIES]


def terms(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct term hashes of each text; terms are lower-cased runs of letters and digits."""
    raw, off = spans.text_bytes(column)
    for i, j in spans.blocks(off):
        part = spans.LOWER[raw[off[i]: off[j]]]
        start, end, row = spans.spans(part, off[i: j + 1] - off[i], spans.ALPHANUMERIC)
        found = spans.span_hashes(part, start, end)
        stop = np.cumsum(np.bincount(row, minlength=j - i))
        for a, b in zip(np.r_[0, stop[:-1]], stop):
            yield np.unique(found[a:b])


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for found in terms(batch.column(0)):
            total[np.unique(slots(found))] += 1
        n += batch.num_rows
    if n:
        chunks = [(k, total[k * CHUNK: (k + 1) * CHUNK].astype("<i8").tobytes()) for k in range(SLOTS // CHUNK)]
        chunks.append((-1, np.array([n], "<i8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in chunks], pa.int32()), pa.array([c[1] for c in chunks], pa.binary())], ["chunk", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(counts, "<i8")
            total[chunk] = total[chunk] + counts if chunk in total else counts
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "counts"])


class Lexicon:
    """Which slots hold terms inside the band, as a bitmap."""

    def __init__(self, counts: np.ndarray, documents: int, low: float, high: float):
        with np.errstate(divide="ignore"):
            idf = np.log(max(1, documents) / counts)
        self.bits = np.packbits((counts > 0) & (idf >= low) & (idf <= high))

    def band(self) -> np.ndarray:
        return np.unpackbits(self.bits).view(bool)


def fit_lexicon(docs: DataFrame, text: str = "text", low: float = 3.9, high: float = 12.0) -> Lexicon:
    """Count terms over all documents and keep those with ``low`` <= idf <= ``high`` (natural logarithm).

    The default leaves out what stands in more than one document of fifty.
    """
    arrow_batches(docs.sparkSession)
    part = docs.select(text).mapInArrow(spans.tidy(_count), "chunk int, counts binary")
    whole = part.repartition(partitions(docs.sparkSession), "chunk").mapInArrow(spans.tidy(_add), "chunk int, counts binary")
    counts, documents = np.zeros(SLOTS, np.int64), 0
    for chunk, values in whole.collect():  # SLOTS numbers, whatever the corpus
        values = np.frombuffer(values, "<i8")
        if chunk < 0:
            documents = int(values[0])
        else:
            counts[chunk * CHUNK: (chunk + 1) * CHUNK] = values
    return Lexicon(counts, documents, low, high)


def _codes(kept: np.ndarray) -> np.ndarray:
    """One 12-bit code for each sub-lexicon: a hash of the kept terms it holds, 0 if none."""
    out = np.zeros((len(DENSITIES), ORDERS), np.uint64)
    some = np.zeros((len(DENSITIES), ORDERS), bool)
    for at in range(0, len(kept), 8192):
        drawn = spans.mix(kept[at: at + 8192, None] ^ _SEEDS)
        level = drawn & np.uint64(0xFFFF)
        value = spans.mix(drawn)
        for k, limit in enumerate(_LIMITS):
            use = level < limit
            out[k] += np.where(use, value, np.uint64(0)).sum(axis=0, dtype=np.uint64)
            some[k] |= use.any(axis=0)
    codes = (spans.mix(out) >> np.uint64(52)).astype(np.uint16)
    return np.where(some, np.maximum(codes, 1), 0).astype(np.uint16).ravel()


def fingerprints(column: pa.Array, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind and codes of each text. Kind 2: from terms in the band; 1: there are none, from all terms;
    0: there are no terms, from the whole text."""
    kinds, codes = np.zeros(len(column), np.uint8), np.zeros((len(column), CODES), np.uint16)
    for i, found in enumerate(terms(column)):
        kept = found[band[slots(found)]]
        if len(found):
            kinds[i] = 2 if len(kept) else 1
            codes[i] = _codes(kept if len(kept) else found)
        else:
            body = hashlib.shake_128((column[i].as_py() or "").encode()).digest(2 * CODES)
            codes[i] = np.maximum(np.frombuffer(body, np.uint16) >> 4, 1)
    return kinds, codes


def likeness(kinds: np.ndarray, codes: np.ndarray, other_kinds: np.ndarray, other_codes: np.ndarray) -> np.ndarray:
    """0 to 1: equal codes among informative ones (not empty on both sides) at the sparsest density that has
    enough of them, else among all. Different kinds are unlike; without terms only equal texts are alike."""
    shape = (len(codes), len(DENSITIES), ORDERS)
    a, b = codes.reshape(shape), other_codes.reshape(shape)
    told = ((a > 0) | (b > 0)).sum(axis=2)
    same = ((a > 0) & (a == b)).sum(axis=2)
    level = len(DENSITIES) - 1 - np.argmax((told >= ENOUGH)[:, ::-1], axis=1)
    rows = np.arange(len(codes))
    share = np.where((told >= ENOUGH).any(axis=1), same[rows, level] / np.maximum(told[rows, level], 1), same.sum(axis=1) / np.maximum(told.sum(axis=1), 1))
    text = kinds == 0
    share[text] = (a == b).all(axis=(1, 2))[text]
    return np.where(kinds == other_kinds, share, 0.0)


def _print(kind: int, codes: np.ndarray) -> str:
    """The kind, then two base64 signs for each code."""
    pairs = (codes[0::2].astype(np.uint32) << np.uint32(12)) | codes[1::2]
    return f"{kind}{base64.b64encode(np.ascontiguousarray(pairs.astype('>u4').view(np.uint8).reshape(-1, 4)[:, 1:]).tobytes()).decode()}"


def fingerprint(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fingerprint) of every document row; equal texts have equal fingerprints, null is empty."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = lexicon.band()
        for batch in batches:
            kinds, codes = fingerprints(batch.column(1), band)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_print(k, c) for k, c in zip(kinds, codes)], pa.string())], ["doc", "fingerprint"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(spans.tidy(run), f"doc {kind}, fingerprint string")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, late, doc, text, guest) of which each part, ordered by (late, doc, text), holds a run of
    consecutive documents and, as a guest at its end, the document after the run. Rows without an id come first.

    Parts are ranges of ids with cuts from a quantile sketch: one shuffle of the texts, no global order.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = partitions(spark)
    cuts = plain.select(F.col("doc").cast("double").alias("doc")).approxQuantile("doc", [k / count for k in range(1, count)], 0.25 / count)
    splits = [-math.inf, *(sorted(set(cuts)) or [0.0]), math.inf]
    ranged = Bucketizer(splits=splits, inputCol="_at", outputCol="_part").transform(
        plain.withColumn("_at", F.col("doc").cast("double"))).select("doc", "text", F.coalesce(F.col("_part").cast("int") + 1, F.lit(0)).alias("part"))
    firsts = sorted(ranged.groupBy("part").agg(F.min("doc").alias("doc")).collect())  # a row for each range, one part has no ids
    guests = [(first, firsts[k - 1][0] if k else firsts[-1][0], int(k == 0)) for k, (_, first) in enumerate(firsts)]
    invited = F.broadcast(spark.createDataFrame(guests, "doc long, host int, late int"))
    own = F.struct(F.col("part"), F.lit(0).alias("late"), F.lit(False).alias("guest"))
    other = F.struct(F.col("host").alias("part"), F.col("late"), F.lit(True).alias("guest"))
    seats = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, other))
    return ranged.join(invited.withColumnRenamed("doc", "_first"), F.col("doc").eqNullSafe(F.col("_first")), "left").select("doc", "text", F.explode(seats).alias("s")).select(
        "s.part", "s.late", "doc", "text", "s.guest")


def edited_fingerprints(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the next document.

    Rows: ``doc``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``. Documents are ordered by id and text, those without an id first; the first follows the last. A null text
    is empty; repeated rows are rows of their own.
    """
    arrow_batches(docs.sparkSession)
    if docs.isEmpty():
        seated = docs.sparkSession.createDataFrame([], "part int, late int, doc long, text string, guest boolean")
    else:
        seated = with_next(docs, doc_id, text)
    # One part to a partition: hashing their numbers would put several into one.
    ordered = seated.repartitionById(partitions(docs.sparkSession) + 1, F.col("part")).sortWithinPartitions("part", "late", "doc", "guest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, last = lexicon.band(), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if last is not None:
                rows = pa.concat_tables([last, rows])
            rows = rows.combine_chunks()
            n = rows.num_rows
            last = rows.slice(n - 1)
            part, guest = rows.column("part").to_numpy(), np.array(rows.column("guest").to_pylist(), bool)
            body = rows.column("text").combine_chunks()
            use = np.flatnonzero(~guest[:-1] & (part[1:] == part[:-1]))
            if not len(use):
                continue
            texts = body.to_pylist()
            edited = []
            for i in use:
                half = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            kinds, codes = fingerprints(body, band)
            new_kinds, new_codes = fingerprints(pa.array(edited, pa.string()), band)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc").combine_chunks().take(pa.array(use)), pa.array([len(texts[i]) for i in use], pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                 pa.array([_print(kinds[i], codes[i]) for i in use]), pa.array([_print(k, c) for k, c in zip(new_kinds, new_codes)]),
                 pa.array(likeness(kinds[use], codes[use], new_kinds, new_codes)),
                 pa.array(likeness(kinds[use], codes[use], kinds[use + 1], codes[use + 1]))],
                ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(
        spans.tidy(run), "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
