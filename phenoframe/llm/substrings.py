"""Suffix-array deduplication of repeated byte strings with deep-shallow sorting.

All windows of ``length`` bytes that share content must meet, without moving every suffix:

0. A document whose whole text a smaller one has, by SHA-256, goes as a whole and takes no part: all that it could
   prove repeated, the smaller one proves.
1. Each window is represented by its least-hashed 16-byte string, its anchor. Equal windows have equal
   anchors at equal places, and about one byte in eighteen is an anchor. Per block of documents, each anchor
   is reported once with the smallest document that has it.
2. Anchors found in one document only are dropped; the others are told to their documents. Anchors that very many
   stretches have, by counts over all documents in a table of fixed size, need no report: they are shared.
3. For shared anchors, the stretch of windows around the anchor is sent to the anchor's bucket. Stretches with equal
   bytes inside a block are settled there, so frequent passages travel once per block. Stretches of very frequent
   anchors are dealt window by window, by a hash of the whole window, so that no bucket grows with the corpus; equal
   windows of a block are settled before.
4. In a bucket stretches with equal bytes are settled by the smallest document. The windows of what is left are
   sorted: a multikey quicksort on eight-byte characters to a shallow depth, then blind tries over what is still tied.
   Tries branch on single bytes and skip what is common, and all tries of a bucket grow level by level together.
   Windows that stay together are equal; the ones that do not belong to the smallest document are repeats.
5. Repeated windows become spans, and spans are cut from their documents.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm import spans
from phenoframe.llm.session import arrow_batches, cut, partitions

ANCHOR = 16
SHALLOW = 2  # characters of eight bytes that the quicksort looks at
BUCKET_BYTES = 8 << 20  # a block has a row for each bucket, so few large buckets, which are sorted in parts
PART_SHIFT, SORTED_PARTS = 30, 4  # bits of a hash that give the part of a bucket
REPORT_BYTES = 3 << 20  # texts that are reported and settled together
PIECE_BYTES = 256 << 10  # texts that are hashed together: what a step makes of them stays in a core's cache
_WORD = np.uint64(0xFFFFFFFF)
NO_ID = -(1 << 63)  # stands for a null id, before all others
SLOT_BITS = 22  # of the table in which stretches are counted by anchor
PART_BITS = 14  # slots of one row of counts
FIRST_BITS = 25  # of the filter of first documents
HOT = 4096  # stretches with one anchor that still meet in its bucket


def _load8(raw: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from every position as one number."""
    raw, whole = np.ascontiguousarray(raw), np.empty(max(0, len(raw) - 7), np.uint64)
    for k in range(min(8, len(whole))):
        whole[k::8] = np.frombuffer(raw, np.uint64, len(whole[k::8]), k)
    return whole.byteswap(inplace=True) if big == (sys.byteorder == "little") else whole


def stretches(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash) of every run of windows that share an anchor."""
    parts = []
    for i, j in spans.blocks(off, PIECE_BYTES):
        row, first, windows, hashes = _stretches(raw[off[i]: off[j]], off[i: j + 1] - off[i], length)
        parts.append((row + i, first + off[i], windows, hashes))
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(c) for c in zip(_stretches(raw[:0], off[:1], length), *parts))


def _stretches(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, np.zeros(0, np.uint64)
    eight = _load8(raw)
    strings = len(raw) - ANCHOR + 1
    value = eight[:strings] * np.uint64(0x9E3779B97F4A7C15)
    value += eight[8: 8 + strings] * np.uint64(0xC2B2AE3D27D4EB4F)
    value = spans.mix(value)
    least = (value & ~_WORD) | np.arange(strings, dtype=np.uint64)
    reach, span = length - ANCHOR + 1, 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: span - reach], least[reach - span:])
    anchor = least.astype(np.uint32)  # one for each window start
    first = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, off[:-1][off[:-1] < len(anchor)])
    row = np.searchsorted(off, first, side="right") - 1
    # The windows of a text end before its last bytes.
    windows = np.minimum(np.r_[first[1:], len(anchor)], off[row + 1] - length + 1) - first
    used = windows > 0
    first = first[used]
    return row[used], first, windows[used], value[anchor[first]]


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """What is kept of an anchor's hash: its upper half and its bucket."""
    return (hashes & ~_WORD) | (hashes & np.uint64(buckets - 1))


def _slot(hashes: np.ndarray) -> np.ndarray:
    """Place in the table of counts; the upper half of an anchor's hash is small, so the lower one is taken."""
    return (hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _count(length: int, firsts: np.ndarray | None = None):
    """A task's stretches by the slot of their anchor, as rows (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int32)
        for batch in batches:
            raw, off = spans.text_bytes(_only(batch, firsts).column(1))
            for i, j in spans.blocks(off, REPORT_BYTES):
                np.add.at(total, _slot(stretches(raw[off[i]: off[j]], off[i: j + 1] - off[i], length)[3]), 1)
        for k, part in enumerate(total.reshape(-1, 1 << PART_BITS)):
            if part.any():
                packed = pa.compress(part.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["part", "counts"])

    return run


def _above(limit: int):
    """Which slots of the parts that a task holds have more than ``limit`` stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.setdefault(part, np.zeros(1 << PART_BITS, np.int64))
                total[part] += np.frombuffer(pa.decompress(counts, 4 << PART_BITS, "zstd", asbytes=True), np.int32)
        for part, n in total.items():
            bits = np.packbits(n > limit).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary())], ["part", "bits"])

    return run


def hot_slots(plain: DataFrame, length: int, limit: int, firsts: np.ndarray | None = None) -> np.ndarray:
    """Bitmap (512 kB, whatever the corpus) of slots whose anchors have more than ``limit`` stretches in all documents."""
    counts = plain.select("doc", "text").mapInArrow(spans.tidy(_count(length, firsts)), "part int, counts binary")
    above = counts.repartition(partitions(plain.sparkSession), "part").mapInArrow(spans.tidy(_above(limit)), "part int, bits binary")
    out = np.zeros((1 << (SLOT_BITS - PART_BITS), 1 << (PART_BITS - 3)), np.uint8)
    for row in above.collect():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def _is_hot(hot: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = _slot(hashes)
    return (hot[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)


def _marks(digests: Iterator[bytes], docs: np.ndarray) -> np.ndarray:
    """Places of each (text, document) in the table of first documents: two rows of numbers."""
    text = np.frombuffer(b"".join(digests), np.uint64).reshape(len(docs), 4)
    mixed = spans.mix(np.stack([text[:, 0], text[:, 1]]) ^ spans.mix(docs.astype(np.int64).view(np.uint64)))
    return (mixed & np.uint64((1 << FIRST_BITS) - 1)).astype(np.int64)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of a task's first documents, as rows (part, bits)."""
    table = np.zeros(1 << FIRST_BITS, bool)
    for batch in batches:
        table[_marks(batch.column(0).to_pylist(), batch.column(1).to_numpy())] = True
    for k, part in enumerate(table.reshape(-1, 8 << PART_BITS)):
        if part.any():
            packed = pa.compress(np.packbits(part).tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["part", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the table that a task holds, put together."""
    table: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            table.setdefault(part, np.zeros(1 << PART_BITS, np.uint8))
            table[part] |= np.frombuffer(pa.decompress(bits, 1 << PART_BITS, "zstd", asbytes=True), np.uint8)
    for part, bits in table.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])


def first_documents(texts: DataFrame) -> np.ndarray | None:
    """Bloom filter (4 MB, whatever the corpus) of the documents that are the smallest with their text; None if all are.

    ``texts``: digest, first, last. What the filter does not hold is a copy of a smaller document; a copy that it holds
    by chance is only worked on in vain.
    """
    if texts.where("first < last").isEmpty():
        return None
    parts = texts.select("digest", "first").mapInArrow(spans.tidy(_place), "part int, bits binary")
    whole = parts.repartition(partitions(texts.sparkSession), "part").mapInArrow(spans.tidy(_either), "part int, bits binary")
    out = np.zeros((1 << (FIRST_BITS - PART_BITS - 3), 1 << PART_BITS), np.uint8)
    for row in whole.collect():
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def _first(batch: pa.RecordBatch, firsts: np.ndarray | None) -> np.ndarray:
    """Which rows (doc, text) are not known to be copies of a smaller document."""
    if firsts is None or not len(batch):
        return np.ones(len(batch), bool)
    raw, off = spans.text_bytes(batch.column(1))
    digests = (hashlib.sha256(raw[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist()))
    place = _marks(digests, batch.column(0).to_numpy())
    return (firsts[place >> 3] >> (7 - (place & 7)) & 1).all(axis=0)


def _only(batch: pa.RecordBatch, firsts: np.ndarray | None) -> pa.RecordBatch:
    return batch if firsts is None else batch.filter(pa.array(_first(batch, firsts)))


def _planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well when neighbours are alike."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _split(order_key: np.ndarray) -> list[tuple[int, int]]:
    fence = np.r_[0, np.flatnonzero(order_key[1:] != order_key[:-1]) + 1, len(order_key)]
    return list(zip(fence[:-1].tolist(), fence[1:].tolist())) if len(order_key) else []


def _blobs(values: np.ndarray, fence: np.ndarray) -> pa.Array:
    """A binary column of the consecutive stretches of ``values`` between the places of ``fence``."""
    wide = values.dtype.itemsize * int(np.prod(values.shape[1:]))
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(fence) - 1, [None, pa.py_buffer((fence * wide).astype(np.int64).tobytes()), data]).cast(pa.binary())


def _fence(sorted_key: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values starts, and the end."""
    return np.r_[0, np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1, len(sorted_key)] if len(sorted_key) else np.zeros(1, np.int64)


def _per_doc(docs: np.ndarray, keys: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Distinct keys of each document as one blob."""
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])][: len(docs)]
    docs, keys = docs[new], keys[new]
    fence = _fence(docs)
    return pa.array(docs[fence[:-1]]), _blobs(keys, fence)


REPORT = pa.schema([("bucket", pa.int64()), ("heads", pa.binary()), ("docs", pa.binary()), ("many", pa.binary()), ("doc", pa.int64()), ("keys", pa.binary())])


def _passing(schema: pa.Schema, docs: pa.Array, values: pa.Array, buckets: int) -> pa.RecordBatch:
    """Finished (doc, value) rows in the shape of rows that are still worked on."""
    bucket = pa.array(docs.to_numpy() % buckets)
    between = [pa.nulls(len(docs), t) for t in schema.types[1:-2]]
    return pa.RecordBatch.from_arrays([bucket, *between, docs, values], schema=schema)


def _report(length: int, buckets: int, hot: np.ndarray, firsts: np.ndarray | None = None):
    """Anchors of each block by bucket, and those that two of its documents have, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (_only(b, firsts) for b in batches):
            raw, off = spans.text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in spans.blocks(off, REPORT_BYTES):
                row, _, _, hashes = stretches(raw[off[i]: off[j]], off[i: j + 1] - off[i], length)
                if not len(row):
                    continue
                keys, docs, often = _keys(hashes, buckets), ids[i + row], _is_hot(hot, hashes)
                yield _passing(REPORT, *_per_doc(docs[often], keys[often]), buckets)  # shared, whatever others report
                keys, docs = keys[~often], docs[~often]
                if not len(keys):
                    continue
                order = np.argsort(keys)
                keys, docs = keys[order], docs[order]
                at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                low, high = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
                many = low != high
                bucket = (keys[at] & _WORD).astype(np.int64)
                shared = np.repeat(many, np.diff(np.r_[at, len(keys)]))
                by = np.argsort(bucket, kind="stable")
                heads, low, many, bucket = (keys[at[by]] >> np.uint64(32)).astype("<u4"), low[by], many[by], bucket[by]
                rows = [
                    (int(bucket[a]), heads[a:b].tobytes(), _planes(low[a:b]), np.packbits(many[a:b]).tobytes(), None, None)
                    for a, b in _split(bucket)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), REPORT.types)], schema=REPORT)
                yield _passing(REPORT, *_per_doc(docs[shared], keys[shared]), buckets)

    return run


def _parts(part):
    """Rows that are to be worked on, and the finished (doc, value) rows that only pass through."""
    done = pc.is_valid(part.column("doc"))
    return part.filter(pc.invert(done)), part.filter(done)


def _pairs(docs: pa.Array, values: pa.Array, name: str, passed: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.table([docs, values], names=["doc", name]), pa.table([passed.column("doc"), passed.column(name)], names=["doc", name])])


def _shared(key, part):
    """Documents of a bucket's anchors that occur in other blocks as well."""
    part, passed = _parts(part)
    if not part.num_rows:
        return _pairs(pa.nulls(0, pa.int64()), pa.nulls(0, pa.binary()), "keys", passed)
    heads = np.concatenate([np.frombuffer(x, "<u4") for x in part.column("heads").to_pylist()])
    docs = np.concatenate([_numbers(x) for x in part.column("docs").to_pylist()])
    many = np.concatenate([
        np.unpackbits(np.frombuffer(m, np.uint8))[: len(h) // 4].astype(bool)
        for m, h in zip(part.column("many").to_pylist(), part.column("heads").to_pylist())])
    order = np.argsort(heads, kind="stable")
    heads, docs, many = heads[order], docs[order], many[order]
    at = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
    size = np.diff(np.r_[at, len(heads)])
    tell = np.repeat(size > 1, size) & ~many  # documents of a block with two of them know already
    keys = (heads.astype(np.uint64) << np.uint64(32)) | np.uint64(key[0].as_py())
    return _pairs(*_per_doc(docs[tell], keys[tell]), "keys", passed)


SENT = pa.schema([
    ("bucket", pa.int64()), ("bytes", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()),
    ("parts", pa.binary()), ("doc", pa.int64()), ("spans", pa.binary())])


def _repeats(part: np.ndarray, start: np.ndarray, size: np.ndarray, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which stretches have the bytes of one of a smaller document (the smallest keeps its own)."""
    body = spans.span_hashes(part, start, start + size)
    order = np.lexsort((at, docs, body))
    head = np.zeros(len(order), np.int64)
    new = np.r_[True, body[order][1:] != body[order][:-1]][: len(order)]
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = (head != np.arange(len(order))) & (docs != docs[head]) & (size == size[head])
    found = np.flatnonzero(same)
    if len(found):
        first = np.cumsum(size[found]) - size[found]
        inner = np.arange(int(size[found].sum())) - np.repeat(first, size[found])
        equal = part[np.repeat(start[found], size[found]) + inner] == part[np.repeat(start[head[found]], size[found]) + inner]
        same[found] = np.logical_and.reduceat(equal, first)
    return same


def _deal(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and, in the lowest bits, its part."""
    part = (hashes >> np.uint64(PART_SHIFT)) & np.uint64(SORTED_PARTS - 1)
    return ((hashes & np.uint64(buckets - 1)) * np.uint64(SORTED_PARTS) + part).astype(np.int64)


def _send(length: int, buckets: int, hot: np.ndarray):
    """Stretches of shared anchors by bucket; spans that the block itself proves repeated, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = spans.text_bytes(batch.column(1))
            ids, told = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for i, j in spans.blocks(off, REPORT_BYTES):
                part, local = raw[off[i]: off[j]], off[i: j + 1] - off[i]
                row, start, windows, hashes = stretches(part, local, length)
                if not len(row):
                    continue
                keys = _keys(hashes, buckets)
                # Keys and rows are compared together; a chance match only sends a stretch in vain.
                place = np.uint64(0x9E3779B97F4A7C15)
                mine = np.arange(j - i, dtype=np.uint64) * place
                known = [np.frombuffer(b"".join(told[i + r] or ()), np.uint64) + mine[r: r + 1] for r in range(j - i)]
                use = np.isin(keys + row.astype(np.uint64) * place, np.concatenate(known))
                row, start, windows, hashes = row[use], start[use], windows[use], hashes[use]
                often = _is_hot(hot, hashes)
                if not len(row):
                    continue
                size = windows + length - 1
                docs, at = ids[i + row], start - local[row]
                same = _repeats(part, start, size, docs, at)
                yield _passing(SENT, *_spans_of(docs[same], at[same], at[same] + size[same]), buckets)
                bucket = _deal(hashes, buckets)
                wide = np.flatnonzero(~same & often)
                if len(wide):  # one by one, and equal ones settled
                    each = np.repeat(wide, windows[wide])
                    inner = np.arange(len(each)) - np.repeat(np.cumsum(windows[wide]) - windows[wide], windows[wide])
                    begin, place, one = start[each] + inner, at[each] + inner, np.full(len(each), length)
                    again = _repeats(part, begin, one, docs[each], place)
                    yield _passing(SENT, *_spans_of(docs[each][again], place[again], place[again] + length), buckets)
                    rest = np.flatnonzero(~same & ~often)
                    each, begin, place, one = each[~again], begin[~again], place[~again], one[~again]
                    bucket = np.r_[bucket[rest], _deal(spans.span_hashes(part, begin, begin + length), buckets)]
                    docs, start, at, size = np.r_[docs[rest], docs[each]], np.r_[start[rest], begin], np.r_[at[rest], place], np.r_[size[rest], one]
                    keep = np.arange(len(docs))
                else:
                    keep = np.flatnonzero(~same)
                    bucket = bucket[keep]
                if not len(keep):
                    continue
                by = keep[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket)
                inner, bucket = (bucket % SORTED_PARTS).astype(np.uint8), bucket // SORTED_PARTS
                stop = np.cumsum(size[by])
                body = part[np.repeat(start[by] - (stop - size[by]), size[by]) + np.arange(stop[-1])]
                rows = []
                for a, b in _split(bucket):
                    k = by[a:b]
                    rows.append((
                        int(bucket[a]), pa.compress(body[stop[a] - size[by[a]]: stop[b - 1]].tobytes(), "zstd", asbytes=True),
                        size[k].astype("<u4").tobytes(), _planes(docs[k]), at[k].astype("<u8").tobytes(), inner[a:b].tobytes(), None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SENT.types)], schema=SENT)

    return run


def _spans_of(docs: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Merged spans of each document, as one blob of pairs of numbers."""
    if not len(docs):
        return pa.nulls(0, pa.int64()), pa.nulls(0, pa.binary())
    order = np.lexsort((start, docs))
    docs, start, stop = docs[order], start[order], stop[order]
    # Documents lie one behind the other, with a gap between, so all are merged at once.
    number = np.cumsum(np.r_[False, docs[1:] != docs[:-1]]) * (int(stop.max()) + 1)
    pairs = merge(np.stack([start + number, stop + number], axis=1))
    first = np.searchsorted(start + number, pairs[:, 0])
    fence = _fence(docs[first])
    return pa.array(docs[first][fence[:-1]]), _blobs((pairs - number[first][:, None]).astype("<i8"), fence)


def merge(pairs: np.ndarray) -> np.ndarray:
    """Maximal spans of sorted (start, stop) pairs; touching ones are joined."""
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.r_[True, pairs[1:, 0] > reach[:-1]]
    first = np.flatnonzero(new)
    return np.stack([pairs[first, 0], reach[np.r_[first[1:] - 1, len(pairs) - 1]]], axis=1)


def _tied(group: np.ndarray) -> np.ndarray:
    same = np.r_[False, group[1:] == group[:-1]]
    return same | np.r_[same[1:], False]


def _groups(marks: np.ndarray) -> np.ndarray:
    return np.cumsum(marks) - marks[0] if len(marks) else np.zeros(0, np.int64)


def quicksort_shallow(characters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings by their first characters and a group number for each place, ties undecided.

    Each pass partitions only the groups whose members still differ, by their next character.
    """
    order = np.argsort(characters[0])
    now = characters[0][order]
    mark = np.r_[False, now[1:] != now[:-1]]
    for character in characters[1:]:
        group = _groups(mark)
        tied = np.flatnonzero(_tied(group))
        if not len(tied):
            break
        value, node = character[order[tied]], group[tied]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        count = np.diff(np.r_[first, len(node)])
        differs = np.repeat(np.logical_or.reduceat(value != np.repeat(value[first], count), first), count)
        places, value, node = tied[differs], value[differs], node[differs]
        inner = np.lexsort((value, node))
        order[places] = order[places][inner]
        value = value[inner]
        mark[places[1:]] |= (value[1:] != value[:-1]) & (node[1:] == node[:-1])
    return order, _groups(mark)


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    """Equal bytes at the front of two strings whose difference (not zero) is ``x``."""
    count = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        low = x >> np.uint64(64 - shift) == 0
        count += low * (shift // 8)
        x = np.where(low, x << np.uint64(shift), x)
    return count


def blind_tries(rest: list[np.ndarray], at: list[int], width: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of tied strings, and groups of equal ones.

    ``rest`` holds, for the byte offsets ``at``, the eight bytes of every string there as a number; together they
    cover ``width`` bytes. ``group`` is ascending. A group is a trie node: its branch depth is the shortest prefix
    that members share with its first, and only the byte there is looked at. Nodes whose members share
    everything are leaves.
    """
    n = len(group)
    order, mark = np.arange(n), np.r_[False, group[1:] != group[:-1]]
    open_ = np.flatnonzero(_tied(group))
    while len(open_):
        own, node = order[open_], _groups(mark)[open_]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        count = np.diff(np.r_[first, len(node)])
        head = np.repeat(own[first], count)
        common, undecided = np.full(len(own), width, np.int64), np.arange(len(own))
        for word, offset in zip(rest, at):
            unlike = word[own[undecided]] ^ word[head[undecided]]
            found = unlike != 0
            common[undecided[found]] = offset + _leading_zero_bytes(unlike[found])
            undecided = undecided[~found]
        branch = np.minimum.reduceat(common, first)
        grow = np.repeat(branch < width, count)
        if not grow.any():
            break
        depth = np.repeat(branch, count)[grow]
        places, own, node = open_[grow], own[grow], node[grow]
        slot = np.searchsorted(at, depth, side="right") - 1
        byte = np.zeros(len(own), np.uint8)
        for k, offset in enumerate(at):
            here = np.flatnonzero(slot == k)
            byte[here] = rest[k][own[here]] >> (np.uint64(56) - (8 * (depth[here] - offset)).astype(np.uint64)) & np.uint64(255)
        inner = np.lexsort((byte, node))
        order[places] = own[inner]
        byte = byte[inner]
        mark[places[1:]] |= (byte[1:] != byte[:-1]) & (node[1:] == node[:-1])
        group = _groups(mark)
        open_ = places[_tied(group[places])]
    return order, _groups(mark)


def repeated_windows(raw: np.ndarray, start: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Which windows also start in a smaller document; ``start`` are positions in ``raw``."""
    depth = 8 * min(SHALLOW, length // 8)
    eight = _load8(raw, big=True)
    order, group = quicksort_shallow([eight[start + k] for k in range(0, depth, 8)])
    tied = np.flatnonzero(_tied(group))
    if len(tied) and depth < length:
        own = order[tied]
        at = [*range(depth, length - 8, 8), length - 8]
        inner, fine = blind_tries([eight[start[own] + k] for k in at], [k - depth for k in at], length - depth, group[tied])
        order[tied] = own[inner]
        mark = np.r_[False, group[1:] != group[:-1]]
        mark[tied] |= np.r_[False, fine[1:] != fine[:-1]]
        group = _groups(mark)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(docs[order], first), np.diff(np.r_[first, len(group)]))
    repeated = np.zeros(len(start), bool)
    repeated[order] = docs[order] > least
    return repeated


def _sort_part(raw: np.ndarray, size: np.ndarray, docs: np.ndarray, at: np.ndarray, length: int) -> tuple[pa.Array, pa.Array]:
    """Repeated spans of each document among stretches that lie one behind the other in ``raw``."""
    base = np.cumsum(size) - size
    same = _repeats(raw, base, size, docs, at)  # copies of a stretch are settled by its first one
    settled, rest = np.flatnonzero(same), np.flatnonzero(~same)
    windows = size[rest] - length + 1
    which = np.repeat(rest, windows)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    repeated = np.flatnonzero(repeated_windows(raw, base[which] + inner, docs[which], length))
    which, begin = which[repeated], (at[which] + inner)[repeated]
    begin, end = np.r_[begin, at[settled]], np.r_[begin + length, at[settled] + size[settled]]
    return _spans_of(docs[np.r_[which, settled]], begin, end)


def _sort_bucket(length: int):
    def run(key, part):
        part, passed = _parts(part)
        if not part.num_rows:
            return _pairs(pa.nulls(0, pa.int64()), pa.nulls(0, pa.binary()), "spans", passed)
        join = lambda name, how: np.concatenate([how(x) for x in part.column(name).to_pylist()])
        sizes = [np.frombuffer(x, "<u4") for x in part.column("sizes").to_pylist()]
        size = np.concatenate(sizes).astype(np.int64)
        raw = np.frombuffer(b"".join(
            pa.decompress(x, int(z.sum()), "zstd", asbytes=True) for x, z in zip(part.column("bytes").to_pylist(), sizes)), np.uint8)
        docs, at = join("docs", _numbers), join("starts", lambda x: np.frombuffer(x, "<u8")).astype(np.int64)
        base, number = np.cumsum(size) - size, join("parts", lambda x: np.frombuffer(x, np.uint8))
        found = [passed.select(["doc", "spans"])]
        for k in np.flatnonzero(np.bincount(number)):
            own = np.flatnonzero(number == k)
            stop = np.cumsum(size[own])
            body = raw[np.repeat(base[own] - (stop - size[own]), size[own]) + np.arange(stop[-1])]
            found.append(pa.table(_sort_part(body, size[own], docs[own], at[own], length), names=["doc", "spans"]))
        return pa.concat_tables(found)

    return run


def _finish(with_bytes: bool, length: int = 50, firsts: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut(batch, with_bytes, length, _first(batch, firsts))

    return run


def _cut(batch: pa.RecordBatch, with_bytes: bool, length: int, first: np.ndarray) -> pa.RecordBatch:
    raw, off = spans.text_bytes(batch.column(1))
    removed, runs, digest, kept = [], [], [], []
    for i, found in enumerate(batch.column(2).to_pylist()):
        body = raw[off[i]: off[i + 1]]
        pairs = np.zeros((0, 2), np.int64)
        if found:
            pairs = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in found])
            pairs = merge(pairs[np.argsort(pairs[:, 0], kind="stable")])
        elif not first[i] and len(body) >= length:
            pairs = np.array([[0, len(body)]])
        keep = np.ones(len(body), bool)
        for a, b in pairs:
            keep[a:b] = False
        rest = body[keep].tobytes()
        removed.append(len(body) - len(rest))
        runs.append([{"start": int(a), "stop": int(b)} for a, b in pairs])
        digest.append(hashlib.sha256(rest).hexdigest())
        if with_bytes:
            kept.append(rest)
    columns = [
        batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()),
        pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(digest, pa.string())]
    names = ["doc", "n_bytes", "n_removed", "spans", "kept_sha256"]
    return pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())], [*names, "kept"]) if with_bytes else pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, with_bytes: bool = True,
    hot: int = HOT,
) -> DataFrame:
    """One row per document row: ``doc``, ``n_bytes``, ``n_removed``, ``spans``, ``kept_sha256`` and, unless
    declined, ``kept`` (bytes).

    Bytes covered by a ``length``-byte string that also starts in a document with a smaller id are removed;
    strings are judged on the whole input and never cross documents. Null is empty. Ids are integers; a null
    id counts as the smallest. Rows that repeat an id do not remove each other's bytes. ``length`` is at least 16.
    Anchors with more than ``hot`` stretches (or eight times the mean of a slot, if that is more) do not meet in one bucket;
    the setting changes no result.
    """
    if length < ANCHOR:
        raise ValueError(f"length must be at least {ANCHOR}")
    spark = docs.sparkSession
    arrow_batches(spark, rows=4000)
    # Without nulls the two joins read the same shuffle of the texts.
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    plain = docs.select(doc.alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = cut(plain.groupBy(F.unhex(F.sha2("text", 256)).alias("digest")).agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.octet_length("text")).alias("size")), "texts")
    firsts = first_documents(texts)  # copies are worth no work, and would make common anchors of rare ones
    total = texts.agg(F.sum("size")).first()[0] or 0
    buckets = 1 << max(4, (total // BUCKET_BYTES).bit_length())
    often = hot_slots(plain, length, max(hot, 16 * total // ((length - ANCHOR + 2) << SLOT_BITS)), firsts)
    report = plain.mapInArrow(
        spans.tidy(_report(length, buckets, often, firsts)), "bucket long, heads binary, docs binary, many binary, doc long, keys binary")
    told = report.groupBy("bucket").applyInArrow(_shared, "doc long, keys binary").groupBy("doc").agg(F.collect_list("keys").alias("keys"))
    sent = plain.join(told, "doc", "left").where(F.size("keys") > 0).select("doc", "text", "keys").mapInArrow(
        spans.tidy(_send(length, buckets, often)),
        "bucket long, bytes binary, sizes binary, docs binary, starts binary, parts binary, doc long, spans binary")
    found = sent.groupBy("bucket").applyInArrow(_sort_bucket(length), "doc long, spans binary")
    found = found.groupBy("doc").agg(F.collect_list("spans").alias("spans"))
    out = plain.join(found, "doc", "left").select("doc", "text", "spans").mapInArrow(
        spans.tidy(_finish(with_bytes, length, firsts)),
        "doc long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string" + ", kept binary" * with_bytes)
    return out.withColumn("doc", F.nullif("doc", F.lit(NO_ID)))
