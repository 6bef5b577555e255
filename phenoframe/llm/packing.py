"""Best-fit-decreasing packing of token pieces into fixed windows.

Texts are tokenised in tasks, cut into full windows and one remainder, and dealt by a hash of (document,
start) to groups of bounded size. In a group a segment tree indexed by remaining capacity finds the
tightest open window for each remainder, longest first; groups are independent, so packing needs one
shuffle of small rows. Full windows fill a sequence each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenoframe.llm import spans
from phenoframe.llm.session import arrow_batches, cut

CAPACITY = 2048
GROUP_ROWS = 16384
KNOWN_PIECES = 600_000

_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[*range(9, 14), 32]] = _SPACE
# Bytes that may belong to a character outside ASCII and the Latin letters.
_HARD = np.zeros(256, bool)
_HARD[[0xC2, *range(0xCA, 0x100), *range(0x1C, 0x20)]] = True
_ENDINGS = {b"s": 2, b"t": 2, b"m": 2, b"d": 2, b"re": 3, b"ve": 3, b"ll": 3}


def piece_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start of every pre-token of byte-level BPE in texts of ASCII and Latin letters.

    Letters, digits and other signs form runs that take one preceding blank; the last white-space
    character before a run stands apart from those before it; an apostrophe takes its short ending.
    """
    kind = _CLASS[raw]
    new = np.zeros(len(raw) + 1, bool)
    new[off] = True
    start = new[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    follows = np.flatnonzero(start[1:] & ~new[1:-1] & (kind[:-1] == _SPACE)) + 1  # a run after white space
    start[follows - 1] = True
    start[follows[raw[follows - 1] == 32]] = False
    quote = np.flatnonzero((raw[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~new[1:-1])
    ends = np.append(off[1:], len(raw))
    for q in quote:
        limit = ends[np.searchsorted(off[1:], q, side="right")]
        size = _ENDINGS.get(bytes(raw[q + 1: min(q + 2, limit)])) or _ENDINGS.get(bytes(raw[q + 1: min(q + 3, limit)]))
        if size:
            start[q + 1] = False
            if q + size < limit:
                start[q + size] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Token ids of many texts at once: each distinct pre-token is encoded once and then looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that hold one of these are encoded whole, as it ends the pre-tokens round it.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.bank = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Index of each pre-token in the table; unknown ones are encoded and added."""
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > KNOWN_PIECES:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == distinct[inside]
        missing = np.flatnonzero(~known)
        if len(missing):
            ids = self._encode([bytes(raw[start[i]: end[i]]).decode() for i in first[missing]])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            at = len(self.bank) + np.cumsum(size) - size
            self.bank = np.concatenate([self.bank, np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))])
            where = place[missing]
            self.keys = np.insert(self.keys, where, distinct[missing])
            self.at = np.insert(self.at, where, at)
            self.size = np.insert(self.size, where, size)
            place = np.searchsorted(self.keys, distinct)
        return place[back]

    def _with_added(self, raw: np.ndarray, off: np.ndarray) -> set[int]:
        """Rows that hold an added token of the tokenizer."""
        text, found = raw.tobytes(), set()
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                row = int(np.searchsorted(off, at, side="right")) - 1
                if at + len(token) <= off[row + 1]:
                    found.add(row)
                    at = text.find(token, int(off[row + 1]))
                else:
                    at = text.find(token, at + 1)
        return found

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text in order."""
        rows = len(off) - 1
        odd = np.zeros(len(raw) + 1, np.int32)
        hard = _HARD[raw]
        hard[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
        np.cumsum(hard, out=odd[1:])
        hard_rows = set(np.flatnonzero(odd[off[1:]] > odd[off[:-1]]).tolist())
        hard_rows |= self._with_added(raw, off)
        start = piece_starts(raw, off) if len(raw) else np.zeros(0, np.int64)
        row = np.searchsorted(off, start, side="right") - 1
        if hard_rows:
            easy = ~np.isin(row, list(hard_rows))
            end = np.append(start[1:], len(raw))[easy]
            start, row = start[easy], row[easy]
        else:
            end = np.append(start[1:], len(raw))
        slot = self._slots(raw, start, end, spans.span_hashes(raw, start, end)) if len(start) else np.zeros(0, np.int64)
        size = self.size[slot]
        stop = np.cumsum(size)
        ids = self.bank[np.repeat(self.at[slot] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        fence = np.r_[0, np.cumsum(np.bincount(row, weights=size, minlength=rows).astype(np.int64))]
        for i in range(rows):
            if i in hard_rows:
                yield np.array(self._encode([bytes(raw[off[i]: off[i + 1]]).decode()])[0], np.uint32)
            else:
                yield ids[fence[i]: fence[i + 1]]


_encoders: dict[str, PieceEncoder] = {}


def encoder(name: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, given by path or by the name of an installed one."""
    if name not in _encoders:
        import os

        import public_tokenizers

        _encoders[name] = PieceEncoder(name if os.path.exists(name) else public_tokenizers.path(name))
    return _encoders[name]


def token_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """Cut every tokenised text into full windows and a remainder.

    Rows: ``doc``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if asked for, ``ids``. A null or
    empty text is its end token alone. Repeated rows are cut one by one.
    """
    arrow_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            raw, off = spans.text_bytes(batch.column(1))
            for i, j in spans.blocks(off):
                row, start, length, crc, total, kept = [], [], [], [], [], []
                texts = encode(raw[off[i]: off[j]], off[i: j + 1] - off[i])
                for r, ids in enumerate(texts, i):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), capacity):
                        part = ids[at: at + capacity]
                        row.append(r)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        total.append(len(ids))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(spans.tidy(cut_texts), schema)


class CapacityTree:
    """Segment tree over remaining capacities; a leaf holds the open windows with that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        node = room + self.leaves
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the (room, window) with the least room of at least ``need``."""
        node, tree = need + self.leaves, self.open
        while not tree[node]:
            while node & 1:  # a right child: the next leaf lies beyond the parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not tree[2 * node])
        room = node - self.leaves
        while node:
            tree[node] -= 1
            node >>= 1
        return room, self.at[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece, placed longest first into the tightest open window."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need) if need < capacity else None
        if found is None:
            found = (capacity, opened)
            opened += 1
        room, window[i] = found
        offset[i] = capacity - room
        if room > need:
            tree.add(room - need, int(window[i]))
    return window, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc``, ``start``, ``length`` of 1 to ``capacity``).

    Every piece keeps its row. Pieces of equal length go in the order of document and start, so
    the result depends on neither row order nor partitioning. No pieces, no sequences.
    """
    groups = max(1, -(-pieces.count() // group_rows))
    names = [f.name for f in pieces.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def fill(key, part):
        part = part.sort_by([("doc", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = best_fit(part.column("length").to_numpy(), capacity)
        base = key[0].as_py() << 32
        return part.select(names).append_column("sequence_id", pa.array(window + base)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc", "start"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Tokenise, cut and pack; see ``token_pieces`` and ``pack``."""
    capacity = options.get("capacity", CAPACITY)
    return pack(cut(token_pieces(docs, doc_id, text, **options), "pieces"), capacity)
