"""Prefix trie of conversations by whole-sequence collapse.

1. Conversations are rebuilt as turn signatures: no text moves. A turn's place in the order comes from
   ``ordered_columns``, which splits a conversation that holds a large share of all rows.
2. A prefix is named by its depth and 128 bits: the exclusive-or of hashes of (place, signature), which pieces of
   a long conversation compute apart.
3. Identical conversations collapse to one weighted sequence. Its end list (the ids of its members, ascending) is
   written in chunks by range and only streamed through SHA-256, so a sequence that a third of all
   conversations repeat is never gathered.
4. Sequences that are proper prefixes of others drop out by an anti join; the rest are the leaves.
5. Weighted prefixes are aggregated to nodes. What a subtree saves is the members' remaining bytes less the bytes
   of its distinct nodes. Every node belongs to the least leaf below it, and what a leaf owns is the lower end of
   its path, so distinct bytes are sums over leaves too. All steps are linear in the number of weighted prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phenoframe.llm import spans
from phenoframe.llm.session import arrow_batches, cut, partitions
from phenoframe.operators.ordered import ordered_columns

PIECE = 4096  # turns of one conversation that one task orders
CHUNK = 4096  # ids of an end list in one row
HEADS = 8  # most turns that a conversation takes over from another
NODE = ["depth", "a", "b"]


def signature(role, text) -> Column:
    """128 bits of SHA-256 over role and text; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16)


def _piece(place) -> Column:
    return F.floor((place - 1) / PIECE).cast("int")


def _pieces(length) -> Column:
    return F.explode(F.sequence(F.lit(0), _piece(F.greatest(length, F.lit(1)))))


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, sig, bytes): turns in order, null first; equal turn numbers by signature."""
    slim = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), signature(F.col(role), F.col(text)).alias("sig"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    return cut(ordered_columns(slim, ["conv"], ["turn", "sig"], number="place").select("conv", "place", "sig", "bytes"), "turns")


def spliced(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: (conv, place, sig, bytes) and (conv, length).

    Conversation c takes the first h turns of conversation c - c % 5 (all, if it has fewer), with h the CRC-32 of
    its decimal number modulo 9, and keeps its own turns after the first h.
    """
    sizes = cut(turns.groupBy("conv").agg(F.max("place").alias("n")).select(
        "conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h")), "sizes")
    others = sizes.select(F.col("conv").alias("base"), F.col("n").alias("m"))
    plan = sizes.join(others, "base", "left").select(
        "conv", "base", "h", "n", F.least("h", F.coalesce("m", F.lit(0))).alias("taken"))
    head = turns.where(F.col("place") <= HEADS).withColumnRenamed("conv", "base").join(
        plan.where("taken > 0").select("conv", "base", "taken"), "base").where("place <= taken").select("conv", "place", "sig", "bytes")
    own = turns.withColumn("piece", _piece(F.col("place"))).join(
        plan.where("n > h").select("conv", "h", "taken", _pieces(F.col("n")).alias("piece")), ["conv", "piece"])
    tail = own.where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "sig", "bytes")
    return head.unionByName(tail), plan.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, a, b, pa, pb, bytes, upto): every prefix's name, its parent's, and the running sum of bytes."""
    marked = turns.select(
        "conv", "place", _piece(F.col("place")).alias("piece"), "bytes",
        F.xxhash64("place", "sig").alias("x"), F.xxhash64(F.lit("second"), "place", "sig").alias("y"))
    key = ["conv", "piece"]
    sums = {"a": F.bit_xor("x"), "b": F.bit_xor("y"), "upto": F.sum("bytes")}
    running = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = marked.select(*key, "place", "bytes", "x", "y", *[v.over(running).alias(k) for k, v in sums.items()])
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = marked.groupBy(*key).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("bytes")).select(
        *key, *[v.over(earlier).alias(f"c_{k}") for k, v in sums.items()]).where("piece > 0")
    rows = inside.join(carry, key, "left")
    zero = F.lit(0).cast("long")
    a, b = (F.col(k).bitwiseXOR(F.coalesce(f"c_{k}", zero)) for k in ("a", "b"))
    return rows.select(
        "conv", "piece", F.col("place").alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"),
        b.bitwiseXOR(F.col("y")).alias("pb"), "bytes", (F.col("upto") + F.coalesce("c_upto", zero)).alias("upto"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of end lists from rows (depth, a, b, conv) in order: first id, number of ids, the joined ids."""
    names = [*NODE, "first", "n", "ids"]
    held, ids = None, []

    def chunk():
        return pa.RecordBatch.from_pylist([dict(zip(names, (*held, ids[0], len(ids), ",".join(map(str, ids)))))], schema=pa.schema(
            [(c, pa.int64()) for c in names[:-1]] + [("ids", pa.string())]))

    for batch in batches:
        for depth, a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (held != (depth, a, b) or len(ids) == CHUNK):
                yield chunk()
                ids = []
            held = (depth, a, b)
            ids.append(conv)
    if ids:
        yield chunk()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence from its chunks in order; only the state of the hash is held."""
    names = [*NODE, "weight", "rep", "ends_sha256"]
    schema = pa.schema([(c, pa.int64()) for c in names[:-1]] + [("ends_sha256", pa.string())])
    held, state, weight, rep = None, None, 0, 0
    for batch in batches:
        out = []
        for depth, a, b, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if held != (depth, a, b):
                if held is not None:
                    out.append(dict(zip(names, (*held, weight, rep, state.hexdigest()))))
                held, state, weight, rep = (depth, a, b), hashlib.sha256(), 0, first
            else:
                state.update(b",")
            state.update(ids.encode())
            weight += n
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*held, weight, rep, state.hexdigest())))], schema=schema)


def sequences(ends: DataFrame) -> DataFrame:
    """(depth, a, b, weight, rep, ends_sha256) of identical conversations from rows (depth, a, b, conv)."""
    spark = ends.sparkSession
    arrow_batches(spark)
    order = [*NODE, "conv"]
    ranged = ends.select(*order).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    longs = "depth long, a long, b long"
    chunks = cut(ranged.mapInArrow(spans.tidy(_chunks), f"{longs}, first long, n long, ids string"), "chunks")
    dealt = chunks.repartition(partitions(spark), *NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(spans.tidy(_digests), f"{longs}, weight long, rep long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of conversations.

    ``turns``: conv, place (from 1, gapless), sig, bytes; ``lengths``: conv, length of every conversation, also of
    those without turns. Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. No rows, no nodes.
    """
    zero = F.lit(0).cast("long")
    every = cut(prefixes(turns), "prefixes")
    last = every.join(lengths, "conv").where("depth = length").select(*NODE, "conv", F.col("upto").alias("total"))
    empty = lengths.where("length = 0").select(*(zero.alias(c) for c in NODE), "conv", zero.alias("total"))
    ends = cut(last.unionByName(empty), "ends")
    whole = cut(sequences(ends), "sequences")
    kept = whole.join(ends.select(F.col("conv").alias("rep"), "total"), "rep")
    rep = kept.select(F.col("rep").alias("conv"), "weight", "total", F.col("depth").alias("length"), F.struct(*NODE).alias("end"))
    root = rep.select(
        "conv", *(zero.alias(c) for c in NODE), *(F.lit(None).cast("long").alias(c) for c in ("pa", "pb")), zero.alias("bytes"),
        zero.alias("upto"), "weight", "total", "length", "end")
    paths = every.join(rep.withColumn("piece", _pieces(F.col("length"))), ["conv", "piece"]).drop("piece").unionByName(root)
    # Bytes of a path from this node on, itself included.
    paths = cut(paths.select("*", (F.col("total") - F.col("upto") + F.col("bytes")).alias("rest")).drop("upto", "total"), "paths")

    inner = paths.where("depth < length").select(*NODE).distinct()
    leaves = whole.join(inner, NODE, "left_anti").select(F.col("rep").alias("leaf"))
    marked = paths.join(leaves, paths["conv"] == leaves["leaf"], "left")
    nodes = cut(marked.groupBy(*NODE).agg(
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.count("leaf").alias("n_leaves"), F.sum(F.col("weight") * F.col("rest")).alias("all_bytes"),
        F.min(F.when(F.col("leaf").isNotNull(), F.struct("leaf", "rest"))).alias("owner")), "nodes")
    # Where a leaf's own part begins, and how many bytes it has.
    owned = nodes.groupBy(F.col("owner.leaf").alias("leaf")).agg(
        F.min(F.struct(F.col("depth").alias("top"), F.col("owner.rest").alias("own"))).alias("part")).select("leaf", "part.top", "part.own")
    paid = paths.join(owned, paths["conv"] == owned["leaf"]).groupBy(*NODE).agg(
        F.sum(F.when(F.col("depth") >= F.col("top"), F.col("rest")).otherwise(F.col("own"))).alias("distinct_bytes"))
    births = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children"))
    out = nodes.join(paid, NODE).join(births, NODE, "left").join(whole.select(*NODE, "ends_sha256"), NODE, "left")
    # The root, of which a large share of all nodes may be children, needs no join.
    top = F.broadcast(nodes.where("depth = 0").select(F.col("conv_id").alias("top_conv")))
    upper = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("up"))
    deep = out.where("depth > 1").join(upper, ["depth", "pa", "pb"], "left")
    high = out.where("depth <= 1").join(top, F.col("depth") == 1, "left").withColumnRenamed("top_conv", "up")
    return deep.unionByName(high).select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("all_bytes") - F.col("distinct_bytes")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of rebuilt conversations.

    Null role or text is empty. Turns are ordered by number, null first, and equal numbers by signature; repeated
    rows are turns of their own. Rows without a conversation take no part. Other columns are not read.
    """
    return trie(*spliced(ordered_turns(turns, conv, turn, role, text)))
