"""Blocks of documents and keyed exchanges between them.

Documents are dealt to blocks by a hash of their text, so copies meet.  A block can ask, for sorted keys of
its own, a question that needs all blocks ("how many documents hold this key?"): it sends
its distinct keys, packed, to buckets by key, each bucket merges what all blocks sent,
and answers come back aligned with what was sent.  What a block sends of one key is one
entry, however many of its documents hold the key, so a key in a third of all documents
costs one entry a block and no more.

Sizes follow from the bytes of all texts, not from a setting: a block has about BLOCK_BYTES,
a bucket BUCKET_BYTES.  What a block sends to a bucket should not fall below PIECE_BYTES, so
beyond about 16 GB both grow, with the square root of the input (at 100 TB to some 320 MB).
Workers give memory back to the system after each group.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one text from which on they are dealt over all blocks, and how many such texts may be broadcast.
HOT_COPIES, HOT_TEXTS = 256, 100_000
REPLY = "block int, kind int, bucket int, body binary"


#: Bytes of text in a block, of text behind what a bucket gets, and the least a block should send to a bucket.
BLOCK_BYTES, BUCKET_BYTES, PIECE_BYTES = 4 << 20, 4 << 20, 1 << 10


def plan_of(total: int, partitions: int) -> tuple[int, int]:
    """Numbers of blocks and of buckets for so many bytes of text."""
    least = math.isqrt(total * PIECE_BYTES)
    return max(partitions, -(-total // max(BLOCK_BYTES, least))), max(2 * partitions, -(-total // max(BUCKET_BYTES, least)))


def in_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, block, partitioned by block, equal texts in one block; and the number of buckets.

    Texts that HOT_COPIES rows or more share are dealt over all blocks by doc_id too, so
    no block gets a large group of copies.  Their hashes are broadcast if there are at
    most HOT_TEXTS of them, and joined otherwise.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("_h"))
    each = d.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("text")).alias("_b"))
    size = each.agg(F.sum("_b").alias("bytes"), F.count_if(F.col("_n") >= HOT_COPIES).alias("hot")).first()
    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks, buckets = plan_of(size["bytes"] or 0, partitions)
    salt = F.lit(0).cast("bigint")
    if size["hot"]:
        hot = d.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= HOT_COPIES).select(F.col("_h").alias("_hot"))
        d = d.join(F.broadcast(hot) if size["hot"] <= HOT_TEXTS else hot, F.col("_h") == F.col("_hot"), "left")
        salt = F.when(F.col("_hot").isNotNull(), F.xxhash64("doc_id")).otherwise(salt)
    d = d.select("doc_id", "text", F.pmod(F.xxhash64("_h", salt), F.lit(blocks)).cast("int").alias("block"))
    return d.repartition(partitions, "block"), buckets


def release() -> None:
    """Gives freed memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def ordered(table: pa.Table) -> tuple[list, list[str]]:
    """doc_ids and texts of a block, by doc_id and text; null ids come last, null texts are empty."""
    ids = table.column("doc_id").to_pylist()
    texts = [t or "" for t in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 0)):
        x ^= x >> np.uint64(shift)
        if factor:
            x *= np.uint64(factor)
    return x


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys start in sorted 64-bit keys: buckets are equal ranges of keys."""
    step = (1 << 64) // buckets + 1
    edges = np.array([min(i * step, (1 << 64) - 1) for i in range(buckets)], dtype=np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


def group_starts(x: np.ndarray) -> np.ndarray:
    return np.nonzero(np.concatenate([[True], x[1:] != x[:-1]]))[0] if len(x) else np.zeros(0, np.int64)


def short_keys(keys: np.ndarray) -> np.ndarray:
    """The 48 high bits of keys, which are what blocks ask by."""
    return keys & np.uint64(0xFFFF_FFFF_FFFF_0000)


def _short(keys: np.ndarray) -> bytes:
    """48-bit keys in ascending order: their steps in 4 bytes each, or, if a step is larger, keys in 6 bytes."""
    high = keys >> np.uint64(16)
    steps = np.diff(high)
    if len(high) and (not len(steps) or steps.max() < 1 << 32):
        return b"s" + high[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"k" + np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _long(body: bytes) -> np.ndarray:
    if body[:1] == b"s":
        steps = np.frombuffer(body, np.uint32, offset=9).astype(np.uint64)
        return np.cumsum(np.concatenate([np.frombuffer(body, np.uint64, 1, 1), steps])) << np.uint64(16)
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(body, np.uint8, offset=1).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def ask(
    blocks: DataFrame,
    keys_of: Callable[[list, list[str]], tuple[np.ndarray, np.ndarray]],
    answer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    n: int,
    kind: int,
    replies: DataFrame | None = None,
    note: type = np.uint32,
) -> DataFrame:
    """Replies (block, kind, bucket, body) to what the blocks ask.

    keys_of: of a block's ids and texts (and its replies so far), its sorted distinct keys
    (uint64, low 16 bits 0: 48 bits are sent) and a note for each.  answer: of the keys' group starts, the notes and
    the entries' order, an answer for each group, a numpy array of a fixed type.  The body
    of a reply holds an answer for each key sent, in the order sent.
    """

    def send(ids: list, texts: list[str], block: int, got: dict | None) -> pa.Table:
        keys, notes = keys_of(ids, texts) if got is None else keys_of(ids, texts, got)
        cuts = bucket_cuts(keys, n)
        at = [i for i in range(n) if cuts[i] < cuts[i + 1]]
        return pa.table(
            {
                "bucket": pa.array(at, pa.int32()),
                "block": pa.array([block] * len(at), pa.int32()),
                "keys": pa.array([_short(keys[cuts[i] : cuts[i + 1]]) for i in at], pa.binary()),
                "notes": pa.array([notes[cuts[i] : cuts[i + 1]].astype(note).tobytes() for i in at], pa.binary()),
            }
        )

    schema = "bucket int, block int, keys binary, notes binary"
    if replies is None:

        def first(key: tuple, table: pa.Table) -> pa.Table:
            out = send(*ordered(table), key[0].as_py(), None)
            release()
            return out

        sent = blocks.groupBy("block").applyInArrow(first, schema)
    else:

        def later(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
            out = send(*ordered(table), key[0].as_py(), bodies(said))
            release()
            return out

        sent = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(later, schema)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys = [_long(x) for x in table.column("keys").to_pylist()]
        notes = [np.frombuffer(x, note) for x in table.column("notes").to_pylist()]
        sizes = np.array([len(k) for k in keys])
        keys, notes = np.concatenate(keys), np.concatenate(notes)
        order = np.argsort(keys, kind="stable")
        starts = group_starts(keys[order])
        found = answer(starts, notes[order], keys[order])
        counts = np.diff(np.concatenate([starts, [len(keys)]]))
        back = np.empty(len(keys), dtype=found.dtype)
        back[order] = np.repeat(found, counts)
        ends = np.cumsum(sizes)
        del keys, notes, order
        release()
        return pa.table(
            {
                "block": table.column("block").cast(pa.int32()),
                "kind": pa.array([kind] * len(ends), pa.int32()),
                "bucket": table.column("bucket").cast(pa.int32()),
                "body": pa.array([back[e - s : e].tobytes() for e, s in zip(ends, sizes)], pa.binary()),
            }
        )

    return sent.groupBy("bucket").applyInArrow(merge, REPLY)


def bodies(said: pa.Table) -> dict[int, dict[int, bytes]]:
    """Replies of a block as kind -> bucket -> body."""
    out: dict[int, dict[int, bytes]] = {}
    for k, b, body in zip(said.column("kind").to_pylist(), said.column("bucket").to_pylist(), said.column("body").to_pylist()):
        out.setdefault(k, {})[b] = body
    return out


def aligned(got: dict[int, bytes], dtype: np.dtype) -> np.ndarray:
    """The answers of one kind, in the order of the block's sorted keys."""
    return np.frombuffer(b"".join(got[b] for b in sorted(got)), dtype=dtype)

