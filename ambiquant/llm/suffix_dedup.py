"""Removal of long repeated passages by merging Burrows-Wheeler transforms of shards.

Every byte that is covered by a string of SPAN bytes which also starts in a document
with a smaller doc_id is removed.  The decision is made on merged Burrows-Wheeler
transforms (BWT):

1. Places.  The smallest hash of the K-byte strings inside a SPAN-byte window is the
   window's anchor; equal windows have equal anchors.  Blocks ask in how many documents
   each anchor occurs.  Windows whose anchor is in one document only cannot repeat and
   are left out; this loses nothing, and holds for most of a corpus.
2. Shards.  The windows that are left are joined to strings and dealt to buckets by a
   key of their anchor that all blocks know: a label of the anchor's documents, so
   neighbouring windows go together, or, for anchors in HOT documents or more, the anchor
   itself.  Windows whose anchor is in HOTTER documents or more travel alone, dealt by a hash of the
   whole window: equal ones still meet, and no bucket gets all surroundings of a frequent
   phrase.  Strings of a block that are equal are sent once.  The strings of a block for a
   bucket are a shard, and what is sent of it is its multi-string BWT.
3. Merging.  A bucket merges the BWTs of its shards by refining the interleave of their
   suffixes: at first each shard's suffixes follow those of the shard before; after t
   rounds the interleave is sorted by the first t symbols.  A round reads, in the order
   of the interleave, the symbols that precede the suffixes, deals the suffixes by them
   stably and follows LF.  No suffix is compared again; a round takes two symbols, then
   four at a time.  Places where neighbours differ are carried along, so after SPAN symbols
   the intervals between them are the repeated SPAN-byte strings (common prefixes of at
   least SPAN), and the smallest document of each is known.
4. Answers.  A bit for each suffix goes back to the block, which covers bytes, merges
   spans and hashes what is left.

Nothing is collected; a task holds a block or a bucket.  The plan has no cached or
checkpointed part: a lost executor's work is done again from the input.

Defined results: null texts are empty; documents with a null doc_id neither lose bytes
nor make others lose any; rows of one doc_id are one document for "smaller", so they do
not take from each other; empty tables give empty results; extra columns are ignored
by `remove_repeats` and kept by `dedup_documents`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambiquant.llm.blocks import aligned, ask, bodies, bucket_cuts, group_starts, in_blocks, mix64, ordered, release, short_keys
from ambiquant.llm.session import unused

#: Length of a repeated string; 2 more than a multiple of 4.
SPAN = 50
#: Bytes of an anchor, a multiple of 8.  A window holds SPAN - K + 1 of them.
K = 24
#: Documents from which on an anchor's windows are dealt by the anchor alone, and from which on by the whole window.
HOT, HOTTER = 128, 4096
#: Windows in a string at most; longer runs are cut, and overlap by SPAN - 1 bytes.
LONGEST = 4096
#: Bytes of small shards that are put in order together.
TOGETHER = 1 << 16
#: Bytes that are hashed at a time; their arrays stay in a core's cache.
STEP = 1 << 15


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, the texts' starts, and runs of windows with one anchor.

    Runs: start (first window's first byte), length (windows), anchor.
    """
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    starts, lengths, anchors = [], [], []
    inside = SPAN - K + 1
    last = len(flat) - SPAN + 1
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    # texts' borders cut runs: windows over a border are no windows
    for lo in range(0, max(last, 0), STEP):
        hi = min(lo + STEP, last)
        part = padded[lo : hi + SPAN + 7]
        eight = np.lib.stride_tricks.as_strided(part, shape=(len(part) - 7, 8), strides=(1, 1))
        words = np.ascontiguousarray(eight).view(np.uint64).ravel()
        n = hi - lo + inside - 1
        h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, K, 8):
            h ^= h >> np.uint64(31)
            h += words[k : k + n]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        h = short_keys(h)
        width = 1
        while 2 * width <= inside:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < inside:
            h = np.minimum(h[: hi - lo], h[inside - width : inside - width + hi - lo])
        first = np.ones(hi - lo, dtype=bool)
        np.not_equal(h[1:], h[:-1], out=first[1:])
        a, b = np.searchsorted(begins, [lo, hi])
        first[begins[a:b] - lo] = True
        at = np.nonzero(first)[0]
        starts.append(at + lo)
        lengths.append(np.diff(np.concatenate([at, [hi - lo]])))
        anchors.append(h[at])
    if not starts:
        z = np.zeros(0, np.int64)
        return flat, begins, z, z, np.zeros(0, np.uint64)
    start, length, anchor = np.concatenate(starts), np.concatenate(lengths), np.concatenate(anchors)
    doc = np.searchsorted(begins, start, side="right") - 1
    length = np.minimum(length, ends[doc] - SPAN + 1 - start)
    good = length > 0
    return flat, begins, start[good], length[good], anchor[good]


def window_keys(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each window, from its words of 8 bytes (the last two overlap)."""
    rows = np.lib.stride_tricks.as_strided(flat, shape=(len(flat) - 7, 8), strides=(1, 1)) if len(flat) > 7 else np.zeros((0, 8), np.uint8)
    h = np.zeros(len(at), np.uint64)
    for k in (*range(0, SPAN - 8, 8), SPAN - 8):
        h = mix64(h ^ np.ascontiguousarray(rows[at + k]).view(np.uint64).ravel()) * np.uint64(0x9E3779B97F4A7C15)
    return h


def _label(ids: np.ndarray) -> np.ndarray:
    """A positive 31-bit label of a document."""
    return (mix64(ids.astype(np.uint64)) >> np.uint64(33)).astype(np.uint32) | np.uint32(1)


class Block:
    """A block's documents, with what its windows' anchors are."""

    def __init__(self, ids: list, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        # equal texts take part once, as the smallest document's; rows: id, place, whether it is another document's copy
        seen: dict[bytes, int] = {}
        self.ids: list = []
        self.texts: list[bytes] = []
        self.rows: list[tuple] = []
        for i, t in zip(ids, raw):
            k = seen.setdefault(t, len(self.ids)) if i is not None else len(self.ids)
            if k == len(self.ids):
                self.ids.append(i)
                self.texts.append(t)
            self.rows.append((i, k, i != self.ids[k]))
        self.flat, self.begins, self.start, self.length, self.anchor = runs_of(self.texts)
        doc = np.searchsorted(self.begins, self.start, side="right") - 1
        known = np.array([i is not None for i in self.ids], dtype=bool)
        if len(doc) and not known.all():
            good = known[doc]
            self.start, self.length, self.anchor, doc = self.start[good], self.length[good], self.anchor[good], doc[good]
        self.doc = doc
        self.number = np.array([i or 0 for i in self.ids], dtype=np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors; the note is a label of the documents (31 bits) and whether there are several.

        The label is the smallest of the documents' labels; its low bit is 1 if this block
        has the anchor in two documents or more.
        """
        order = np.argsort(self.anchor, kind="stable")
        anchors, numbers = self.anchor[order], self.number[self.doc[order]]
        at = group_starts(anchors)
        if not len(at):
            return anchors, np.zeros(0, np.uint32)
        several = np.minimum.reduceat(numbers, at) != np.maximum.reduceat(numbers, at)
        # one document is counted once for its neighbouring runs with one anchor
        fresh = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (numbers[1:] != numbers[:-1])])
        count = np.minimum(np.add.reduceat(fresh.astype(np.int64), at), 255).astype(np.uint32)
        label = np.minimum.reduceat(_label(numbers), at) >> np.uint32(9)
        return anchors[at], (label << np.uint32(9)) | (count << np.uint32(1)) | several.astype(np.uint32)

    def strings(self, got: dict[int, bytes], buckets: int) -> tuple[dict[int, list[int]], list[bytes], list[list[int]]]:
        """Strings of repeated windows: bucket -> strings, the strings, and where each starts in the block."""
        order = np.argsort(self.anchor, kind="stable")
        at = group_starts(self.anchor[order])
        found = aligned(got, np.dtype(np.uint64))
        key = np.empty(len(order), np.uint64)
        key[order] = np.repeat(found, np.diff(np.concatenate([at, [len(order)]])))
        sel = np.nonzero(key)[0]
        if not len(sel):
            return {}, [], []
        start, length, key, doc = self.start[sel], self.length[sel], key[sel], self.doc[sel]
        alone = (key >> np.uint64(63) == 1) & (key & np.uint64(1) == 1)
        if alone.any():
            n = length[alone]
            one = np.repeat(start[alone] - np.cumsum(n) + n, n) + np.arange(n.sum())
            start, length = np.concatenate([start[~alone], one]), np.concatenate([length[~alone], np.ones(len(one), np.int64)])
            # a key of its own for each window, so that none is joined to its neighbour
            key, doc = np.concatenate([key[~alone], window_keys(self.flat, one)]), np.concatenate([doc[~alone], np.repeat(doc[alone], n)])
            order = np.argsort(start, kind="stable")
            start, length, key, doc = start[order], length[order], key[order], doc[order]
        joins = np.concatenate([[True], (start[1:] != start[:-1] + length[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        at = np.nonzero(joins)[0]
        total = np.add.reduceat(length, at)
        raw, texts, places = self.flat.tobytes(), [], []
        seen: dict[tuple[int, bytes], int] = {}
        by: dict[int, list[int]] = {}
        homes = (mix64(key[at]) % np.uint64(buckets)).tolist()
        for s, n, home in zip(start[at].tolist(), total.tolist(), homes):
            for cut in range(0, n, LONGEST):
                text = raw[s + cut : s + min(cut + LONGEST, n) + SPAN - 1]
                i = seen.setdefault((home, text), len(texts))
                if i == len(texts):
                    texts.append(text)
                    places.append([s + cut])
                    by.setdefault(home, []).append(i)
                else:
                    places[i].append(s + cut)
        return by, texts, places


def _count(starts: np.ndarray, notes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of each anchor: 0 if in one document, else the key that its windows are dealt by."""
    blocks = np.diff(np.concatenate([starts, [len(notes)]]))
    documents = np.add.reduceat(((notes >> np.uint32(1)) & np.uint32(255)).astype(np.int64), starts)
    several = np.bitwise_or.reduceat(notes & np.uint32(1), starts).astype(bool) | (blocks > 1)
    label = np.minimum.reduceat(notes >> np.uint32(9), starts).astype(np.uint64) + np.uint64(1)
    own = keys[starts] | np.uint64(1 << 63) | (documents >= HOTTER).astype(np.uint64)
    return np.where(several, np.where(documents >= HOT, own, label), np.uint64(0))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of strings that end in 0; equal suffixes are ordered by place.

    Ranks by the first 8 symbols are doubled, only where they are not settled yet.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    open_ = np.ones(n, dtype=bool)
    for k in range(8):
        symbol = padded[k : k + n]
        key = (key << np.uint64(8)) | np.where(open_, symbol, 0).astype(np.uint64)
        open_ &= symbol != 0
    order = np.argsort(key)
    sorted_key, done = key[order], ~open_[order]
    ended = np.nonzero(done)[0]  # suffixes that end within 8 symbols: equal ones by place
    order[ended] = order[ended][np.lexsort((order[ended], sorted_key[ended]))]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) | done
    rank = np.empty(n, np.int64)
    place = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = place
    width = 8
    single = first & np.concatenate([first[1:], [True]])
    todo = np.nonzero(~single)[0]  # positions in order
    while len(todo):
        items = order[todo]
        pair = rank[items] * np.int64(n + 1) + rank[items + width]
        by = np.argsort(pair)
        items, pair = items[by], pair[by]
        order[todo] = items
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank_new = np.maximum.accumulate(np.where(new, todo, 0))
        rank[items] = rank_new
        alone = new & np.concatenate([new[1:], [True]])
        todo = todo[~alone]
        width *= 2
    return order


def transform(strings: list[bytes]) -> bytes:
    """Multi-string BWT: symbols are bytes plus 1 (UTF-8 has no 255), strings end in 0."""
    text = np.frombuffer(b"\xff".join([*strings, b""]), dtype=np.uint8) + np.uint8(1)
    order = suffix_order(text)
    return text[order - 1].tobytes()  # before the first symbol of a string stands the end of another


def transforms(shards: list[list[bytes]]) -> list[bytes]:
    """`transform` of each shard.  Small shards are put in order together and dealt to their own, so that the cost follows
    their bytes: a block has as many shards as there are buckets, so their number grows with the square of the input."""
    out: list[bytes] = []
    lo = 0
    while lo < len(shards):
        hi, size, sizes = lo, 0, []
        while hi < len(shards) and (hi == lo or size < TOGETHER):
            sizes.append(sum(map(len, shards[hi])) + len(shards[hi]))
            size += sizes[-1]
            hi += 1
        if hi == lo + 1:
            out.append(transform(shards[lo]))
        else:
            text = np.frombuffer(b"\xff".join([*(x for shard in shards[lo:hi] for x in shard), b""]), dtype=np.uint8) + np.uint8(1)
            order = suffix_order(text)
            home = np.repeat(np.arange(hi - lo, dtype=np.uint16 if hi - lo < 1 << 16 else np.int64), sizes)[order]
            raw, ends = text[order[np.argsort(home, kind="stable")] - 1].tobytes(), np.cumsum(sizes).tolist()
            out += [raw[end - n : end] for end, n in zip(ends, sizes)]
        lo = hi
    return out


def repeated(shards: list[tuple[bytes, np.ndarray]]) -> list[np.ndarray]:
    """Merges shards: their BWTs and their strings' documents.

    Returns for each shard a bit for each place of its text (strings in turn, ends
    included): whether a SPAN-byte string starts there that a smaller document has too.
    """
    sizes = np.array([len(b) for b, _ in shards])
    if sizes.sum() >= 1 << 31:
        raise OverflowError("a bucket of repeated passages is beyond 2 GB")
    bwt = np.frombuffer(b"".join(b for b, _ in shards), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    back = np.empty(len(bwt), dtype=np.int32)  # LF: place of the suffix that is longer by one symbol
    for o, n in zip(offsets.tolist(), sizes.tolist()):
        back[o + np.argsort(bwt[o : o + n], kind="stable")] = np.arange(o, o + n, dtype=np.int32)
    twice = back[back]
    pair = bwt[back].astype(np.uint32) << np.uint32(8) | bwt
    quad, fourth = pair[twice] << np.uint32(16) | pair, twice[twice]
    ends2 = (pair & np.uint32(0xFF) == 0) | (pair >> np.uint32(8) == 0)
    ends4 = ends2 | ends2[twice]
    # places and strings of all suffixes, by walking LF from the ends of all strings at once
    where, owner = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    counts = np.array([len(d) for _, d in shards])
    cur = np.concatenate([o + np.arange(c) for o, c in zip(offsets, counts)]).astype(np.int32)
    which = np.arange(len(cur), dtype=np.int32)
    steps = np.zeros(len(cur), dtype=np.int32)
    live, live_which, step = cur, which, 0
    while len(live):
        where[live], owner[live] = step, live_which
        more = bwt[live] != 0
        if not more.all():
            steps[live_which[~more]] = step
            live, live_which = live[more], live_which[more]
        live = back[live]
        step += 1
    string_at = np.cumsum(steps + 1) - (steps + 1)
    # what a round reads of a suffix lies together: symbols before it above, the longer suffix below, with a bit if that has no four symbols before it
    low, stop = np.uint64(0xFFFFFFFF), np.uint64(1 << 31)
    step2 = pair.astype(np.uint64) << np.uint64(32) | twice.astype(np.uint64) | ends4[twice] * stop
    step4 = quad.astype(np.uint64) << np.uint64(32) | fourth.astype(np.uint64) | ends4[fourth] * stop
    # the refinement: `now` lists suffixes in the order of the interleave
    now = np.nonzero(~ends2)[0]
    del back, twice, fourth, pair, quad, ends2, ends4
    group = np.zeros(len(now), np.int32)
    for at in range(2, SPAN + 1, 4):
        if not len(now):
            break
        read = (step2 if at == 2 else step4).take(now)
        # symbols above, order so far below: sorting these deals the suffixes stably
        dealt = (read & ~low) | np.arange(len(now), dtype=np.uint64)
        dealt.sort()
        by = (dealt & low).astype(np.int64)
        dealt >>= np.uint64(32)
        group = group.take(by)
        new = np.empty(len(by), dtype=bool)
        new[0] = True
        np.not_equal(dealt[1:], dealt[:-1], out=new[1:])
        new[1:] |= group[1:] != group[:-1]
        # a suffix that is alone in its group, or has no symbols before it, can repeat no more
        keep = ~new
        keep[:-1] |= ~new[1:]
        after = read.take(by)
        if at < SPAN:
            keep &= (after & stop) == 0
        group = np.cumsum(new, dtype=np.int32)[keep]
        now = (after[keep] & (stop - np.uint64(1))).astype(np.int64)
    bits = np.zeros(len(bwt), dtype=bool)
    if len(now):
        documents = np.concatenate([d for _, d in shards])[owner[now]]
        at = group_starts(group)
        least = np.repeat(np.minimum.reduceat(documents, at), np.diff(np.concatenate([at, [len(now)]])))
        bits[(string_at[owner[now]] + steps[owner[now]] - where[now])[documents > least]] = True
    return np.split(bits, np.cumsum(sizes)[:-1])


def _strings_keys(ids: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return Block(ids, texts).keys()


def _covered(docs: DataFrame, result, schema: str) -> DataFrame:
    blocks, buckets = in_blocks(docs)
    keys = ask(blocks, _strings_keys, _count, buckets, 1)

    def shards(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
        block = Block(*ordered(table))
        by, texts, places = block.strings(bodies(said).get(1, {}), buckets)
        homes = sorted(by)
        owners = block.number[np.searchsorted(block.begins, np.array([p[0] for p in places], np.int64), side="right") - 1].astype(np.int64)
        rows = [(home, bwt, owners[by[home]].tobytes()) for home, bwt in zip(homes, transforms([[texts[i] for i in by[home]] for home in homes]))]
        del block, by, texts, places
        release()
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "bwt": pa.array([r[1] for r in rows], pa.binary()),
                "owners": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    sent = blocks.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(shards, "bucket int, block int, bwt binary, owners binary")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        got = repeated([(b, np.frombuffer(d, np.int64)) for b, d in zip(table.column("bwt").to_pylist(), table.column("owners").to_pylist())])
        release()
        return pa.table(
            {
                "block": table.column("block").cast(pa.int32()),
                "kind": pa.array([2] * len(got), pa.int32()),
                "bucket": table.column("bucket").cast(pa.int32()),
                "body": pa.array([np.packbits(g).tobytes() for g in got], pa.binary()),
            }
        )

    bits = sent.groupBy("bucket").applyInArrow(merge, "block int, kind int, bucket int, body binary")

    def cover(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
        block, got = Block(*ordered(table)), bodies(said)
        by, texts, places = block.strings(got.get(1, {}), buckets)
        hit = np.zeros(len(block.flat) + 1, dtype=bool)  # windows that are removed
        for home, members in by.items():
            mask = np.unpackbits(np.frombuffer(got[2][home], np.uint8)).view(bool)
            sizes = np.array([len(texts[i]) + 1 for i in members])
            ats = np.cumsum(sizes) - sizes
            found = np.nonzero(mask)[0]
            which = np.searchsorted(ats, found, side="right") - 1
            hit[found - ats[which] + np.array([places[i][0] for i in members])[which]] = True
            for at, i in zip(ats.tolist(), members):
                if len(places[i]) > 1:
                    # a string of several places of this block: other documents than the first lose it
                    windows = len(texts[i]) - SPAN + 1
                    own = block.number[np.searchsorted(block.begins, places[i], side="right") - 1]
                    for p, number in zip(places[i][1:], own[1:]):
                        hit[p : p + windows] = True if number != own[0] else mask[at : at + windows]
        total = np.concatenate([np.zeros(SPAN, np.int32), np.cumsum(hit[:-1], dtype=np.int32)])
        gone = total[SPAN:] > total[: len(block.flat)]
        del hit, total
        out = result(block, gone)
        del block, gone, got
        release()
        return out

    replies = keys.unionByName(bits)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(cover, schema)


def _marks(block: Block, gone: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """Of each row: the bytes of its text, and a mask of what is removed."""
    ends = block.begins + np.array([len(t) for t in block.texts], dtype=np.int64)
    out = []
    for _, k, other in block.rows:
        raw = block.texts[k]
        out.append((raw, np.full(len(raw), len(raw) >= SPAN) if other else gone[block.begins[k] : ends[k]]))
    return out


def _row(raw: bytes, mask: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """Bytes removed, span edges (starts and ends in turn), and the bytes left."""
    n = int(np.count_nonzero(mask))
    if not n:
        return 0, np.zeros(0, np.int64), raw
    edges = np.nonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))[0]
    return n, edges, np.frombuffer(raw, np.uint8)[~mask].tobytes()


def _table(block: Block, columns: dict[str, tuple[pa.DataType, list]]) -> pa.Table:
    ids = pa.array([r[0] for r in block.rows], pa.int64())
    return pa.table({"doc_id": ids} | {c: pa.array(v, t) for c, (t, v) in columns.items()})


DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, without sending the kept bytes anywhere."""

    def result(block: Block, gone: np.ndarray) -> pa.Table:
        rows = [(len(raw), n, len(e) // 2, hashlib.sha256(kept).hexdigest()) for raw, m in _marks(block, gone) for n, e, kept in [_row(raw, m)]]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return _table(block, {c: (pa.string() if k == 3 else pa.int64(), [r[k] for r in rows]) for k, c in enumerate(names)})

    return _covered(docs, result, DIGEST)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The columns of `digest`, spans (start, end in bytes), kept_text and text_md5.

    kept_text is what is left as text; a character that lost some of its bytes is left out.
    text_md5 is that of the whole text where something was removed, else null.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def result(block: Block, gone: np.ndarray) -> pa.Table:
        rows = []
        for raw, m in _marks(block, gone):
            n, e, kept = _row(raw, m)
            spans = [{"start": a, "end": b} for a, b in e.reshape(-1, 2).tolist()]
            whole = hashlib.md5(raw, usedforsecurity=False).hexdigest() if n else None
            rows.append((len(raw), n, len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), spans, whole))
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans", "text_md5"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span, pa.string()]
        return _table(block, {c: (kinds[k], [r[k] for r in rows]) for k, c in enumerate(names)})

    return _covered(docs, result, DIGEST + ", kept_text string, spans array<struct<start:bigint,end:bigint>>, text_md5 string")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from `text`; a character that is cut in part goes whole.

    n_chars, if there is such a column, is counted anew.  Documents that lose everything
    stay, with an empty text.  Rows of one doc_id lose what their own text loses.
    """
    number, whole, kept = unused(docs, "_id", "_md5", "_kept")
    cut = remove_repeats(docs).filter("n_removed > 0").select(F.col("doc_id").alias(number), F.col("text_md5").alias(whole), F.col("kept_text").alias(kept))
    cut = cut.dropDuplicates([number, whole])
    d = docs.join(cut, (F.col("doc_id") == F.col(number)) & (F.md5("text") == F.col(whole)), "left")
    d = d.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast("bigint"))
    return d.select(*docs.columns)
