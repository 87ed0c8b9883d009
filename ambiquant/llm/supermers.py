"""Removal of repeated word windows: super-k-mers dealt by minimiser, counted by sorting.

A window is WINDOW consecutive words of one document.  A word is removed if a window that
covers it also starts earlier: in a document with a smaller doc_id, or in the same one at
a smaller word number.

1. The minimiser of a window is the smallest hash of the GRAM-word strings inside it, so
   equal windows have equal minimisers.  Consecutive windows that share one, at one place,
   form a super-k-mer.  Blocks of documents ask how many super-k-mers each minimiser has; the
   windows of one that is alone cannot repeat and stay at home, which loses nothing.
2. The others travel as one packed string of words to the bucket of their minimiser, once
   a block however many of its documents hold it.  Windows of a minimiser with HOT
   super-k-mers or more are dealt by a hash of the whole window instead: equal windows still
   meet, and no bucket gets all surroundings of a frequent phrase.
3. A bucket turns words into exact numbers (no hashes), sorts windows by doubling (pairs
   of words, of pairs, ...) and so has groups of equal windows, their counts and the first place of each.
4. A bit for each window goes back to the block, which covers words.

Nothing is collected; a task holds a block or a bucket.  The plan has no cached or
checkpointed part: a lost executor's work is done again from the input.

Defined results: null texts have no words; documents with a null doc_id neither lose words
nor make others lose any; rows of one doc_id are one document, so of two equal windows
the one with the smaller word number in its row stays, and both if those are equal (repeated
rows are treated alike); empty tables give empty results; other columns are ignored by
`remove_windows` and kept by `dedup_documents`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambiquant.llm.blocks import aligned, ask, bodies, group_starts, in_blocks, mix64, ordered, release, short_keys
from ambiquant.llm.session import unused

#: Words of a window and of the strings whose smallest hash is its minimiser.
WINDOW, GRAM = 20, 8
#: Super-k-mers of a minimiser from which on its windows are dealt by the whole window.
HOT = 512
#: Windows in a packed string at most; longer ones are cut and overlap by WINDOW - 1 words.
LONGEST = 4096
#: Words that are hashed at a time, and bytes of a word from which on it is hashed by itself.
STEP, WIDE = 1 << 15, 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word flat[start:end]; flat has 8 spare bytes at its end."""
    size = ends - starts
    eight = np.lib.stride_tricks.as_strided(flat, shape=(len(flat) - 7, 8), strides=(1, 1))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    h = size.astype(np.uint64) * _ODD
    at = np.arange(len(starts))
    for k in range(0, WIDE, 8):
        at = at[size[at] > k] if k else at
        if not len(at):
            break
        piece = eight[starts[at] + k].view(np.uint64).ravel() & masks[np.minimum(size[at] - k, 8)]
        x = (h[at] ^ piece) * np.uint64(0xBF58476D1CE4E5B9)
        h[at] = x ^ (x >> np.uint64(29))
    for i in np.nonzero(size > WIDE)[0].tolist():
        h[i] = int.from_bytes(hashlib.blake2b(flat[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix64(h)


def string_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each string of n words, from hashes of words, by doubling."""
    out, width, power, factor, left = None, 1, _ODD, np.uint64(1), n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:  # strings of this width go before the ones so far
                out = h if out is None else h[: len(out) - width] * factor + out[width:]
                factor = factor * power
            left >>= 1
            if left:
                h = h[:-width] * power + h[width:]
                width, power = 2 * width, power * power
    return mix64(out)


def smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values."""
    width, size = 1, len(x) - n + 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:size], x[n - width : n - width + size]) if width < n else x[:size]


class Block:
    """A block's documents as words in a row, with the super-k-mers of their windows."""

    def __init__(self, ids: list, texts: list[str], window: int):
        self.window = window
        # documents with the same words take part once, as the smallest one's; rows: id, place, whether it is another document's copy
        seen: dict[bytes, int] = {}
        self.ids: list = []
        self.norms: list[bytes] = []
        self.rows: list[tuple] = []
        sizes = []
        for i, t in zip(ids, texts):
            words = t.encode("utf-8", "surrogatepass").split()
            norm = b" ".join(words)
            k = seen.setdefault(norm, len(self.ids)) if i is not None else len(self.ids)
            if k == len(self.ids):
                self.ids.append(i)
                self.norms.append(norm)
                sizes.append(len(words))
            self.rows.append((i, k, i != self.ids[k]))
        self.sizes = np.array(sizes, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.raw = b" ".join([*(n for n in self.norms if n), b""])
        flat = np.frombuffer(self.raw + bytes(8), np.uint8)
        self.word_end = np.nonzero(flat == 32)[0]
        self.word_start = np.concatenate([[0], self.word_end[:-1] + 1]) if len(self.word_end) else self.word_end
        self.number = np.array([i or 0 for i in self.ids], dtype=np.int64)
        self.hashes = word_hashes(flat, self.word_start, self.word_end)
        self.start, self.length, self.key = self._supermers()

    def _supermers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of windows and minimiser of each super-k-mer; of equal minimisers in a window the first counts."""
        window, last = self.window, len(self.hashes) - self.window + 1
        gram = min(GRAM, window)
        starts, keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo in range(0, max(last, 0), STEP):
            hi = min(lo + STEP, last)
            h = short_keys(string_hashes(self.hashes[lo : hi + window - 1], gram))
            h = smallest(h | np.arange(len(h), dtype=np.uint64), window - gram + 1)  # the low 16 bits are the place
            first = np.ones(hi - lo, dtype=bool)
            np.not_equal(h[1:], h[:-1], out=first[1:])
            a, b = np.searchsorted(self.begins, [lo, hi])
            first[self.begins[a:b] - lo] = True
            at = np.nonzero(first)[0]
            starts.append(at + lo)
            keys.append(short_keys(h[at]))
            places.append((h[at] & np.uint64(0xFFFF)).astype(np.int64) + lo)
        start, key, place = np.concatenate(starts), np.concatenate(keys), np.concatenate(places)
        if not len(start):
            return start, start, key
        doc = np.searchsorted(self.begins, start, side="right") - 1
        # a super-k-mer that only a step cut goes on
        on = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
        start, key, doc = start[on], key[on], doc[on]
        length = np.minimum(np.append(start[1:], last), self.begins[doc + 1] - window + 1) - start
        good = (length > 0) & np.array([i is not None for i in self.ids], dtype=bool)[doc]
        return start[good], length[good], key[good]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimisers and how many super-k-mers each has here."""
        keys = np.sort(self.key)
        at = group_starts(keys)
        return keys[at], np.diff(np.append(at, len(keys))).astype(np.uint32)

    def strings(self, got: dict[int, bytes], buckets: int) -> tuple[dict[int, list[int]], list[bytes], list[list[int]]]:
        """Packed strings of windows that may repeat: bucket -> strings, the strings, and the first words of each in the block."""
        order = np.argsort(self.key, kind="stable")
        at = group_starts(self.key[order])
        found = np.empty(len(order), np.uint8)
        found[order] = np.repeat(aligned(got, np.dtype(np.uint8)), np.diff(np.append(at, len(order))))
        some, hot = np.nonzero(found == 1)[0], np.nonzero(found == 2)[0]
        start, length, key = self.start[some], self.length[some], self.key[some]
        if len(some):
            # neighbours with one minimiser (of short periods) travel together
            doc = np.searchsorted(self.begins, start, side="right") - 1
            at = np.nonzero(np.concatenate([[True], (start[1:] != start[:-1] + length[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))[0]
            start, length, key = start[at], np.add.reduceat(length, at), key[at]
        if len(hot):
            one = np.repeat(self.start[hot] - np.cumsum(self.length[hot]) + self.length[hot], self.length[hot]) + np.arange(self.length[hot].sum())
            start, length = np.concatenate([start, one]), np.concatenate([length, np.ones(len(one), np.int64)])
            key = np.concatenate([key, string_hashes(self.hashes, self.window)[one]])
            order = np.argsort(start, kind="stable")
            start, length, key = start[order], length[order], key[order]
        homes = (mix64(key) % np.uint64(buckets)).tolist()
        texts, places = [], []
        seen: dict[tuple[int, bytes], int] = {}
        by: dict[int, list[int]] = {}
        for s, n, home in zip(start.tolist(), length.tolist(), homes):
            for cut in range(0, n, LONGEST):
                w = s + cut
                text = self.raw[self.word_start[w] : self.word_end[s + min(cut + LONGEST, n) + self.window - 2]]
                i = seen.setdefault((home, text), len(texts))
                if i == len(texts):
                    texts.append(text)
                    places.append([w])
                    by.setdefault(home, []).append(i)
                else:
                    places[i].append(w)
        return by, texts, places

    def owners(self, words: list[int]) -> list[tuple[int, int]]:
        """doc_id and word number of words of the block."""
        doc = np.searchsorted(self.begins, words, side="right") - 1
        return list(zip(self.number[doc].tolist(), (np.array(words) - self.begins[doc]).tolist()))


def _count(starts: np.ndarray, notes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of each minimiser: 0 if it has one super-k-mer, 1 if several, 2 if HOT or more."""
    n = np.add.reduceat(notes.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    return (n > 1).astype(np.uint8) + (n >= HOT).astype(np.uint8)


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return np.unique(high * (low.max(initial=0) + 1) + low, return_inverse=True)[1]


def window_groups(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of packed strings: its group of equal windows, its string, its word number there."""
    lists = pc.split_pattern(pa.array(strings, pa.large_binary()), b" ")
    words = lists.flatten()
    rank = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    del lists, words
    out, left, width = None, window, 1
    while left:
        if left & 1:
            out = rank if out is None else _ranks(rank[: len(out) - width], out[width:])
        left >>= 1
        if left:
            rank = _ranks(rank[:-width], rank[width:])
            width *= 2
    counts = sizes - window + 1
    string = np.repeat(np.arange(len(strings)), counts)
    place = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    return out[place + np.repeat(np.cumsum(sizes) - sizes, counts)], string, place


def later(parts: list[tuple[bytes, np.ndarray]], window: int) -> list[np.ndarray]:
    """parts: packed strings (joined by newlines) and, for each string, its doc_id and first word number.

    Returns for each part a bit for each of its windows: whether an equal one starts earlier.
    """
    strings = [body.split(b"\n") for body, _ in parts]
    owner = np.concatenate([o.reshape(-1, 2) for _, o in parts])
    group, string, place = window_groups([s for part in strings for s in part], window)
    number, at = owner[string, 0], owner[string, 1] + place
    order = np.lexsort((at, number, group))
    first = group_starts(group[order])
    each = np.diff(np.append(first, len(order)))
    number, at = number[order], at[order]
    gone = np.empty(len(order), bool)
    gone[order] = (number > np.repeat(number[first], each)) | (at > np.repeat(at[first], each))
    part = np.repeat(np.arange(len(parts)), [len(s) for s in strings])[string]
    return np.split(gone, np.searchsorted(part, np.arange(1, len(parts))))


def _covered(docs: DataFrame, window: int, result, schema: str) -> DataFrame:
    if window < 1:
        raise ValueError("a window has one word at least")
    blocks, n = in_blocks(docs)
    buckets = 2 * n  # super-k-mers overlap, so a bucket gets more bytes than its share of the text

    def ask_keys(ids: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return Block(ids, texts, window).keys()

    keys = ask(blocks, ask_keys, _count, n, 1)

    def pack(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
        block = Block(*ordered(table), window)
        by, texts, places = block.strings(bodies(said).get(1, {}), buckets)
        rows = []
        for home in sorted(by):
            owners = [min(block.owners(places[i])) for i in by[home]]
            rows.append((home, b"\n".join([texts[i] for i in by[home]]), np.array(owners, np.int64).tobytes()))
        del block, by, texts, places
        release()
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "strings": pa.array([r[1] for r in rows], pa.binary()),
                "owners": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    sent = blocks.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(pack, "bucket int, block int, strings binary, owners binary")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        got = later([(s, np.frombuffer(o, np.int64)) for s, o in zip(table.column("strings").to_pylist(), table.column("owners").to_pylist())], window)
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
        block, got = Block(*ordered(table), window), bodies(said)
        by, texts, places = block.strings(got.get(1, {}), buckets)
        hit = np.zeros(len(block.hashes) + 1, dtype=bool)  # windows that are removed
        for home, members in by.items():
            counts = np.array([texts[i].count(b" ") + 2 - window for i in members])
            ats = np.cumsum(counts) - counts
            mask = np.unpackbits(np.frombuffer(got[2][home], np.uint8)).view(bool)
            found = np.nonzero(mask)[0]
            which = np.searchsorted(ats, found, side="right") - 1
            hit[found - ats[which] + np.array([places[i][0] for i in members])[which]] = True
            for at, count, i in zip(ats.tolist(), counts.tolist(), members):
                if len(places[i]) > 1:
                    # a string of several places: only the first, and what ties with it, may keep windows
                    own = block.owners(places[i])
                    least = min(own)
                    for p, o in zip(places[i], own):
                        hit[p : p + count] = True if o > least else mask[at : at + count]
        total = np.concatenate([np.zeros(window, np.int64), np.cumsum(hit[:-1])])
        gone = total[window:] > total[: len(block.hashes)]
        out = result(block, gone)
        del block, gone, got, hit, total
        release()
        return out

    return blocks.groupBy("block").cogroup(keys.unionByName(bits).groupBy("block")).applyInArrow(cover, schema)


def _kept(block: Block, gone: np.ndarray) -> list[tuple[int, np.ndarray, bytes]]:
    """Of each row: words, a mask of those that are removed, and the others joined by a space."""
    out: list[tuple[int, np.ndarray, bytes]] = []
    for _, k, other in block.rows:
        n, norm = int(block.sizes[k]), block.norms[k]
        mask = np.full(n, n >= block.window) if other else gone[block.begins[k] : block.begins[k + 1]]
        if mask.any():
            norm = b" ".join([w for w, m in zip(norm.split(b" "), mask.tolist()) if not m])
        out.append((n, mask, norm))
    return out


def _table(block: Block, columns: dict[str, tuple[pa.DataType, list]]) -> pa.Table:
    return pa.table({"doc_id": pa.array([r[0] for r in block.rows], pa.int64())} | {c: pa.array(v, t) for c, (t, v) in columns.items()})


DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of the words left, joined by a space."""

    def result(block: Block, gone: np.ndarray) -> pa.Table:
        rows = [(n, int(m.sum()), hashlib.sha256(kept).hexdigest()) for n, m, kept in _kept(block, gone)]
        return _table(block, {c: (pa.string() if k == 2 else pa.int64(), [r[k] for r in rows]) for k, c in enumerate(["n_words", "n_removed", "kept_sha256"])})

    return _covered(docs, window, result, DIGEST)


def remove_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of `digest`, kept_text, spans of removed words (start, end by word number) and text_words, a digest of the
    row's own words."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def result(block: Block, gone: np.ndarray) -> pa.Table:
        rows = []
        for (_, k, _), (n, mask, kept) in zip(block.rows, _kept(block, gone)):
            edges = np.nonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))[0]
            spans = [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
            rows.append((n, int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), spans, hashlib.sha256(block.norms[k]).hexdigest()))
        names = ["n_words", "n_removed", "kept_sha256", "kept_text", "spans", "text_words"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), span, pa.string()]
        return _table(block, {c: (kinds[k], [r[k] for r in rows]) for k, c in enumerate(names)})

    return _covered(docs, window, result, DIGEST + ", kept_text string, spans array<struct<start:bigint,end:bigint>>, text_words string")


def dedup_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated windows cut from `text`; texts that lose words have the others joined by a space.

    n_chars, if there is such a column, is counted anew.  Documents that lose everything
    stay, with an empty text.
    """
    number, words, kept = unused(docs, "_id", "_words", "_kept")
    cut = remove_windows(docs, window).filter("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias(number), F.col("text_words").alias(words), F.col("kept_text").alias(kept)).dropDuplicates([number, words])
    own = F.sha2(F.encode(F.array_join(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), " "), "UTF-8"), 256)
    d = docs.join(cut, (F.col("doc_id") == F.col(number)) & (own == F.col(words)), "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast("bigint"))
    return d.select(*docs.columns)
