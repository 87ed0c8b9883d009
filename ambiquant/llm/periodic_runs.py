"""All maximal periodic runs of words in each document, by the longest previous factors of its suffix array.

A run is a stretch of words with smallest period q and length >= max(least, 2 q) that no
neighbouring word extends with that period.  Documents are worked on where they lie (no
shuffle), many short ones at a time, each ended by a symbol of its own so that nothing
crosses a border:

1. Suffix array by doubling, only where order is open.  Common prefixes (LCP) are compared
   only at places whose preceding symbols differ; elsewhere they are one less than at the
   place before.
2. Longest previous factors (LPF): nearest suffixes in the order that start earlier in the text, found by
   jumping over those that do not, with the smallest LCP on the way.
3. Blocks (LZ factors) by leaps of LPF.  A run that touches no border of blocks is a copy of an
   earlier one.  Of a run that touches one, the last `length - q` words, at least half = least / 2, lie in at
   most two blocks, so it touches a border b of blocks of lengths u, v with u + v > half, and
   either q < u + v with a whole period before b, or q < v with a whole period after it.
   Those periods are tried (Main's extension to both sides of b): one side matches for half of `half` words, which is
   looked at for all borders at once; then extensions are measured.  A multiple of a period whose run covers both
   places has the same extensions, and is passed over.
4. Runs inside a block are copied from the block's earlier occurrence, in order of their
   starts, by buckets of runs with one start.

Work is near linear in words, memory some 200 bytes a word of a group of documents
(GROUP words, or one document if that is longer: a document is one row and is not split).

Defined results: a null or empty text has no words and no runs (start, length, period and
exponent_milli are null); a null doc_id is kept as it is; repeated rows give repeated rows;
ties for the longest run go to the smallest start, then period; other columns are ignored
by `find_runs` and `digest` and kept by `collapse_documents`; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambiquant.llm.blocks import release

#: Least length of a run in words, words of documents that are worked on together, and pairs of places compared at a time.
LEAST, GROUP, PAIRS = 12, 1 << 17, 1 << 20
#: Words that all pairs are compared by before the rest go one by one, and rounds of jumps before the rest do.
AHEAD, ROUNDS = 16, 48


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of all suffixes; symbols that end a document occur once."""
    n = len(x)
    rank = np.append(x, 0).astype(np.int64)
    key = rank[:-1] * np.int64(x.max() + 1) + rank[1:]
    order, width = np.argsort(key, kind="stable"), 2
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    todo = np.nonzero(~(first & np.append(first[1:], True)))[0]
    while len(todo):
        items = order[todo]
        pair = rank[items] * np.int64(n + 1) + rank[items + width]
        by = np.argsort(pair, kind="stable")
        items, pair = items[by], pair[by]
        order[todo] = items
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[items] = np.maximum.accumulate(np.where(new, todo, 0))
        todo = todo[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def _reach(x: np.ndarray, i: int, j: int, step: int) -> int:
    """Symbols that agree from i and j on (step 1) or before them (step -1); the ends of documents never agree."""
    n, width = 0, 4 * AHEAD
    while True:
        if step > 0:
            a, b = x[i + n : i + n + width], x[j + n : j + n + width]
        else:
            a, b = x[max(0, i - n - width) : i - n][::-1], x[max(0, j - n - width) : j - n][::-1]
        m = min(len(a), len(b))
        differ = a[:m] != b[:m]
        if m == 0 or differ.any():
            return n + (int(differ.argmax()) if m else 0)
        n += m
        width *= 2


def _agree(x: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Symbols that agree from i and j on, or before them, AHEAD at most.  x begins and ends with symbols of their own."""
    n = np.zeros(len(i), np.int32)
    at = np.arange(len(i))
    shift = 0 if step > 0 else -1
    for k in range(AHEAD):
        at = at[x[i[at] + step * k + shift] == x[j[at] + step * k + shift]]
        if not len(at):
            break
        n[at] = k + 1
    return n


def common_prefixes(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP of each suffix, by place, with the one before it in the order."""
    before = np.empty_like(order)
    before[order[0]] = order[0]
    before[order[1:]] = order[:-1]
    own = np.ones(len(x), bool)
    own[1:] = x[:-1] != x[before[1:] - 1]
    own[order[0]] = True
    at = np.nonzero(own)[0]
    lcp = np.zeros(len(x), np.int32)
    pairs = at[at != order[0]]
    got = _agree(x, pairs, before[pairs], 1)
    for k in np.nonzero(got == AHEAD)[0].tolist():
        got[k] += _reach(x, int(pairs[k]) + AHEAD, int(before[pairs[k]]) + AHEAD, 1)
    lcp[pairs] = got
    last = np.maximum.accumulate(np.where(own, np.arange(len(x)), 0))
    return np.maximum(lcp[last] - (np.arange(len(x)) - last), 0).astype(np.int32)


def _earlier(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in the order: the nearest before it that starts earlier in the text, and the smallest LCP up to there.

    lcp[r] is that of r - 1 and r.  Where the LCP falls to 0 nothing is looked for any more.
    """
    jump, low = np.arange(-1, len(order) - 1), lcp.copy()
    jump[0], low[0] = 0, 0
    live = np.nonzero((low > 0) & (order[jump] > order))[0]
    for _ in range(ROUNDS):
        if not len(live):
            break
        via = jump[live]
        low[live], jump[live] = np.minimum(low[live], low[via]), jump[via]
        live = live[(low[live] > 0) & (order[jump[live]] > order[live])]
    for r in live.tolist():  # long ascents, in order: what a jump leads to is settled
        k, m, own = int(jump[r]), int(low[r]), int(order[r])
        while m and order[k] > own:
            m, k = min(m, int(low[k])), int(jump[k])
        jump[r], low[r] = k, m
    return jump, low


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LPF and an earlier occurrence of each place of the text."""
    ranked = lcp[order]
    left, a = _earlier(order, ranked)
    back = order[::-1]
    right, b = _earlier(back, np.concatenate([[0], ranked[:0:-1]]).astype(np.int32))
    right, b = len(order) - 1 - right[::-1], b[::-1]
    factor, source = np.empty(len(order), np.int32), np.empty(len(order), np.int64)
    factor[order], source[order] = np.maximum(a, b), order[np.where(a >= b, left, right)]
    return factor, source


def _at_borders(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """Runs (start, end) -> period that touch borders of blocks.  sizes: of blocks, 0 for the symbol that ends a document."""
    half = (least + 1) // 2
    some = (half + 1) // 2
    before = np.concatenate([[0], sizes[:-1]])
    doc = np.searchsorted(ends, starts)
    floor = np.concatenate([[1], ends[:-1] + 1])[doc]
    pick = np.nonzero(before + sizes > half)[0]
    b = starts[pick]
    lo = np.maximum(b - before[pick] - sizes[pick], floor[pick])
    hi = np.minimum(b + np.where(sizes[pick] > half, sizes[pick], 0), ends[doc[pick]])
    width = hi - lo + 1
    found: dict[tuple[int, int], int] = {}
    part = np.cumsum(width) // PAIRS
    for k in range(int(part[-1]) + 1 if len(part) else 0):
        sel = np.nonzero(part == k)[0]
        if not len(sel):
            continue
        w = width[sel]
        border = np.repeat(b[sel], w)
        other = np.arange(len(border)) - np.repeat(np.cumsum(w) - w - lo[sel], w)
        ahead, back = x[other] == x[border], x[other - 1] == x[border - 1]
        maybe = np.nonzero((ahead | back) & (other != border))[0]
        border, other = border[maybe], other[maybe]
        low, high = np.minimum(border, other), np.maximum(border, other)
        fore, rear = _agree(x, low, high, 1), _agree(x, low, high, -1)
        good = np.nonzero(np.maximum(fore, rear) >= some)[0]
        border, low, high, fore, rear = border[good], low[good], high[good], fore[good], rear[good]
        period = high - low
        open_ = (fore == AHEAD) | (rear == AHEAD)
        done = np.nonzero(~open_ & (period + fore + rear >= np.maximum(least, 2 * period)))[0]
        for s, e, q in zip((low - rear)[done].tolist(), (high + fore)[done].tolist(), period[done].tolist()):
            found[s, e] = min(q, found.get((s, e), q))
        rest = np.nonzero(open_)[0]
        rest = rest[np.lexsort((period[rest], border[rest]))]
        here, mine = -1, []
        for at, i, j, f, r in zip(border[rest].tolist(), low[rest].tolist(), high[rest].tolist(), fore[rest].tolist(), rear[rest].tolist()):
            if at != here:
                here, mine = at, []
            q = j - i
            if any(q % p == 0 and s <= i and j <= e for s, e, p in mine):
                continue
            f += _reach(x, i + f, j + f, 1) if f == AHEAD else 0
            r += _reach(x, i - r, j - r, -1) if r == AHEAD else 0
            s, e = i - r, j + f
            if e - s >= max(least, 2 * q):
                found[s, e] = min(q, found.get((s, e), q))
                mine.append((s, e, q))
    return found


def _copied(found: dict[tuple[int, int], int], blocks: list[tuple[int, int, int]]) -> None:
    """Adds runs inside blocks (start, size, earlier occurrence), of those inside the earlier occurrence."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, e), q in found.items():
        buckets.setdefault(s, []).append((e, q))
    order = sorted(buckets)
    for start, size, source in blocks:
        shift, k = start - source, bisect_right(order, source)
        while k < len(order) and order[k] < source + size:
            s = order[k]
            for e, q in buckets[s]:
                if e < source + size and (s + shift, e + shift) not in found:
                    found[s + shift, e + shift] = q
                    if s + shift not in buckets:
                        buckets[s + shift] = []
                        insort(order, s + shift)
                    buckets[s + shift].append((e + shift, q))
            k += 1


def runs_of(ids: np.ndarray, sizes: list[int], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, by start and period.  ids: word numbers of all documents in a row."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if not len(ids):
        return out
    # documents are told apart by their symbols: a document's words, then its end
    doc = np.repeat(np.arange(len(sizes)), sizes)
    symbols = np.unique(doc * np.int64(ids.max() + 1) + ids, return_inverse=True)[1] + len(sizes) + 1
    ends = np.cumsum(sizes) + np.arange(len(sizes)) + 1
    x = np.empty(len(ids) + len(sizes) + 1, np.int64)
    x[0] = 0
    x[ends] = np.arange(1, len(sizes) + 1)
    x[np.arange(len(ids)) + doc + 1] = symbols
    order = suffix_array(x)
    factor, source = previous_factors(order, common_prefixes(x, order))
    leap, starts, i = np.maximum(factor, 1).tolist(), [], 1
    while i < len(x):
        starts.append(i)
        i += leap[i]
    starts = np.array(starts, np.int64)
    blocks = np.diff(np.append(starts, len(x)))
    blocks[np.searchsorted(starts, ends)] = 0
    x32 = np.append(x, np.int64(-1))
    found = _at_borders(x32, starts, blocks, ends, least)
    if found:
        of = np.searchsorted(ends, np.array([s for s, _ in found]))
        with_runs = np.unique(of)
        large = np.nonzero(blocks >= least + 2)[0]
        large = large[np.isin(np.searchsorted(ends, starts[large]), with_runs)]
        _copied(found, list(zip(starts[large].tolist(), blocks[large].tolist(), source[starts[large]].tolist())))
        firsts = np.concatenate([[1], ends[:-1] + 1])
        edges = np.array([(s, e, q) for (s, e), q in found.items()])
        for d, (s, e, q) in zip(np.searchsorted(ends, edges[:, 0]).tolist(), edges.tolist()):
            out[d].append((s - int(firsts[d]), e - s, q))
        for r in out:
            r.sort(key=lambda t: (t[0], t[2]))
    return out


def _rows(docs: DataFrame, least: int, result: Callable[[list, list, list], pa.Table], schema: str) -> DataFrame:
    """result of ids, words (bytes) and runs of documents, group by group."""
    if least < 2:
        raise ValueError("a run has two words at least")

    def group(ids: list, words: list[list[bytes]]) -> list[pa.RecordBatch]:
        sizes = [len(w) for w in words]
        flat = pa.array([w for ws in words for w in ws], pa.large_binary())
        numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        del flat
        return result(ids, words, runs_of(numbers, sizes, least)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        words: list[list[bytes]] = []
        n = 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                w = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                if n and n + len(w) > GROUP:
                    yield from group(ids, words)
                    ids, words, n = [], [], 0
                ids.append(i.as_py())
                words.append(w)
                n += len(w)
        if ids:
            yield from group(ids, words)
        release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, schema)


def _longest(runs: list[tuple[int, int, int]]) -> tuple:
    if not runs:
        return None, None, None, None
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
    return s, n, q, 1000 * n // q


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


LONGEST = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint"
_NAMES = ["n_runs", "start", "length", "period", "exponent_milli"]


def digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, the number of runs, the longest one, and digests of all runs and of the text without repetitions."""

    def result(ids: list, words: list[list[bytes]], runs: list[list[tuple[int, int, int]]]) -> pa.Table:
        head = [(len(r), *_longest(r)) for r in runs]
        listed = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in runs]
        kept = [hashlib.sha256(_collapsed(w, r)).hexdigest() for w, r in zip(words, runs)]
        columns = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(w) for w in words], pa.int64())}
        columns |= {c: pa.array([h[k] for h in head], pa.int64()) for k, c in enumerate(_NAMES)}
        return pa.table(columns | {"runs_sha256": pa.array(listed), "collapsed_sha256": pa.array(kept)})

    return _rows(docs, least, result, f"doc_id bigint, n_words bigint, {LONGEST}, runs_sha256 string, collapsed_sha256 string")


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, the number of runs, the longest one, all runs, and collapsed_text: the words that no run contains after its first period."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def result(ids: list, words: list[list[bytes]], runs: list[list[tuple[int, int, int]]]) -> pa.Table:
        head = [(len(r), *_longest(r)) for r in runs]
        columns = {"doc_id": pa.array(ids, pa.int64())} | {c: pa.array([h[k] for h in head], pa.int64()) for k, c in enumerate(_NAMES)}
        every = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind)
        text = pa.array([_collapsed(w, r).decode("utf-8", "replace") for w, r in zip(words, runs)], pa.string())
        return pa.table(columns | {"runs": every, "collapsed_text": text})

    return _rows(docs, least, result, f"doc_id bigint, {LONGEST}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string")


def collapse_documents(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with runs in `text` collapsed to their first period; texts with runs have their other words joined by a space.

    n_chars, if there is such a column, is counted anew.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = batch.column(at).to_pylist(), 0
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
            while lo < len(texts):
                hi, n = lo + 1, len(words[lo])
                while hi < len(texts) and n + len(words[hi]) <= GROUP:
                    n += len(words[hi])
                    hi += 1
                numbers: dict[bytes, int] = {}
                ids = np.array([numbers.setdefault(w, len(numbers)) for ws in words[lo:hi] for w in ws], np.int64)
                for k, runs in enumerate(runs_of(ids, [len(ws) for ws in words[lo:hi]], least), lo):
                    if runs:
                        texts[k] = _collapsed(words[k], runs).decode("utf-8", "replace")
                lo = hi
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        release()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, with periodic tails in a tenth of the documents.

    h is the crc32 of the decimal doc_id and g = floor(h / 10).  Where h ends in 0, each of the n words from word
    a = g mod n on repeats with period 1 + floor((n - a) / (3 + g mod 8)).  A null doc_id or
    a text without words is left as it is.
    """
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", g.alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    d = d.withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), F.lit(1), n - a)
    return d.select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))
