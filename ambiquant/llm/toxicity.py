"""Toxicity scores of a convolutional text classifier, trained in numpy.

Words are hashed to embeddings; filters of several widths run over the word sequence,
each is rectified and max-pooled over the whole text, and a logistic unit reads the
pooled values.  A gradient reaches only the positions that won a pool, so a training
step costs little more than scoring.

The model is fitted on every labelled document, of any length, except the rows whose crc32(doc_id)
mod 5 is 0, which are never used.  Remainder 1 is kept for calibration: one offset of
the log-odds, so that 0.5 is the best common cut, and a threshold for each language, both
from counts of all its rows by steps of 1/STEPS log-odds.  Languages only choose thresholds; a score depends on the text alone.

Documents are dealt to groups by a hash of doc_id.  In each of a few rounds every group goes
through its documents from the common model, and the next common model has, for each row of
parameters, the mean change over the groups that changed it.  Changes are summed as whole
numbers, so the model does not depend on partitions.  A task holds a group, and the driver a
model: neither grows with the input.  A corpus of one group is fitted in one round.

Defined results: a null or empty text is a text without words and gets the score of the
bias; without labels of both kinds every score is the share of label 1, or 0; a null
doc_id is scored and is not held out; a null language has the common threshold; repeated
rows get equal scores, and of rows of one doc_id the one whose words' packed numbers come first is fitted on; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambiquant.llm.blocks import release
from ambiquant.llm.session import checkpointed

WORDS_KEPT = 200_000
#: Characters of a text that are turned into words at a time, so memory doesn't grow with the text.
STRETCH = 1 << 18
#: Words of a text that are gone through at a time when fitting.
WORDS_AT_ONCE = 4096
#: Bytes of text in a group, at least and at most; between, groups grow with the square root of the input.
GROUP_BYTES, MOST_GROUP_BYTES, PIECE_BYTES = 24 << 20, 96 << 20, 1 << 16
#: Steps of a unit of log-odds in which calibration counts rows, and the log-odds beyond which all are alike.
STEPS, LARGEST = 256, 40
#: Fractions of a unit in which changes of parameters, and of their sums of squares, are added up.
FINE, SUM_FINE = 2.0**20, 2.0**24
_SPACE = re.compile(r"\s")
_numbers: dict[str, int] = {}


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(-1))


def word_ids(text: str, slots: int) -> list[int]:
    """Slots of the lower-case words, without punctuation at their ends."""
    known = _numbers
    out = []
    for w in text.lower().split():
        n = known.get(w)
        if n is None:
            if len(known) >= WORDS_KEPT:
                known.clear()
            n = known[w] = zlib.crc32(w.strip(".,;:!?()[]\"'").encode("utf-8", "surrogatepass"))
        out.append(n % slots)
    return out


def packed_words(text: str, slots: int) -> bytes:
    """word_ids of a text of any length, three bytes each: less than the text, wherever it is sent."""
    return b"".join(np.array(word_ids(s, slots), "<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for s in stretches(text))


def unpacked_words(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(packed, np.uint8).reshape(-1, 3)
    return wide.view("<i4").ravel()


def stretches(text: str) -> Iterator[str]:
    """A text in stretches of some STRETCH characters, cut at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Model:
    """Embeddings, filters and the logistic unit."""

    SLOTS = 1 << 19

    def __init__(self, slots: int = SLOTS, dim: int = 8, widths: tuple[int, ...] = (1, 2, 3), filters: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.slots, self.widths, self.filters = slots, widths, filters
        self.embedding = rng.normal(0, 0.05, (slots + 1, dim)).astype(np.float32)
        self.embedding[slots] = 0  # stands for no word, around a text
        self.kernels = [rng.normal(0, 0.5 / np.sqrt(w), (w, dim, filters)).astype(np.float32) for w in widths]
        self.offsets = [np.full(filters, -0.1, np.float32) for _ in widths]
        self.out = np.abs(rng.normal(0, 0.3, len(widths) * filters)).astype(np.float32)
        self.out[1::4] *= -1
        self.bias = np.float32(-1)
        self.shift = 0.0
        self.constant: float | None = None

    def packed(self, texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in a row, each followed by as many empty words as the widest filter needs; and the starts."""
        pad = [self.slots] * max(self.widths)
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for t in texts for x in (t, pad)])
        sizes = np.array([len(t) + len(pad) for t in texts])
        return flat, np.cumsum(sizes) - sizes

    def pooled(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled values (texts by filters), and the filters' values at each word."""
        e = self.embedding[flat]
        ends = np.append(starts[1:], len(flat))
        tops, values = [], []
        for kernel, offset in zip(self.kernels, self.offsets):
            v = e @ kernel[0]
            for k in range(1, len(kernel)):
                v[:-k] += e[k:] @ kernel[k]
            v += offset
            for k in range(1, len(kernel)):
                v[ends - k] = -np.inf  # windows that reach into the next text
            values.append(v)
            tops.append(np.maximum.reduceat(v, starts, axis=0))
        return np.maximum(np.concatenate(tops, axis=1), 0), values

    def winners(self, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """As `won`, for one text of any length: windows slide on over WORDS_AT_ONCE words at a time, and the first largest is kept."""
        widest = max(self.widths)
        flat = np.concatenate([text, np.full(widest, self.slots)]).astype(np.int64)
        last = len(flat) - widest + 1  # places from which all filters fit; the narrower ones see no more than empty words after them
        top, words = None, []
        for lo in range(0, last, WORDS_AT_ONCE):
            part = flat[lo : min(lo + WORDS_AT_ONCE, last) + widest - 1]
            t, w = self.won(part, np.zeros(1, np.int64))
            if top is None:
                top, words = t, w
                continue
            for k, (old, new) in enumerate(zip(words, w)):
                at = slice(k * self.filters, (k + 1) * self.filters)
                better = t[0, at] > top[0, at]
                old[0][better] = new[0][better]
            top = np.maximum(top, t)
        return top, words

    def won(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled values, and for each width the words (texts by filters by width) of the windows that won."""
        top, values = self.pooled(flat, starts)
        words = []
        for width, v in zip(self.widths, values):
            at = np.stack([a + v[a:b].argmax(axis=0) for a, b in zip(starts, np.append(starts[1:], len(flat)))])
            words.append(flat[np.minimum(at[:, :, None] + np.arange(width), len(flat) - 1)])
        return top, words

    def won_by_each(self, texts: list) -> tuple[np.ndarray, list[np.ndarray]]:
        """`won` of texts of any length; short ones are packed together."""
        short = [i for i, t in enumerate(texts) if len(t) <= WORDS_AT_ONCE]
        long = [i for i, t in enumerate(texts) if len(t) > WORDS_AT_ONCE]
        parts = [self.won(*self.packed([texts[i] for i in short]))] if short else []
        parts += [self.winners(np.asarray(texts[i], dtype=np.int64)) for i in long]
        back = np.argsort(short + long)
        return np.concatenate([t for t, _ in parts])[back], [np.concatenate(w)[back] for w in zip(*(w for _, w in parts))]

    def logits(self, texts: list[list[int]]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        flat, starts = self.packed(texts)
        return (self.pooled(flat, starts)[0] @ self.out + self.bias).astype(np.float64)

    def logit_of_long(self, parts: Iterator[list[int]]) -> float:
        """The logit of one text that comes in parts: filters slide on over borders, and only their largest values are kept."""
        widest = max(self.widths)
        top, rest = np.full(len(self.widths) * self.filters, -np.inf, np.float32), np.zeros(0, np.int64)
        for part in parts:
            ids = np.concatenate([rest, np.array(part, np.int64)])
            whole = len(ids) - widest + 1  # places from which all filters fit
            if whole > 0:
                _, values = self.pooled(ids, np.zeros(1, np.int64))
                top = np.maximum(top, np.concatenate([v[:whole].max(axis=0) for v in values]))
            rest = ids[max(0, whole) :]
        last = self.pooled(np.concatenate([rest, np.full(widest, self.slots)]), np.zeros(1, np.int64))[0][0]
        return float(np.maximum(top, last) @ self.out + self.bias)

    def logits_of_all(self, texts: list[np.ndarray]) -> np.ndarray:
        """Logits of texts of any length, some 100,000 words at a time."""
        out, group, n = np.zeros(len(texts)), [], 0
        for i, t in enumerate(texts):
            if len(t) > STRETCH:
                out[i] = self.logit_of_long(t[a : a + STRETCH] for a in range(0, len(t), STRETCH))
            else:
                group.append(i)
                n += len(t)
            if group and (n > 100_000 or len(group) >= 64 or i == len(texts) - 1):
                out[group] = self.logits([texts[k] for k in group])
                group, n = [], 0
        return out

    def scores(self, texts: list[list[int]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.chances(self.logits(texts))

    def score_of_long(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return float(self.chances(self.logit_of_long(word_ids(s, self.slots) for s in stretches(text))))

    def chances(self, logits):
        return 1 / (1 + np.exp(-np.clip(logits + self.shift, -40, 40)))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.kernels, *self.offsets, self.out]

    def first_sums(self) -> list[np.ndarray]:
        """Adagrad's sums of squares before the first step, in the order of the parameters, the bias last."""
        return [np.full(p.shape, 1e-3, np.float32) for p in (*self.parameters(), np.zeros(1))]

    def fit(
        self, texts: list, y: np.ndarray, epochs: int, rate: float = 0.05, batch: int = 32, seed: int = 9,
        sums: list[np.ndarray] | None = None, weights: tuple[float, float] | None = None,
    ) -> None:
        """Adagrad on the log loss, with the two labels weighted alike, or by weights (of 0 and of 1); sums are gone on from, in place."""
        rng = np.random.default_rng(seed)
        zero, one = weights or label_weights(int((1 - y).sum()), int(y.sum()))
        weight = np.where(y == 1, one, zero)
        sums = sums or self.first_sums()
        of_embedding, of_kernels, of_offsets = sums[0], sums[1 : 1 + len(self.widths)], sums[1 + len(self.widths) : -2]
        n_f = self.filters

        def step(p: np.ndarray, s: np.ndarray, g: np.ndarray, at: object = slice(None)) -> None:
            s[at] += g * g
            p[at] -= rate * g / np.sqrt(s[at])

        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                sel = order[lo : lo + batch]
                top, words = self.won_by_each([texts[i] for i in sel])
                p = 1 / (1 + np.exp(-np.clip(top @ self.out + self.bias, -30, 30)))
                d = ((p - y[sel]) * weight[sel] / len(sel)).astype(np.float32)
                d_top = d[:, None] * self.out[None, :] * (top > 0)
                step(self.out, sums[-2], top.T @ d)
                sums[-1] += d.sum() ** 2
                self.bias -= np.float32(rate * d.sum() / np.sqrt(sums[-1][0]))
                rows, grads = [], []
                for w, (kernel, offset, won) in enumerate(zip(self.kernels, self.offsets, words)):
                    g = d_top[:, w * n_f : (w + 1) * n_f]
                    d_kernel = np.zeros_like(kernel)
                    for k in range(len(kernel)):
                        at = won[:, :, k]
                        d_kernel[k] = np.einsum("tf,tfd->df", g, self.embedding[at])
                        rows.append(at.ravel())
                        grads.append((g[:, :, None] * kernel[k].T[None]).reshape(-1, kernel.shape[1]))
                    step(kernel, of_kernels[w], d_kernel)
                    step(offset, of_offsets[w], g.sum(axis=0))
                row, where = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(row), self.embedding.shape[1]), np.float32)
                np.add.at(total, where, np.concatenate(grads))
                total[row == self.slots] = 0
                step(self.embedding, of_embedding, total, row)

    def table(self) -> np.ndarray:
        """All parameters as rows as wide as an embedding: the embeddings, then the others one after another."""
        return as_rows([*self.parameters(), np.array([self.bias], np.float32)])

    def set_table(self, table: np.ndarray) -> None:
        own = [*self.parameters(), np.zeros(1, np.float32)]
        from_rows(table, own)
        self.bias = own[-1][0]


def label_weights(zeros: int, ones: int) -> tuple[float, float]:
    """Weights of rows of label 0 and of label 1 that make both labels count alike."""
    n = zeros + ones
    return 0.5 * n / max(1, zeros), 0.5 * n / max(1, ones)


def as_rows(arrays: list[np.ndarray]) -> np.ndarray:
    dim = arrays[0].shape[1]
    rest = np.concatenate([a.ravel() for a in arrays[1:]])
    return np.concatenate([arrays[0], np.append(rest, np.zeros(-len(rest) % dim, rest.dtype)).reshape(-1, dim)])


def from_rows(table: np.ndarray, arrays: list[np.ndarray]) -> None:
    """Sets arrays to what as_rows made of them."""
    arrays[0][:] = table[: len(arrays[0])]
    rest, at = table[len(arrays[0]) :].ravel(), 0
    for a in arrays[1:]:
        a[:] = rest[at : at + a.size].reshape(a.shape)
        at += a.size


def best_cut(values: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> float:
    """The cut, in log-odds, with the best balance of both labels' accuracies, from counts of both by steps; midway between the steps around it."""
    zeros, ones = zeros[np.argsort(values)], ones[np.argsort(values)]
    v = np.sort(values).astype(np.float64)
    if not ones.sum() or not zeros.sum():
        return 0.0
    right = np.append(0, np.cumsum(zeros)) / zeros.sum() + 1 - np.append(0, np.cumsum(ones)) / ones.sum()
    best = np.nonzero(right == right.max())[0]
    k = int(best[len(best) // 2])
    return float(v[0] - STEPS if k == 0 else v[-1] + STEPS if k == len(v) else (v[k - 1] + 1 + v[k]) / 2) / STEPS


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """The words' numbers of all labelled documents that may be learned from, by group, a group in one partition; and the number of groups.

    Columns: _g (group), ids (packed_words), lang, _y, _held (for calibration).
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null")
    known = known.filter(remainder(F.col("_id")) != 0).distinct()
    d = docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    meets = F.col("doc_id") == F.col("_id")
    size = d.select("doc_id", F.octet_length("text").alias("_n")).join(known, meets).agg(F.sum("_n")).first()[0] or 0
    groups = max(1, round(size / min(MOST_GROUP_BYTES, max(GROUP_BYTES, math.isqrt(size * PIECE_BYTES)))))
    slots = Model.SLOTS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [packed_words(t.as_py(), slots) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), part.column(2)], names=["doc_id", "ids", "lang"])
        _numbers.clear()
        release()

    kind = d.schema["doc_id"].dataType.simpleString()
    d = d.select("doc_id", F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))).mapInArrow(packed, f"doc_id {kind}, ids binary, lang string")
    # labels grow with the documents, so they are never broadcast
    d = d.join(known.hint("merge"), meets).groupBy("_id", "_y").agg(F.min(F.struct("ids", "lang")).alias("_d"))
    mixed = F.xxhash64("_id")
    d = d.select(F.pmod(mixed, F.lit(groups)).cast("int").alias("_g"), mixed.alias("_o"), "_id", "_d.ids", "_d.lang", "_y", (remainder(F.col("_id")) == 1).alias("_held"))
    d = d.repartitionById(groups, F.col("_g")).sortWithinPartitions("_g", "_o", "_id", "_y").drop("_o", "_id")
    return checkpointed(d), groups


def fit_round(rows: DataFrame, model: Model, sums: list[np.ndarray], weights: tuple[float, float], epochs: int, seed: int) -> None:
    """Sets model and sums to what they are after every group has gone through its rows `epochs` times."""
    dim = model.embedding.shape[1]
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((model.table(), [s.copy() for s in sums]))
    cols = [f"p{k}" for k in range(dim)] + [f"s{k}" for k in range(dim)]

    def changes(group: int, texts: list[np.ndarray], y: list[int]) -> Iterator[pa.RecordBatch]:
        table, old = shared.value
        m, own = Model(), [s.copy() for s in old]
        m.set_table(table)
        m.fit(texts, np.array(y), epochs, seed=seed + group, sums=own, weights=weights)
        p, s = m.table() - table, as_rows(own) - as_rows(old)
        at = np.nonzero((s != 0).any(axis=1))[0]
        whole = np.concatenate([np.rint(np.clip(p[at], -1024, 1024) * FINE), np.rint(np.clip(s[at], 0, 2.0**20) * SUM_FINE)], axis=1).astype(np.int64)
        for lo in range(0, len(at), 10_000):
            part = whole[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 10_000].astype(np.int32)), *(pa.array(c) for c in part.T.copy())], names=["at", *cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, texts, y = None, [], []
        for b in batches:
            for g, ids, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if g != group:
                    if texts:
                        yield from changes(group, texts, y)
                    group, texts, y = g, [], []
                texts.append(unpacked_words(ids.as_py()))
                y.append(label)
        if texts:
            yield from changes(group, texts, y)
        release()

    each = rows.select("_g", "ids", "_y").mapInArrow(run, "at int, " + ", ".join(f"{c} bigint" for c in cols))
    mean = lambda c: (F.sum(c) / F.count(F.lit(1)) / F.lit(FINE if c[0] == "p" else SUM_FINE)).cast("float").alias(c)
    # at most a row of numbers for each row of parameters
    found = each.groupBy("at").agg(*(mean(c) for c in cols)).toArrow()
    shared.destroy()
    at = found.column("at").to_numpy()
    for table, first, put in ((model.table(), "p", model.set_table), (as_rows(sums), "s", lambda t: from_rows(t, sums))):
        table[at] += np.stack([found.column(f"{first}{k}").to_numpy() for k in range(dim)], axis=1) if len(at) else 0
        put(table)


def cuts_of(rows: DataFrame, model: Model) -> dict[str, float]:
    """The best cut of all rows, in log-odds (key ""), and those of languages that have ten rows of each label."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logits = shared.value.logits_of_all([unpacked_words(t.as_py()) for t in b.column(0)])
            at = np.floor(np.clip(logits, -LARGEST, LARGEST) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(at)], names=["lang", "_y", "_at"])
        release()

    def cut(t: pa.Table) -> pa.Table:
        zeros, ones = t.column("_zeros").to_numpy(), t.column("_ones").to_numpy()
        lang = t.column("lang")[0].as_py()
        few = lang != "" and min(zeros.sum(), ones.sum()) < 10
        found = [] if few else [(lang, best_cut(t.column("_at").to_numpy(), zeros, ones))]
        return pa.table({"lang": pa.array([x for x, _ in found], pa.string()), "cut": pa.array([x for _, x in found], pa.float64())})

    at = rows.select("ids", "lang", "_y").mapInArrow(steps, "lang string, _y int, _at int")
    at = at.select(F.explode(F.array_distinct(F.array(F.lit(""), "lang"))).alias("lang"), "_y", "_at")
    # at most 2 * LARGEST * STEPS + 1 rows a language
    counts = at.groupBy("lang", "_at").agg(F.count_if(F.col("_y") == 0).alias("_zeros"), F.count_if(F.col("_y") == 1).alias("_ones"))
    return {r["lang"]: r["cut"] for r in counts.groupBy("lang").applyInArrow(cut, "lang string, cut double").collect()}


def train(docs: DataFrame, labels: DataFrame, epochs: int = 10, rounds: int = 4) -> tuple[Model, dict[str, float]]:
    """The fitted model, and thresholds by language (key "" for languages without enough rows for calibration).

    All labelled documents are gone through `epochs` times, in `rounds` rounds; three times as often if there are 1500 at most.
    """
    rows, groups = labelled(docs, labels)
    n = {(r["_held"], r["_y"]): r["count"] for r in rows.groupBy("_held", "_y").count().collect()}
    model = Model()
    zeros, ones = (n.get((False, y), 0) + n.get((True, y), 0) for y in (0, 1))
    if not zeros or not ones:
        model.constant = 1.0 if ones else 0.0
        return model, {"": 0.5}
    learn, check = rows.filter("not _held"), rows.filter("_held")
    if len(n) < 4:  # a part without one of the labels
        learn = check = rows
    else:
        zeros, ones = n[False, 0], n[False, 1]
    if zeros + ones <= 1500:
        epochs *= 3
    rounds = min(rounds, epochs) if groups > 1 else 1
    sums = model.first_sums()
    for k in range(rounds):
        fit_round(learn, model, sums, label_weights(zeros, ones), epochs * (k + 1) // rounds - epochs * k // rounds, 9 + k * groups)
    found = cuts_of(check, model)
    model.shift = -found.pop("")
    return model, {"": 0.5} | {lang: float(model.chances(c)) for lang, c in found.items()}


def score(docs: DataFrame, model: Model, cuts: dict[str, float] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and toxic (score at or above the language's threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, cuts or {"": 0.5}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, by = shared.value
        for b in batches:
            texts, langs, s = b.column(2), b.column(3).to_pylist(), np.zeros(b.num_rows)
            group: list[list[int]] = []
            places: list[int] = []
            for i in range(b.num_rows):
                text = texts[i].as_py() or ""
                if len(text) > STRETCH:
                    s[i] = m.score_of_long(text)
                else:
                    group.append(word_ids(text, m.slots))
                    places.append(i)
                if group and (sum(map(len, group[-16:])) > 100_000 or len(group) >= 64 or i == b.num_rows - 1):
                    s[places] = m.scores(group)
                    group, places = [], []
            cut = np.array([by.get(x or "", by[""]) for x in langs])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= cut)],
                names=["doc_id", "held_out", "score", "predicted", "toxic"],
            )
        _numbers.clear()
        release()

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder(F.col("doc_id")) == 0).alias("held_out"), "text", "lang")
    return d.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, toxic boolean")
