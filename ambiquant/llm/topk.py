"""Exact top-k by inner product on an impact-ordered, score-at-a-time index.

Components are quantised to floor(scale * x).  A part of the vectors is indexed as posting
segments: one for each impact and dimension, with the vectors whose component there has
that impact (its size in LEVELS steps of the part's largest), and the components.  Segments are
read by descending impact; each adds its components, times the queries' own, to the
accumulators of its vectors, for a batch of queries at a time.  By Cauchy and Schwarz the
unread components of a vector are worth at most the norm of what is unread of it times the
query's norm, which the index knows for each impact.  A query stops only when these margins
prove that all but a few vectors are below its k-th best score, found so far or bounded from
below; these possible members, or at the end of the index all that reach the bound, are
rescored with exact integers.

A task holds a block of vectors (some BLOCK) and a chunk of queries (some CHUNK), so
neither side is broadcast, and the table is sent once for each chunk of queries.  Repeated
rows are dealt over the blocks by the partition they are read in; as queries they are one, with a number of copies.  Parts of a
block are read by descending norm; a query carries its k-th best exact score from part to
part, and passes over parts whose largest norm cannot reach it.  A block gives k rows a
query, and the k best of all blocks are merged, with a limit before the shuffle.

Defined results: vectors that are null, or hold a null or non-finite component, take no
part, neither as queries nor as candidates; a null vec_id takes no part; vectors of
another length than the longest are padded with zeros; a query's own row is the
rows with its vec_id; ties go to the smaller vec_id; repeated rows are candidates each, and
queries each, with ranks of their own; an empty table gives an empty result; extra columns are ignored.
A quantised component or a score of a result that is no 64-bit integer raises an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ambiquant.llm.blocks import release

#: Vectors of a block, queries of a chunk, and vectors of a part, at most.
BLOCK, CHUNK, PART = 1 << 16, 1 << 15, 4096
#: Queries whose accumulators are held at a time, possible members a query is stopped at, as a multiple of k, and impacts.
BATCH, FEW, LEVELS = 64, 40, 16
_WHOLE = 1 << 63


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; of Python's integers where 64 bits might not hold a sum."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    most = int(max(vectors.max(), -int(vectors.min()))) * max(int(query.max()), -int(query.min())) * len(query)
    return vectors @ query if most < _WHOLE else vectors.astype(object) @ query.astype(object)


class Index:
    """Posting segments of a part's quantised vectors, by descending impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        size = np.abs(vectors.astype(np.float64))
        top = size.max(initial=0.0)
        impact = np.ceil(size * (LEVELS / top)).astype(np.int8) if top > 0 else np.zeros(size.shape, np.int8)
        rows, dims = np.nonzero(impact)
        order = np.lexsort((rows, dims, -impact[rows, dims]))
        rows, dims = rows[order], dims[order]
        found = impact[rows, dims]
        self.rows, self.parts = rows, vectors[rows, dims].astype(np.float64)
        cuts = np.nonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (dims[1:] != dims[:-1])]))[0] if len(rows) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(rows))
        # level -> its segments (dimension, begin, end), and the norm of what is unread of each vector after it
        self.levels = []
        squares = size * size
        for level in sorted(set(found.tolist()), reverse=True):
            own = [(int(dims[a]), int(a), int(b)) for a, b in zip(cuts, ends) if found[a] == level]
            self.levels.append((own, np.sqrt(np.where(impact < level, squares, 0).sum(axis=1)) * (1 + 1e-9)))
        self.norms = np.sqrt(squares.sum(axis=1)) * (1 + 1e-9)
        self.largest = float(self.norms.max(initial=0.0))
        self.by_id = np.argsort(ids, kind="stable")

    def search(self, own: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (of a batch) ids and exact scores of the possible members that reach its bound; none of its own id."""
        n, width = self.vectors.shape
        found: list = [None] * len(queries)
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-9)
        active = np.nonzero(norms * self.largest * (1 + 1e-9) >= bound)[0]
        score = np.zeros((n, len(active)))
        held = self.ids[self.by_id]
        lo, hi = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
        weights = q[active].T.copy()
        for number, (segments, unread) in enumerate(self.levels):
            if not len(active):
                break
            for dim, a, b in segments:
                score[self.rows[a:b]] += self.parts[a:b, None] * weights[dim][None, :]
            last = number == len(self.levels) - 1
            if not last and unread.mean() > 0.55 * self.norms.mean():
                continue  # too early for any proof
            # rounding of the sums so far is in the margin too
            margin = (unread + self.norms * (width + 4) * 2.3e-16)[:, None] * norms[active][None, :]
            low, high = score - margin, score + margin
            for c, i in enumerate(active.tolist()):
                mine = self.by_id[lo[i] : hi[i]]
                low[mine, c] = high[mine, c] = -np.inf
            reach = np.maximum(bound[active], np.partition(low, n - k, axis=0)[n - k]) if n >= k else bound[active]
            possible = (high >= reach[None, :]) & (high > -np.inf)
            done = (possible.sum(axis=0) <= FEW * k) | last
            for c in np.nonzero(done)[0].tolist():
                at = np.nonzero(possible[:, c])[0]
                found[active[c]] = (self.ids[at], exact_scores(self.vectors[at], queries[active[c]]))
            active, score, weights = active[~done], score[:, ~done], weights[:, ~done]
        for i in active.tolist():  # a part of zero vectors has no segments
            at = np.nonzero(self.ids != own[i])[0]
            found[i] = (self.ids[at], exact_scores(self.vectors[at], queries[i]))
        return found


def search_block(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[list, list]]:
    """For each query ids and scores of the k best vectors of a block, best first."""
    size = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-size, kind="stable")
    best: list[tuple[list, list]] = [([], []) for _ in own]
    bound = np.full(len(own), -np.inf)
    for a in range(0, len(ids), PART):
        sel = order[a : a + PART]
        index = Index(ids[sel], vectors[sel])
        for b in range(0, len(own), BATCH):
            some = slice(b, b + BATCH)
            for i, got in enumerate(index.search(own[some], queries[some], bound[some], k), b):
                if got is None or not len(got[0]):
                    continue
                kept = sorted([*zip(best[i][1], best[i][0]), *zip(got[1].tolist(), got[0].tolist())], key=lambda x: (-x[0], x[1]))[:k]
                best[i] = ([x for _, x in kept], [s for s, _ in kept])
                if len(kept) == k:
                    # a float at or below the exact score
                    bound[i] = np.nextafter(float(kept[-1][0]), -np.inf)
    return best


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, finite vectors as doubles."""
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    return good.filter(~F.exists("v", bad)).select("vec_id", F.col("v").cast("array<double>").alias("v"))


def _packed(table: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, quantised vectors and copies, in the order of id and vector, padded to the longest."""
    lists = table.column("v").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    ids = table.column("vec_id").to_numpy()
    values = np.floor(lists.flatten().to_numpy() * float(scale))
    if len(values) and np.abs(values).max() >= float(_WHOLE):
        raise OverflowError("a quantised component is no 64-bit integer")
    out = np.zeros((len(ids), int(sizes.max(initial=1))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values.astype(np.int64)
    order = np.lexsort((*out.T[::-1], ids))
    return ids[order], out[order], table.column("copies").to_numpy()[order]


FORM = "part int, ids binary, copies binary, values binary"


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each row whose vec_id is divisible by `every`.

    One count of the vectors sets the numbers of blocks and chunks.
    """
    q = quantised(vectors)
    n, wanted = q.agg(F.count(F.lit(1)), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    partitions = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-n // BLOCK), min(partitions, n // PART))
    chunks = max(1, -(-wanted // CHUNK))
    held = q.withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.spark_partition_id()), F.lit(blocks)).cast("int")).withColumn("copies", F.lit(1).cast("bigint"))
    # queries of one vec_id that agree as quantised, but for zeros at the end, are one
    digits = F.concat(F.lit(","), F.array_join(F.transform("v", lambda x: F.floor(x * scale).cast("string")), ","))
    asked = q.filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn("_form", F.regexp_replace(digits, "(,0)+$", ""))
    asked = asked.groupBy("vec_id", "_form").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "_form"), F.lit(chunks)).cast("int"))

    # every chunk meets every block: both are packed first, then sent once for each meeting
    def packed(key: tuple, table: pa.Table) -> pa.Table:
        ids, values, copies = _packed(table, scale)
        return pa.table(
            {
                "part": pa.array([key[0].as_py()], pa.int32()),
                "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                "copies": pa.array([copies.astype(np.int64).tobytes()], pa.binary()),
                "values": pa.array([values.tobytes()], pa.binary()),
            }
        )

    left = held.select("part", "vec_id", "v", "copies").groupBy("part").applyInArrow(packed, FORM)
    right = asked.select("part", "vec_id", "v", "copies").groupBy("part").applyInArrow(packed, FORM)
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumnRenamed("part", "at")
    right = right.withColumnRenamed("part", "chunk").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def load(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(table.column("ids")[0].as_py(), np.int64)
        return ids, np.frombuffer(table.column("values")[0].as_py(), np.int64).reshape(len(ids), -1)

    def search(key: tuple, held_: pa.Table, asked_: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if held_.num_rows and asked_.num_rows:
            ids, values = load(held_)
            numbers, own = load(asked_)
            width = max(values.shape[1], own.shape[1])
            values = np.pad(values, ((0, 0), (0, width - values.shape[1])))
            own = np.pad(own, ((0, 0), (0, width - own.shape[1])))
            copies = np.frombuffer(asked_.column("copies")[0].as_py(), np.int64)
            best = search_block(ids, values, numbers, own, k)
            for i, (c, (found, scores)) in enumerate(zip(copies.tolist(), best)):
                digest = hashlib.blake2b(np.trim_zeros(own[i], "b").tobytes(), digest_size=16).digest()
                rows += [(int(numbers[i]), digest, c, v, s) for v, s in zip(found, scores)]
        if any(not -_WHOLE <= r[4] < _WHOLE for r in rows):
            raise OverflowError("a score is no 64-bit integer")
        names = ["query_id", "query", "copies", "vec_id", "score"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        release()
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, kinds))})

    schema = "query_id bigint, query binary, copies bigint, vec_id bigint, score bigint"
    some = left.groupBy("at", "chunk").cogroup(right.groupBy("at", "chunk")).applyInArrow(search, schema)
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    ranked = some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    each = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
