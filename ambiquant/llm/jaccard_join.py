"""Exact Jaccard join on word shingles in a metric space.

The Jaccard distance is a metric, so distances to a pivot bound all others: documents
within r = 0.25 of each other differ by at most r in their distance to any pivot.

1. Classes.  Rows with one shingle set are one class; a class takes part once, whatever
   the number of its copies, and counts as many documents in the numbers of links.
2. Seeds.  Nearly all documents of a corpus are at distance 1 from any sampled pivot, so
   the first pivots must come from the documents' own neighbourhoods.  Blocks ask in how
   many sets each shingle occurs; shingles are ordered by that number, then by hash.  Two
   sets within r share one of the first n - ceil(0.75 n) + 1 shingles of either, so a set
   whose first shingles are all its own has no partner and leaves.  The smallest class that
   has a shared first shingle is a pivot; a set joins the regions of all its pivots, so
   linked sets share a region.  A pair counts in the first of the regions that both are in;
   a region that lies in an earlier one is left out.
3. Recursion.  A region of more than ROWS sets or BYTES is split: PIVOTS of its sets are
   sampled, distances of all others to them are measured, in tasks of at most ROWS sets,
   and each set goes home to the nearest pivot's Voronoi cell.  If x at home in c is linked
   with y, then d(y, c) <= d(y, home of y) + 2 r; sets in that window are replicated to c as
   border sets, to cells before their own only, as a pair counts in the earlier home.  Cells
   that are still large are split again with new pivots.
4. Dense regions.  If the pairs of sets in the cells are no fewer than DENSE times those of
   the region, it lies in a ball that its pivots cannot divide, and the cells are dropped
   again.  It is dealt into tiles: parts of at most ROWS sets, each pair of parts a task.
5. In a region that fits, the recursion goes on inside its task: pivots far from each other are
   chosen by farthest-first traversal, sets go home to the nearest, and border sets to
   earlier cells c where d(y, c) <= min(d(y, home of y) + 2 r, radius of c + r), the radius
   being the largest distance of a set at home.  It ends at cells of at most LEAF sets and at
   those that a split leaves too many pairs; there sets are sorted by their distance to a
   pivot, and a set is compared with those whose distance is at most r more.

Every pair of different linked sets is found and counted once; links are given as stars
(set, root of its component in the region) and numbers of links.  Labels go over stars
to a fixed point by alternating large and small stars, whose rounds grow with the logarithm of the
number of sets, with a checkpoint a round.

Defined results: texts without words and null texts have an empty set and link with
nothing; with fewer than five words the sequence is one shingle; a null doc_id gets a
null component and links with nothing; n_links is the number of other rows that a row links with,
equal sets included; rows of one doc_id are one document for
components; empty tables give empty results; extra columns are ignored by `components` and kept by
`one_of_each`.  Shingles are compared by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ambiquant.llm.blocks import aligned, ask, bodies, group_starts, in_blocks, mix64, ordered, release, short_keys
from ambiquant.llm.session import checkpointed, unused

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Sets and bytes of sets that a region may have to be joined in one task, and pivots that split a larger one.
ROWS, BYTES, PIVOTS = 400, 8 << 20, 16
#: Sets that a cell inside a task may have without being split again, and pivots that split it.
LEAF, CENTRES = 8, 8
#: A split must leave less than this share of a region's pairs; and rows up to which a side may be broadcast.
DENSE, FEW = 0.7, 1_000_000
#: Sets in more regions than this are not asked whether a region lies in another; that only keeps regions that could go.
MOST_CELLS = 64
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 20
_letters = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _table(base: int, n: int) -> np.ndarray:
    """base ** k modulo 2 ** 64 for k up to n."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_powers, _back = _table(_BASE, _STEP), _table(pow(_BASE, -1, 1 << 64), _STEP)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        if group and size + len(b) >= _STEP:
            out += _sets(group)
            group, size = [], 0
        group.append(b)
        size += len(b) + 1
    return out + _sets(group) if group else out


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    flat = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    first, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if len(flat) <= _STEP:
        powers, back = _powers, _back
    else:  # one text that is longer than all tables
        powers, back = _table(_BASE, len(flat)), _table(pow(_BASE, -1, 1 << 64), len(flat))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters[flat] * powers[: len(flat)])])
    words = mix64((sums[end] - sums[first]) * back[first])
    gram = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        gram = gram * np.uint64(0xBF58476D1CE4E5B9) + words[k : len(words) - WORDS + 1 + k] if len(gram) else gram
    gram = mix64(gram)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(first, starts)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            g = np.sort(gram[a : b - WORDS + 1])
            sets.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            whole = 0
            for w in words[a:b].tolist():
                whole = (whole * 0x94D049BB133111EB + w + 1) % (1 << 64)
            sets.append(mix64(np.array([whole], np.uint64) ^ np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


class Block:
    """A block's distinct sets, each with the documents that have it."""

    def __init__(self, ids: list, texts: list[str]):
        self.bare: list[tuple] = []  # documents that link with nothing, and their numbers of shingles
        self.docs: list[list[int]] = []
        self.digests: list[bytes] = []
        taken: list[np.ndarray] = []
        seen: dict[bytes, int] = {}
        for i, s in zip(ids, shingle_sets(texts)):
            if i is None or not len(s):
                self.bare.append((i, len(s)))
                continue
            digest = hashlib.blake2b(s, digest_size=16).digest()
            k = seen.setdefault(digest, len(taken))
            if k == len(taken):
                taken.append(s)
                self.docs.append([])
                self.digests.append(digest)
            self.docs[k].append(i)
        self.sizes = np.array([len(s) for s in taken], dtype=np.int64)
        self.flat = np.concatenate(taken) if taken else np.zeros(0, np.uint64)
        self.ends = np.cumsum(self.sizes)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles; the note is the number of sets that hold each, 255 at most."""
        keys = np.sort(short_keys(self.flat))
        at = group_starts(keys)
        return keys[at], np.minimum(np.diff(np.concatenate([at, [len(keys)]])), 255).astype(np.uint8)

    def prefixes(self, got: dict[int, bytes]) -> dict[int, np.ndarray]:
        """Of each set that shares a first shingle: those that it shares."""
        if not len(self.flat):
            return {}
        keys, _ = self.keys()
        of = aligned(got, np.dtype(np.uint8))[np.searchsorted(keys, short_keys(self.flat))]
        alone = np.add.reduceat((of == 1).astype(np.int64), self.ends - self.sizes)
        length = self.sizes - (PERCENT * self.sizes + 99) // 100 + 1
        out = {}
        for k in np.nonzero(alone < length)[0].tolist():
            lo, hi = self.ends[k] - self.sizes[k], self.ends[k]
            order = np.lexsort((self.flat[lo:hi], short_keys(self.flat[lo:hi]), of[lo:hi]))[alone[k] : length[k]]
            out[k] = short_keys(self.flat[lo:hi][order])
        return out


def _sum(starts: np.ndarray, notes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.minimum(np.add.reduceat(notes.astype(np.int64), starts), 255).astype(np.uint8)


def _count_keys(ids: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return Block(ids, texts).keys()


#: kind: 0 documents that link with nothing, 1 a set that only its copies link with, 2 a set that may have partners.
FOUND = "kind int, digest binary, n bigint, docs array<bigint>, first array<bigint>, shingles binary"


def _found(key: tuple, table: pa.Table, said: pa.Table) -> pa.Table:
    block, got = Block(*ordered(table)), bodies(said)
    shared = block.prefixes(got.get(1, {}))
    rows: list[tuple] = [(0, None, n, [i], None, None) for i, n in block.bare]
    for k, docs in enumerate(block.docs):
        n = int(block.sizes[k])
        if k in shared:
            own = block.flat[block.ends[k] - n : block.ends[k]]
            rows.append((2, block.digests[k], n, docs, shared[k].view(np.int64), own.tobytes()))
        else:
            rows.append((1, None, n, docs, None, None))
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    out = pa.table({f.split()[0]: pa.array([r[c] for r in rows], kinds[c]) for c, f in enumerate(FOUND.split(", "))})
    del block, shared, rows
    release()
    return out


class Region:
    """Sets by their numbers, compared by counts of common shingles."""

    def __init__(self, sets: list[np.ndarray]):
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self._hold(np.array([len(s) for s in sets], dtype=np.int64), flat.astype(np.int32), np.zeros(len(values), dtype=np.int64))

    def _hold(self, n: np.ndarray, flat: np.ndarray, marked: np.ndarray) -> None:
        self.n, self.flat, self.marked = n, flat, marked
        self.at = np.cumsum(n) - n

    def take(self, places: np.ndarray) -> Region:
        """The region of some of the sets, in the order given."""
        out = Region.__new__(Region)
        out._hold(self.n[places], np.concatenate([self.own(i) for i in places.tolist()]), self.marked)
        return out

    def similar(self, own: np.ndarray, size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of intersection and union of a set, given by numbers of shingles, with the sets from lo to hi."""
        self.marked[own] = 1
        begin = self.at[lo]
        end = self.at[hi - 1] + self.n[hi - 1]
        common = np.add.reduceat(self.marked[self.flat[begin:end]], self.at[lo:hi] - begin)
        self.marked[own] = 0
        return common, self.n[lo:hi] + size - common

    def own(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i] + self.n[i]]

    def distances(self, i: int) -> np.ndarray:
        common, union = self.similar(self.own(i), int(self.n[i]), 0, len(self.n))
        return 1 - common / union


REACH = 1 - PERCENT / 100 + 1e-9


def voronoi(region: Region) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells of a region: the places of their sets, and which of them are border sets; a linked pair has one cell where not both are.

    The first pivot is the first set, each further one the set farthest from all before it.
    """
    pivots, far = [0], [region.distances(0)]
    nearest = far[0].copy()
    while len(pivots) < CENTRES and nearest.max() > REACH:
        pivots.append(int(nearest.argmax()))
        far.append(region.distances(pivots[-1]))
        nearest = np.minimum(nearest, far[-1])
    home = np.argmin(far, axis=0)
    cells = []
    for c, d in enumerate(far):
        own = home == c
        radius = d[own].max()
        border = (home > c) & (d <= np.minimum(nearest + 2 * REACH, radius + REACH))
        places = np.nonzero(own | border)[0]
        cells.append((places, border[places]))
    return cells


def linked_pairs(region: Region) -> Iterator[tuple[int, np.ndarray]]:
    """Each linked pair of sets of a region once, as (set, others), through cells of cells."""
    # places in the region, and a bit for each level at which a set is a border set
    open_: list[tuple[np.ndarray, np.ndarray, int]] = [(np.arange(len(region.n)), np.zeros(len(region.n), np.int64), 0)]
    while open_:
        places, border, level = open_.pop()
        here = region.take(places)
        if len(places) > LEAF and level < 62:
            cells = voronoi(here)
            if sum(len(c) ** 2 for c, _ in cells) < DENSE * len(places) ** 2:
                open_ += [(places[c], border[c] | (b.astype(np.int64) << level), level + 1) for c, b in cells if len(c) > 1]
                continue
        far = here.distances(0)
        order = np.argsort(far, kind="stable")
        far, here, places, border = far[order], here.take(order), places[order], border[order]
        upto = np.searchsorted(far, far + REACH, side="right")
        for i in range(len(places)):
            lo, hi = i + 1, int(upto[i])
            if lo >= hi:
                continue
            common, union = here.similar(here.own(i), int(here.n[i]), lo, hi)
            near = np.nonzero((100 * common >= PERCENT * union) & (border[lo:hi] & border[i] == 0))[0] + lo
            if len(near):
                yield int(places[i]), places[near]


def join_region(sets: list[np.ndarray], flags: list[int], before: list, weights: list[int]) -> tuple[list[int], list[int]]:
    """Of each set: the first set of its component, and the documents of the sets that it links with here.

    A pair counts if no bit is set in the flags of both, and no earlier region (before) is common.
    """
    size = len(sets)
    flag = np.array(flags, np.int64)
    weight = np.array(weights, np.int64)
    earlier = [set(b) for b in before]
    some = [bool(e) for e in earlier]
    root, links = np.arange(size), np.zeros(size, np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for i, near in linked_pairs(Region(sets)):
        own = find(i)
        for j in np.unique(root[near]).tolist():
            other = find(j)
            if other != own:
                own, other = min(own, other), max(own, other)
                root[other] = own
        root[near] = own
        near = near[flag[near] & flag[i] == 0]
        if some[i] and len(near):
            near = near[[not (some[j] and earlier[i] & earlier[j]) for j in near.tolist()]]
        links[i] += weight[near].sum()
        links[near] += weight[i]
    return [find(i) for i in range(size)], links.tolist()


#: A set in a region: `before` are its seed regions before this one's; a bit of `flags` says that it is a border set there.
PLACED = "cell bigint, digest binary, rep bigint, mult bigint, before array<bigint>, flags bigint, shingles binary"
LINKED = "digest binary, rep bigint, root bigint, links bigint"
PLACED_TYPES = {"cell": pa.int64(), "digest": pa.binary(), "rep": pa.int64(), "mult": pa.int64(), "before": pa.list_(pa.int64()), "flags": pa.int64(), "shingles": pa.binary()}


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by cell: (digest, rep, root, links) of the sets that link in a region."""
    names = [f.split()[0] for f in LINKED.split(", ")]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    cell: int | None = None
    held: list[dict] = []

    def links() -> list[tuple]:
        if len(held) < 2:
            return []
        held.sort(key=lambda r: (r["rep"], r["digest"]))
        column = lambda c: [r[c] for r in held]
        roots, counts = join_region([np.frombuffer(x, np.uint64) for x in column("shingles")], column("flags"), column("before"), column("mult"))
        return [(r["digest"], r["rep"], held[a]["rep"], n) for r, a, n in zip(held, roots, counts) if n or held[a]["rep"] != r["rep"]]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    for b in batches:
        out: list[tuple] = []
        for r in b.to_pylist():
            if r["cell"] != cell:
                out += links()
                cell, held = r["cell"], []
            held.append(r)
        yield batch(out)
    yield batch(links())
    release()


def _split_at(level: int):
    """Deals the sets of a cell, a part at a time, to the Voronoi cells of its pivots."""

    def split(key: tuple, table: pa.Table, pivots: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out: dict[str, list] = {c: [] for c in PLACED_TYPES}
        if rows and pivots.num_rows:
            centres = sorted(pivots.column("centre").to_pylist())
            region = Region([np.frombuffer(x, np.uint64) for x in [r["shingles"] for r in rows] + centres])
            far = np.stack([region.distances(len(rows) + k)[: len(rows)] for k in range(len(centres))], axis=1)
            home = far.argmin(axis=1)
            window = far <= far.min(axis=1)[:, None] + 2 * REACH
            window &= np.arange(len(centres))[None, :] < home[:, None]  # a pair counts in the earlier home
            window[np.arange(len(rows)), home] = True
            seed = np.array([key[0].as_py()], np.int64).view(np.uint64)
            cells = mix64(mix64(seed + np.uint64(level + 1)) + np.arange(len(centres), dtype=np.uint64)).view(np.int64).tolist()
            for i, k in zip(*(x.tolist() for x in np.nonzero(window))):
                for c in out:
                    out[c].append(rows[i][c])
                out["cell"][-1] = cells[k]
                out["flags"][-1] |= 0 if home[i] == k else 1 << level
        found = pa.table({c: pa.array(v, PLACED_TYPES[c]) for c, v in out.items()} | {"parent": pa.array([key[0].as_py()] * len(out["cell"]), pa.int64())})
        release()
        return found

    return split


def _sizes(rows: DataFrame, *by: str) -> DataFrame:
    """cell, m sets, parts that it takes to stay in the bounds."""
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("shingles")).alias("_b"))
    return s.withColumn("parts", F.greatest(F.ceil(F.col("m") / ROWS), F.ceil(F.col("_b") / BYTES)).cast("int")).drop("_b")


def _few(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if its rows, some 32 bytes each, are few; df must be checkpointed."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows of dense cells (with `parts`), dealt to the tiles of their cells; PLACED."""
    d = rows.withColumn("_own", F.pmod(F.xxhash64("digest", F.lit(-1)), F.col("parts")).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64("cell", F.least("_own", "_other"), F.greatest("_own", "_other"), F.lit("tile"))
    # pairs of one part count in the tile of that part with itself
    bit = F.when(F.col("_own") == F.col("_other"), F.lit(0)).when(F.col("_own") < F.col("_other"), F.lit(1 << 61)).otherwise(F.lit(1 << 62))
    d = d.withColumn("flags", F.col("flags").bitwiseOR(bit.cast("bigint"))).withColumn("cell", tile)
    return d.select(*PLACED_TYPES)


def _divided(large: DataFrame, sizes: DataFrame) -> list[DataFrame]:
    """Rows of cells that are too large (PLACED; sizes: cell, m, parts, checkpointed), in cells and tiles that fit."""
    done: list[DataFrame] = []
    for level in range(60):
        known = large.join(_few(sizes), "cell")
        dealt = known.withColumn("salt", F.pmod(F.xxhash64("digest", F.lit(level)), F.col("parts")).cast("int"))
        by = Window.partitionBy("cell").orderBy(F.xxhash64("digest", F.lit(level), F.lit("pivot")), "digest")
        pivots = known.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= PIVOTS)
        pivots = pivots.select(F.col("cell").alias("at"), F.col("shingles").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = dealt.select(*PLACED_TYPES, "salt").groupBy("cell", "salt")
        cells = checkpointed(dealt.cogroup(pivots.groupBy("at", "part")).applyInArrow(_split_at(level), PLACED + ", parent bigint"))
        child = checkpointed(_sizes(cells, "cell", "parent"))
        work = child.groupBy("parent").agg(F.sum(F.col("m") * F.col("m")).alias("_w"))
        whole = sizes.select(F.col("cell").alias("parent"), F.col("m").alias("_all"))
        dense = _few(checkpointed(work.join(whole, "parent").filter(F.col("_w") > DENSE * F.col("_all") * F.col("_all")).select("parent")))
        done.append(_tiles(known.join(dense, F.col("cell") == F.col("parent"), "left_semi")))
        state = checkpointed(child.join(dense, "parent", "left_anti").drop("parent"))
        rows = cells.drop("parent").join(_few(state), "cell")
        done.append(rows.filter("parts <= 1").select(*PLACED_TYPES))
        sizes = checkpointed(state.filter("parts > 1"))
        if sizes.limit(1).count() == 0:
            return done
        large = rows.filter("parts > 1").select(*PLACED_TYPES)
    return [*done, _tiles(large.join(_few(sizes), "cell"))]


def labels(links: DataFrame) -> DataFrame:
    """node, label of the nodes of links (a, b): the smallest node that links lead to.

    Large stars move the larger neighbours of a node to its smallest neighbour, small stars
    the others, until every component is a star.
    """
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select("b", "m").filter("b <> m").union(down.select("a", "m")).toDF("a", "b").distinct()
        after = checkpointed(small)
        same = edges.join(after, ["a", "b"], "left_anti").limit(1).count() == 0 and after.join(edges, ["a", "b"], "left_anti").limit(1).count() == 0
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document."""
    blocks, buckets = in_blocks(docs)
    counts = ask(blocks, _count_keys, _sum, buckets, 1, note=np.uint8)
    found = checkpointed(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_found, FOUND))
    sets = found.filter("kind = 2")
    classes = sets.groupBy("digest").agg(
        F.min(F.array_min("docs")).alias("rep"), F.sum(F.size("docs")).cast("bigint").alias("mult"), F.first("first").alias("first")
    )
    keys = classes.select("digest", "rep", F.explode("first").alias("key"))
    pivots = keys.groupBy("key").agg(F.min(F.struct("rep", "digest")).alias("_p"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    pivots = pivots.select("key", F.xxhash64("_p.digest").alias("cell"))
    cells = keys.join(pivots, "key").groupBy("digest").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    classes = checkpointed(classes.drop("first").join(cells, "digest", "left"))
    # a region whose sets all share an earlier one has no pair that counts in it
    members = classes.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    within = classes.filter(F.size("cells") <= MOST_CELLS).select("cells", F.explode("cells").alias("cell"))
    within = within.select("cell", F.explode(F.filter("cells", lambda c: c < F.col("cell"))).alias("_in")).groupBy("cell", "_in").agg(F.count(F.lit(1)).alias("m"))
    idle = checkpointed(within.join(members, ["cell", "m"]).select(F.col("cell").alias("_idle")).distinct())
    idle = _few(idle)
    # sets go to their regions and nowhere else
    placed = sets.groupBy("digest").agg(F.first("shingles").alias("shingles")).join(classes.filter("cells is not null"), "digest")
    placed = placed.withColumn("cell", F.explode("cells")).join(idle, F.col("cell") == F.col("_idle"), "left_anti").select(
        "cell", "digest", "rep", "mult", F.filter("cells", lambda c: c < F.col("cell")).alias("before"), F.lit(0).cast("bigint").alias("flags"), "shingles"
    )
    width = sets.groupBy("digest").agg(F.first("n").alias("_n"))
    size = classes.select("digest", F.explode("cells").alias("cell")).join(idle, F.col("cell") == F.col("_idle"), "left_anti").join(width, "digest")
    size = size.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), (F.sum("_n") * 8).alias("_b"))
    size = size.withColumn("parts", F.greatest(F.ceil(F.col("m") / ROWS), F.ceil(F.col("_b") / BYTES)).cast("int")).drop("_b")
    large = checkpointed(size.filter("parts > 1"))
    regions = [placed]
    if large.limit(1).count():
        known = _few(large.select("cell"))
        regions = [placed.join(known, "cell", "left_anti"), *_divided(checkpointed(placed.join(known, "cell", "left_semi")), large)]
    linked = []
    for r in regions:
        linked.append(r.repartition("cell").sortWithinPartitions("cell").mapInArrow(_regions, LINKED))
    linked = checkpointed(_union(linked))
    links = linked.groupBy("digest").agg(F.sum("links").alias("_links"))
    info = classes.select("digest", "rep", "mult").join(links, "digest", "left")
    info = info.select("digest", "rep", (F.col("mult") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"))
    alike = found.filter("kind < 2").select("kind", "n", "docs", F.array_min("docs").alias("rep"), F.when(F.col("kind") == 1, F.size("docs") - 1).otherwise(F.lit(0)).cast("bigint").alias("n_links"))
    rows = sets.select("kind", "digest", "n", "docs").join(info, "digest").select("kind", "n", "docs", "rep", "n_links").unionByName(alike)
    # a doc_id in rows with different sets joins their classes
    several = rows.filter("kind > 0").select("rep", F.explode("docs").alias("doc")).distinct()
    twice = several.groupBy("doc").agg(F.min("rep").alias("_low"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = several.join(twice, "doc").select(F.col("rep").alias("a"), F.col("_low").alias("b"))
    label = labels(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(twice))
    rows = rows.join(label, F.col("rep") == F.col("node"), "left").withColumn("doc", F.explode("docs"))
    component = F.when(F.col("kind") == 0, F.col("doc")).otherwise(F.coalesce("label", "rep"))
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), "n_links")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are not the smallest of their component; a null doc_id stays.

    The doc_ids that go are broadcast if they are at most FEW.
    """
    (number,) = unused(docs, "_id")
    gone = checkpointed(components(docs).filter("component_id < doc_id").select(F.col("doc_id").alias(number)).distinct())
    return docs.join(_few(gone), F.col("doc_id") == F.col(number), "left_anti").select(*docs.columns)
