"""Edit-aware token counts on pre-token segment trees.

A document's tree holds its text in blocks of up to BLOCK pre-tokens, each with the sizes
(code points) and token counts of its pre-tokens; every node of the tree over the blocks
holds the sums of what is below it.  An edit cuts the blocks that it touches out of the tree
by descending the sums, splits their text into pre-tokens again from a little before the
edit (CONTEXT code points, as far as the pattern looks ahead) until the new borders meet an
old border behind the edit, counts only these pre-tokens, and puts the new blocks back.
Sums change on the paths to the blocks only: the tree is a treap, so a path has some
log2(blocks) nodes, whatever the edit inserts.  All other blocks keep text and counts.

A tree can be stored: `build_trees` gives texts with their leaves as columns, and
`apply_edits` starts from these, encodes nothing that the edits do not reach, and gives
the same columns again, for a later batch of edits.

Edits of a document are applied in order, each in the coordinates of the text that the
ones before it have left: `start` (0-based code points), `length` to delete, `text` to
insert.  Defined results: null texts are empty; a null list has no edits; start and
length are clipped to the text, null counts as 0, null insertions are empty; repeated
rows get one result each; empty tables give empty results; extra columns are ignored;
leaves that do not fit their text raise an error.  An added token's string counts as ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambiquant.llm.bpe import Codec, codec_of, shared_spec

BLOCK = 128
CONTEXT = 4
EDITS = "array<struct<start:bigint,length:bigint,text:string>>"


class Node:
    """A block of pre-tokens, and the sums of the blocks below it."""

    __slots__ = ("left", "right", "rank", "text", "sizes", "counts", "own", "chars", "tokens", "blocks")

    def __init__(self, text: str, sizes: list[int], counts: list[int], rank: int):
        self.left: Node | None = None
        self.right: Node | None = None
        self.rank, self.text, self.sizes, self.counts, self.own = rank, text, sizes, counts, sum(counts)
        self.chars, self.tokens, self.blocks = len(text), self.own, 1


class SegmentTree:
    """recounted: pre-tokens that edits had encoded again; touched: nodes whose sums edits updated."""

    def __init__(self, codec: Codec, text: str, leaves: tuple[list[int], list[int]] | None = None):
        self.codec, self.recounted, self.touched, self._state = codec, 0, 0, 0x9E3779B9
        if leaves is None:
            pieces = codec.findall(text)
            leaves = (list(map(len, pieces)), [self._count(p) for p in pieces])
        sizes, counts = leaves
        if len(sizes) != len(counts) or sum(sizes) != len(text):
            raise ValueError("these leaves are not of this text")
        self.root = self._built(text, sizes, counts)
        self.touched = 0

    def _count(self, piece: str) -> int:
        return (self.codec.cache.get(piece) or self.codec.piece(piece))[2]

    def _rank(self) -> int:
        self._state = (self._state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return self._state >> 20

    def _summed(self, node: Node) -> Node:
        a, b = node.left, node.right
        node.chars = len(node.text) + (a.chars if a else 0) + (b.chars if b else 0)
        node.tokens = node.own + (a.tokens if a else 0) + (b.tokens if b else 0)
        node.blocks = 1 + (a.blocks if a else 0) + (b.blocks if b else 0)
        self.touched += 1
        return node

    def _joined(self, a: Node | None, b: Node | None) -> Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._joined(a.right, b)
            return self._summed(a)
        b.left = self._joined(a, b.left)
        return self._summed(b)

    def _built(self, text: str, sizes: list[int], counts: list[int]) -> Node | None:
        """A tree of even blocks, built along its right edge."""
        number = -(-len(sizes) // BLOCK)
        edge: list[Node] = []
        at = 0
        for k in range(number):
            lo, hi = k * len(sizes) // number, (k + 1) * len(sizes) // number
            end = at + sum(sizes[lo:hi])
            node = Node(text[at:end], sizes[lo:hi], counts[lo:hi], self._rank())
            at = end
            below = None
            while edge and edge[-1].rank < node.rank:
                below = self._summed(edge.pop())
            node.left = below
            if edge:
                edge[-1].right = node
            edge.append(node)
        root = None
        while edge:
            root = self._summed(edge.pop())
        return root

    def _split(self, node: Node | None, at: int) -> tuple[Node | None, Node | None]:
        """The blocks that end at or before code point `at`, and the others."""
        if node is None:
            return None, None
        before = node.left.chars if node.left else 0
        if before + len(node.text) <= at:
            a, b = self._split(node.right, at - before - len(node.text))
            node.right = a
            return self._summed(node), b
        a, b = self._split(node.left, at)
        node.left = b
        return a, self._summed(node)

    def _first(self, node: Node) -> tuple[Node, Node | None]:
        """The first block, cut off, and the others."""
        if node.left is None:
            rest, node.right = node.right, None
            return self._summed(node), rest
        first, node.left = self._first(node.left)
        return first, self._summed(node)

    def _walk(self) -> Iterator[Node]:
        path: list[Node] = []
        node = self.root
        while path or node:
            while node:
                path.append(node)
                node = node.left
            node = path.pop()
            yield node
            node = node.right

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root else 0

    def text(self) -> str:
        return "".join([b.text for b in self._walk()])

    def leaves(self) -> tuple[list[int], list[int]]:
        blocks = list(self._walk())
        return [s for b in blocks for s in b.sizes], [c for b in blocks for c in b.counts]

    def edit(self, start: int, length: int, insert: str) -> None:
        n = self.n_chars
        start = min(max(start, 0), n)
        end = min(start + max(length, 0), n)
        before, rest = self._split(self.root, max(0, start - CONTEXT))
        base = before.chars if before else 0
        text, sizes, counts = "", [], []

        def more() -> None:
            nonlocal rest, text
            block, rest = self._first(rest)
            text += block.text
            sizes.extend(block.sizes)
            counts.extend(block.counts)

        while rest and len(text) < end - base:
            more()
        # places in the old text of the blocks cut out; new places are `shift` behind
        a, b, shift = start - base, end - base, len(insert) - (end - start)
        at = keep = 0
        while keep < len(sizes) and at + sizes[keep] <= a - CONTEXT:
            at += sizes[keep]
            keep += 1
        old, old_at = keep, at
        new_sizes, new_counts, here = sizes[:keep], counts[:keep], at
        match = self.codec.findall.__self__.match
        new = text[:a] + insert + text[b:]
        while True:
            while old < len(sizes) and (old_at < b or old_at + shift < here):
                old_at += sizes[old]
                old += 1
            met = old_at >= b and old_at + shift == here
            if met and (old < len(sizes) or rest is None):
                break
            if here + CONTEXT > len(new) and rest:
                more()
                new = text[:a] + insert + text[b:]
                continue
            if met and here == len(new):
                break
            piece = match(new, here)[0]
            if here + len(piece) + CONTEXT > len(new) and rest:
                more()  # the piece may go on in the next block
                new = text[:a] + insert + text[b:]
                continue
            new_sizes.append(len(piece))
            new_counts.append(self._count(piece))
            self.recounted += 1
            here += len(piece)
        new_sizes += sizes[old:]
        new_counts += counts[old:]
        self.root = self._joined(self._joined(before, self._built(new, new_sizes, new_counts)), rest)


TREE = "leaf_sizes array<int>, leaf_counts array<int>"
_LEAVES = pa.list_(pa.int32())


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text (null: empty), n_tokens, leaf_sizes and leaf_counts: the documents' trees.  No shuffle."""
    spec = shared_spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            trees = [SegmentTree(codec, t) for t in texts]
            leaves = [t.leaves() for t in trees]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array([t.n_tokens for t in trees], pa.int64()), pa.array([s for s, _ in leaves], _LEAVES), pa.array([c for _, c in leaves], _LEAVES)],
                names=["doc_id", "text", "n_tokens", "leaf_sizes", "leaf_counts"],
            )
        codec.forget()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, text string, n_tokens bigint, {TREE}")


def _edited(tree: SegmentTree, edits: list[dict] | None) -> None:
    for e in edits or []:
        if e is not None:
            tree.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")


def apply_edits(trees: DataFrame, path: str | None = None) -> DataFrame:
    """The trees after their edits, n_tokens anew, n_recounted (pre-tokens) and n_touched (nodes).

    trees: doc_id, text, leaf_sizes, leaf_counts and edits.  What the edits do not reach is not encoded.  No shuffle.
    """
    spec = shared_spec(trees.sparkSession, path)
    names = ["doc_id", "text", "n_tokens", "leaf_sizes", "leaf_counts", "n_recounted", "n_touched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for b in batches:
            rows = []
            for text, sizes, counts, edits in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                tree = SegmentTree(codec, text or "", (sizes or [], counts or []))
                _edited(tree, edits)
                rows.append((tree.text(), tree.n_tokens, *tree.leaves(), tree.recounted, tree.touched))
            kinds = [pa.string(), pa.int64(), _LEAVES, _LEAVES, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)
        codec.forget()

    return trees.select(F.col("doc_id").cast("bigint"), "text", "leaf_sizes", "leaf_counts", F.col("edits").cast(EDITS)).mapInArrow(
        run, f"doc_id bigint, text string, n_tokens bigint, {TREE}, n_recounted bigint, n_touched bigint"
    )


def count_with_edits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_chars_after, n_tokens_after, n_pieces, n_recounted, n_touched.

    docs: doc_id, text and edits (an array of start, length, text).  Trees are built and edited in
    one pass and not stored.  n_recounted is the number of pre-tokens that the edits had encoded
    again, n_touched of nodes that they updated.  Rows are independent: no shuffle.
    """
    spec = shared_spec(docs.sparkSession, path)
    names = ["doc_id", "n_chars", "n_tokens", "n_chars_after", "n_tokens_after", "n_pieces", "n_recounted", "n_touched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                tree = SegmentTree(codec, text)
                before, pieces = tree.n_tokens, sum(len(x.sizes) for x in tree._walk())
                _edited(tree, b.column(2)[i].as_py())
                out.append((len(text), before, tree.n_chars, tree.n_tokens, pieces, tree.recounted, tree.touched))
            cols = [pa.array(np.array([r[k] for r in out], np.int64)) for k in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)
        codec.forget()

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.col("edits").cast(EDITS)).mapInArrow(
        run, ", ".join(f"{n} bigint" for n in names)
    )
