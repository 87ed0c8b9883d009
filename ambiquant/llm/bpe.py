"""Exact byte-level BPE by backtracking over longest token matches.

A pre-token is encoded in linear time: one Aho-Corasick pass gives the longest token
at every byte; tokens are appended greedily, and a pair is accepted only if merging
could leave it as two tokens (the pair-compatibility test, whose answers are kept in a
table of at most PAIRS_LIMIT).  If a pair is refused the next shorter token is tried, then the last token is
taken back; a byte position that failed is never tried again.  The result equals
applying all merges by rank.  Decoding looks ids up in an offset table over the
concatenated token bytes.

Encodings of pre-tokens are kept per Python worker in a table of at most
CACHE_LIMIT entries; when half of them are new, those not used since go, so memory is bounded.

Defined results: a null text encodes as no tokens and decodes to the empty text; ids
that are out of range decode to nothing; an added token's string in a text is that
token.  Rows are independent: repeated rows, ties and any doc_id give one result each.
Extra columns are kept by `encode` and ignored by `digest`.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambiquant.llm.blocks import release

CACHE_LIMIT, PAIRS_LIMIT = 400_000, 200_000
#: The pre-token pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Printable letter of each byte in the vocabulary file, as letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary, given as the text of its JSON file."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        model = json.loads(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(k): v for k, v in model["model"]["vocab"].items() if all(c in letters for c in k)}
        self.added = {a["content"]: a["id"] for a in model.get("added_tokens", [])}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        added = {k.encode() for k in self.added}
        tokens = {k: v for k, v in vocab.items() if k not in added}
        # ranks order the tokens: single bytes first, then merges in turn
        self.rank = {k: -1 for k in tokens if len(k) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        order = [k for k in tokens if len(k) == 1]
        for a, b in merges:
            order.append(raw(a) + raw(b))
        self.number = {}
        for k in order:
            self.number.setdefault(k, len(self.number))
        for a, b in merges:
            left, right = self.number[raw(a)], self.number[raw(b)]
            whole = self.number[raw(a) + raw(b)]
            self.halves.setdefault(whole, (left, right))
            self.joined.setdefault((left, right), whole)
        self.bytes_of = list(self.number)
        self.length = [len(k) for k in self.bytes_of]
        self.ids = [tokens[k] for k in self.bytes_of]
        self.shorter = [next((self.number[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in self.number), -1) for k in self.bytes_of]
        self.matcher = ahocorasick.Automaton()
        for n, k in enumerate(self.bytes_of):
            self.matcher.add_word(k.decode("latin-1"), n)
        self.matcher.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.findall = regex.compile(PATTERN).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        top = 1 + max([*vocab.values(), *self.added.values()])
        table = [b""] * top
        for k, v in [*tokens.items(), *((k.encode(), v) for k, v in self.added.items())]:
            table[v] = k
        self.sizes = np.array([len(k) for k in table], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.cache: dict[str, tuple[bytes, str, int]] = {}
        self.older: dict[str, tuple[bytes, str, int]] = {}

    def may_stand(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, are what merging their bytes leaves."""
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        left, right, bound, answer = a, b, 1 << 60, True
        while True:
            whole = self.joined.get((left, right))
            if whole is not None and whole < bound:
                answer = False  # a merge over the border comes before one inside
                break
            # undo the later of the two merges: its border half then faces the other side
            if left > right and left in self.halves:
                bound, left = left, self.halves[left][1]
            elif right in self.halves:
                bound, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                bound, left = left, self.halves[left][1]
            else:
                break
        if len(self.compatible) >= PAIRS_LIMIT:
            self.compatible.clear()
        self.compatible[a, b] = answer
        return answer

    def numbers(self, piece: bytes) -> list[int]:
        n, length = len(piece), self.length
        longest = [-1] * n
        for end, token in self.matcher.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and (dead[at + length[token]] or (out and not self.may_stand(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def piece(self, p: str) -> tuple[bytes, str, int]:
        """Ids of a pre-token as 32-bit bytes, as decimal text, and their count."""
        got = self.older.get(p)
        if got is None:
            ids = [self.ids[t] for t in self.numbers(p.encode("utf-8", "surrogatepass"))]
            got = (struct.pack(f"<{len(ids)}i", *ids), ",".join(map(str, ids)), len(ids))
        if len(p) <= 64:
            if 2 * len(self.cache) >= CACHE_LIMIT:
                # dicts that others hold stay the same objects
                self.older.clear()
                self.older.update(self.cache)
                self.cache.clear()
            self.cache[p] = got
        return got

    def parts(self, text: str) -> list[tuple[bytes, str, int]]:
        cache, piece, out = self.cache, self.piece, []
        chunks = self.split_added(text) if self.split_added and any(a in text for a in self.added) else [text]
        for chunk in chunks:
            if chunk in self.added:
                n = self.added[chunk]
                out.append((np.array([n], dtype="<i4").tobytes(), str(n), 1))
            elif chunk:
                out += [cache.get(p) or piece(p) for p in self.findall(chunk)]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([p[0] for p in self.parts(text)]), dtype="<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[at].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


    def forget(self) -> None:
        """Empties the tables that grow with the texts; a worker that waits for other work holds none."""
        self.cache.clear()
        self.older.clear()
        self.compatible.clear()
        release()


_codecs: dict[str, Codec] = {}


def codec_of(spec: str) -> Codec:
    """The codec of a vocabulary, built once in each Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def shared_spec(spark: SparkSession, path: str | None):
    """The vocabulary file, read on the driver and broadcast; its size is fixed by the vocabulary."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    for x in column:
        s = x.as_py()
        yield s if s is not None else ""


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of docs with `ids`, an int array, added; a column named ids is replaced."""
    spec = shared_spec(docs.sparkSession, path)
    rest = docs.drop("ids")
    schema = rest.withColumn("ids", F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for b in batches:
            found = [codec.encode(t) for t in _texts(b.column(b.schema.get_field_index("text")))]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])
        codec.forget()

    return rest.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of `encoded` with `decoded`, the text of the array column ids; null ids give the empty text."""
    spec = shared_spec(encoded.sparkSession, path)
    rest = encoded.drop("decoded")
    schema = rest.withColumn("decoded", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            texts = [codec.decode_text(np.array([i for i in x if i is not None], dtype=np.int64)) for x in (x.as_py() or [] for x in ids)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return rest.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, in one pass."""
    spec = shared_spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for b in batches:
            counts, ids, decoded = [], [], []
            for text in _texts(b.column(1)):
                parts = codec.parts(text)
                numbers = np.frombuffer(b"".join([p[0] for p in parts]), dtype="<i4")
                counts.append(len(numbers))
                ids.append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                back = codec.decode(numbers).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.forget()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
