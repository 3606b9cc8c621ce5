"""Token ids packed into rows of one length: best-fit decreasing with a segment tree over capacities.

Texts are encoded with a public byte-level BPE vocabulary, each ends with the end token. What is longer than a row is cut into
row-long parts and a rest, nothing is lost. Each task encodes the documents it reads, and packs them in shards of
about ``shard_tokens`` tokens: the segments go, longest first, to the row with the least room that is enough. So
documents are neither shuffled nor gathered, and a repeated task writes the same rows.

A packed row has ``ids`` (little-endian, two bytes an id if the vocabulary allows it, else four; padded with the end token),
``cu_seqlens`` (0 and the cumulative segment lengths), ``position_resets`` (where positions begin at 0 again: each segment's start and
that of the padding, if any), and per segment ``doc_ids``, ``parts`` and ``last_part``, from which ``unpack`` restores every document.

Defined results: a null or empty text is its end token alone; equal rows are packed each; ids of documents may be null or repeated;
further columns don't matter; no rows, no output.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from civiclake.llm.words import release_memory

# Fixed value: how the vocabulary's training split text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("position_resets", T.ArrayType(T.IntegerType())),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("parts", T.ArrayType(T.IntegerType())),
    T.StructField("last_part", T.ArrayType(T.BooleanType())), T.StructField("n_tokens", T.IntegerType())])
_TWO_SPACES = re.compile(r"\s\s")


def read_vocabulary(path: str, at_most: int = 64_000_000) -> bytes:
    """The vocabulary file's bytes, at most ``at_most`` of them: they go to every task."""
    with open(path, "rb") as f:
        data = f.read(at_most + 1)
    if len(data) > at_most:
        raise ValueError(f"{path} has more than {at_most} bytes")
    return data


class Encoder:
    """Texts to id bytes. Words after single spaces are encoded once and remembered, up to ``remember`` of them."""

    def __init__(self, vocabulary: bytes, remember: int = 150_000):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        encode, kind = self.encoding.encode_ordinary, "H" if self.dtype.itemsize == 2 else "I"

        class Memo(dict):
            def __missing__(self, word: str) -> bytes:
                ids = array(kind, encode(" " + word)).tobytes()
                if len(self) < remember and len(word) <= 40:
                    self[word] = ids
                return ids

        self.memo = Memo()

    def ids(self, text: str | None) -> bytes:
        """A place before a single space always ends a word of the pattern; where white space meets, the whole text is encoded at once."""
        end = np.array([self.end], self.dtype).tobytes()
        if not text:
            return end
        if _TWO_SPACES.search(text):
            return np.array(self.encoding.encode_ordinary(text), self.dtype).tobytes() + end
        first, *rest = text.split(" ")
        head = np.array(self.encoding.encode_ordinary(first), self.dtype).tobytes()
        return b"".join((head, *map(self.memo.__getitem__, rest), end))

    def text(self, ids: bytes) -> str:
        return self.encoding.decode(np.frombuffer(ids, self.dtype)[:-1].tolist())


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


class Capacities:
    """A segment tree over 0..n that holds how many rows have each capacity and finds the least capacity of at least x."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i, count = capacity + self.leaves, self.count
        while i:
            count[i] += by
            i >>= 1

    def least_from(self, x: int) -> int:
        """-1 if there is none."""
        i, count = x + self.leaves, self.count
        if count[i]:
            return x
        while True:
            while i & 1:  # a right child: its sibling holds less
                i >>= 1
                if not i:
                    return -1
            if not i:
                return -1
            i += 1
            if count[i]:
                break
            if i & (i - 1) == 0:
                return -1
        while i < self.leaves:
            i *= 2
            if not count[i]:
                i += 1
        return i - self.leaves


def best_fit_decreasing(lengths: np.ndarray, row_length: int) -> list[list[int]]:
    """Segments by row; equal lengths go in order of their numbers."""
    rows: list[list[int]] = []
    room: dict[int, list[int]] = {}
    tree = Capacities(row_length)
    for s in np.argsort(-lengths, kind="stable"):
        n = int(lengths[s])
        fit = tree.least_from(n)
        if fit < 0:
            r = len(rows)
            rows.append([int(s)])
            fit = row_length
        else:
            r = room[fit].pop()
            rows[r].append(int(s))
            tree.add(fit, -1)
        if fit > n:
            room.setdefault(fit - n, []).append(r)
            tree.add(fit - n, 1)
    return rows


class _Shard:
    def __init__(self, row_length: int, code: Encoder):
        self.row_length, self.code = row_length, code
        self.segments: list[tuple[int | None, int, bool, bytes]] = []
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> None:
        step = self.row_length * self.code.dtype.itemsize
        n = max(1, -(-len(ids) // step))
        for part in range(n):
            self.segments.append((doc_id, part, part == n - 1, ids[part * step:(part + 1) * step]))
        self.tokens += len(ids) // self.code.dtype.itemsize

    def packed(self, shard: int, first_row: int) -> Iterator[pa.RecordBatch]:
        width = self.code.dtype.itemsize
        lengths = np.array([len(s[3]) // width for s in self.segments], np.int64)
        rows = best_fit_decreasing(lengths, self.row_length)
        padding = np.full(self.row_length, self.code.end, self.code.dtype).tobytes()
        names = [f.name for f in SCHEMA.fields]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()),
                 pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int32()]
        for lo in range(0, len(rows), 512):
            out: list[list] = [[] for _ in names]
            for r, members in enumerate(rows[lo:lo + 512], first_row + lo):
                held = [self.segments[m] for m in members]
                ends = np.cumsum([0, *(lengths[m] for m in members)]).tolist()
                used = ends[-1]
                resets = ends[:-1] + ([used] if used < self.row_length else [])
                ids = b"".join((*(h[3] for h in held), padding[used * width:]))
                for column, value in zip(out, (shard, r, ids, ends, resets, [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], used)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text: str = "text", row_length: int = 2048,
         shard_tokens: int = 2_000_000) -> DataFrame:
    """Packed rows of all documents, see ``SCHEMA``; ``vocabulary`` is the path of a byte-level BPE file of tokens and ranks."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(shared.value)
        number = TaskContext.get().partitionId()
        row, held = 0, _Shard(row_length, code)

        def flush():
            nonlocal row, held
            for batch in held.packed(number, row):
                row += batch.num_rows
                yield batch
            held = _Shard(row_length, code)
            release_memory()

        release_memory()
        for batch in batches:
            for doc_id, t in zip(batch.column(0), batch.column(1)):
                held.add(doc_id.as_py(), code.ids(t.as_py()))
                if held.tokens >= shard_tokens:
                    yield from flush()
        yield from flush()

    return docs.select(docs[id_col].cast("long"), docs[text]).mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, part, last_part, ids`` for each segment: the inverse of packing, before the parts are joined."""
    width = 2 if len(read_vocabulary(vocabulary).splitlines()) < (1 << 16) - 1 else 4
    return packed.selectExpr(
        "inline(transform(doc_ids, (d, i) -> struct(d as doc_id, parts[i] as part, last_part[i] as last_part, "
        f"substring(ids, {width} * cu_seqlens[i] + 1, {width} * (cu_seqlens[i + 1] - cu_seqlens[i])) as ids)))")
