"""Fill-in-middle: each text is cut in three and its parts are exchanged in place, between sentinels.

Cuts fall between tokens (a run of ASCII letters, or any other code point). They are found by one scan over the bytes of a whole
batch. A text's bytes get their sentinels in one bytearray, as ``<P>prefix<M>middle<S>suffix``; rotations then bring the blocks into
order, each by three reversals: both blocks, then the two together. A reversal swaps its ends through a buffer of 64 KB, so a long
text is never copied. ``restored`` finds the sentinels again, runs the rotations backwards and takes the sentinels out.

Defined results: a null text is empty; an empty text, and one that holds a sentinel of its own, stays plain; a null id draws as an empty
one; repeated rows each come out alike; columns of any other name are not read. A row depends on its own id and text alone,
so there is no shuffle and a lost task is simply run again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.llm.words import pieces, text_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"

_LETTER = np.zeros(256, np.bool_)
_LETTER[65:91] = _LETTER[97:123] = True
_INNER = np.zeros(256, np.bool_)
_INNER[0x80:0xC0] = True


@dataclass(frozen=True)
class Shares:
    """Of 100 texts, how many are transformed, and how many of those have their suffix first."""

    transformed: int = 90
    suffix_first: int = 20


def reverse(block: memoryview, start: int, end: int, buffer: int = 1 << 16) -> None:
    """``block[start:end]`` backwards, in place; single bytes are swapped a buffer at a time."""
    data = np.frombuffer(block, np.uint8)
    while end - start > 1:
        n = min(buffer, (end - start) // 2)
        low = data[start:start + n].copy()
        data[start:start + n] = data[end - n:end][::-1]
        data[end - n:end] = low[::-1]
        start, end = start + n, end - n


def rotate(block: memoryview, start: int, middle: int, end: int) -> None:
    """Exchanges ``block[start:middle]`` and ``block[middle:end]`` by three reversals."""
    reverse(block, start, middle)
    reverse(block, middle, end)
    reverse(block, start, end)


def transform(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` cut at bytes ``first`` and ``second``, in the given form."""
    out = bytearray(text)
    if form == PLAIN:
        return out
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        out[at:at] = mark
    middle = 3 + first
    suffix = middle + 3 + second - first
    with memoryview(out) as block:
        rotate(block, middle, suffix, len(out))
        if form == SPM:
            rotate(block, 0, middle, middle + len(out) - suffix)
    return out


def restored(output: bytes, form: str) -> bytes:
    """The text that was transformed, from the output and its form alone."""
    if form == PLAIN:
        return bytes(output)
    out = bytearray(output)
    if form == SPM:
        suffix = out.index(PREFIX)
        with memoryview(out) as block:
            rotate(block, 0, suffix, out.index(MIDDLE))
    second, third = out.index(SUFFIX), out.index(MIDDLE)
    with memoryview(out) as block:
        rotate(block, second, third, len(out))
    third = second + len(out) - third
    for at in (third, second, 0):
        del out[at:at + 3]
    return bytes(out)


def token_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a token begins; no token reaches over the end of a text."""
    letter = _LETTER[raw]
    starts = ~_INNER[raw]
    starts[1:] &= ~(letter[1:] & letter[:-1])
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = True
    return np.flatnonzero(starts)


#: The number of tokens, the form, both cuts in bytes and in code points, and the transformed text.
FIELDS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def draws(id_: Column) -> list[Column]:
    """Four unsigned 32-bit numbers drawn from an id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _transformed(column: pa.Array, h: list[np.ndarray], shares: Shares) -> pa.StructArray:
    raw, offsets = text_bytes(column)
    starts = token_starts(raw, offsets)
    bounds = np.searchsorted(starts, offsets)
    n = np.diff(bounds)
    cuts = np.stack([h[0] % (n + 1), h[1] % (n + 1)])
    edges = np.append(starts, len(raw))
    low, high = (np.where(cut < n, edges[bounds[:-1] + cut], offsets[1:]) for cut in (cuts.min(0), cuts.max(0)))
    points = np.concatenate(([0], np.cumsum(~_INNER[raw])))
    whole = raw.tobytes()
    forms, outputs = [], []
    for i in range(len(n)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        text = whole[a:b]
        if a == b or h[2][i] % 100 >= shares.transformed or any(s in text for s in SENTINELS):
            form = PLAIN
        else:
            form = SPM if h[3][i] % 100 < shares.suffix_first else PSM
        forms.append(form)
        outputs.append(bytes(transform(text, int(low[i]) - a, int(high[i]) - a, form)))
    plain = np.array([f == PLAIN for f in forms], np.bool_)
    chars = [pa.array(points[to] - points[start], pa.int64(), mask=plain) for start, to in ((offsets[:-1], low), (low, high))]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(forms, pa.string()), *chars,
                                       pa.array(outputs, pa.binary()).cast(pa.string())], [f.name for f in FIELDS])


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shares: Shares = Shares()) -> DataFrame:
    """``_id``, ``_n``, ``_form``, ``_prefix_chars``, ``_middle_chars`` (code points, null if plain) and ``_output``, a row a document."""
    def batch(text: pa.Array, *h: pa.Array) -> pa.Array:
        numbers = [np.asarray(x, np.int64) for x in h]
        done = [_transformed(text.slice(a, b - a), [x[a:b] for x in numbers], shares) for a, b in pieces(text)]
        return pa.concat_arrays(done) if done else pa.array([], pa.struct([pa.field(f.name, t) for f, t in zip(
            FIELDS, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]))

    run = F.arrow_udf(batch, FIELDS)
    cut = docs.select(docs[id_col].alias("_id"), run(docs[text_col], *draws(docs[id_col])).alias("_cut"))
    return cut.select("_id", *[F.col(f"_cut.{f.name}").alias(f"_{f.name}") for f in FIELDS])


def restore(done: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``_restored``, rebuilt from ``_output`` and ``_form``."""
    def batch(output: pa.Array, form: pa.Array) -> pa.Array:
        back = [restored(o, f) for o, f in zip(output.cast(pa.binary()).to_pylist(), form.to_pylist())]
        return pa.array(back, pa.binary()).cast(pa.string())

    return done.withColumn("_restored", F.arrow_udf(batch, T.StringType())(F.col("_output"), F.col("_form")))

