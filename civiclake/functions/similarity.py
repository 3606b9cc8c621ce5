"""String and date similarity: Jaro-Winkler, and the tokens any similar pair must share.

The tokens turn "similar to" into an equi-join: two values on the same level of a
comparison always have a token in common, so joining on tokens and verifying
afterwards loses nothing and never forms the dissimilar pairs.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclake.functions.text import col

# Workers receive these helpers with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMO_ENTRIES = 1 << 18  # values repeat a lot: each task remembers its recent results

# Fixed values of the published measure: prefix weight, longest prefix, least Jaro score that is raised.
PREFIX_WEIGHT, PREFIX_LENGTH, BOOST_ABOVE = 0.1, 4, 0.7


def jaro_winkler_pair(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    open_b: list[str | None] = list(b)
    from_a = []
    for i, ch in enumerate(a):
        try:
            j = open_b.index(ch, max(0, i - reach), i + reach + 1)
        except ValueError:
            continue
        open_b[j] = None
        from_a.append(ch)
    m = len(from_a)
    if m == 0:
        return 0.0
    from_b = [ch for ch, left in zip(b, open_b) if left is None]
    moved = sum(x != y for x, y in zip(from_a, from_b)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= BOOST_ABOVE:
        return jaro
    prefix = 0
    for x, y in zip(a[:PREFIX_LENGTH], b[:PREFIX_LENGTH]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * PREFIX_WEIGHT * (1 - jaro)


def remember(memo: dict, key, compute):
    """``compute()`` once per key; the memo starts over when it is full."""
    found = memo.get(key)
    if found is None:
        if len(memo) >= MEMO_ENTRIES:
            memo.clear()
        found = memo[key] = compute()
    return found


WORD = 64  # characters that fit the bits of one number
#: For each reach and position, the bits of the positions within reach.
_WITHIN = np.array([[sum(1 << j for j in range(max(0, i - reach), min(WORD, i + reach + 1))) for i in range(WORD)] for reach in range(WORD // 2)], np.uint64)
_BIT = np.left_shift(np.uint64(1), np.arange(WORD, dtype=np.uint64))


def _lowest(bits: np.ndarray) -> np.ndarray:
    return bits & (~bits + np.uint64(1))


def jaro_winkler_many(left: list[str], right: list[str]) -> np.ndarray:
    """``jaro_winkler_pair`` of many pairs at once; a string's positions are the bits of one number, so it takes up to 64 characters.

    For each position of the left strings, the free positions of the right ones that hold the same character within reach are one AND;
    the first of them is its lowest bit. Longer strings are taken one pair at a time.
    """
    lengths = np.array([[len(a), len(b)] for a, b in zip(left, right)], np.int64).reshape(-1, 2)
    out = np.zeros(len(lengths))
    fits = (lengths > 0).all(1) & (lengths <= WORD).all(1)
    for k in np.flatnonzero(~fits):
        out[k] = jaro_winkler_pair(left[k], right[k])
    rows = np.flatnonzero(fits)
    if not len(rows):
        return out
    la, lb = lengths[rows].T
    width = int(max(la.max(), lb.max()))
    a, b = (np.array([side[k] for k in rows], f"U{width}").view(np.uint32).reshape(-1, width) for side in (left, right))
    inside_a, inside_b = np.arange(width) < la[:, None], np.arange(width) < lb[:, None]
    letters, codes = np.unique(np.concatenate([a[inside_a], b[inside_b]]), return_inverse=True)
    a, b = np.zeros(a.shape, np.int64), np.zeros(b.shape, np.int64)
    a[inside_a], b[inside_b] = codes[:inside_a.sum()], codes[inside_a.sum():]
    each = np.arange(len(rows))
    few = len(letters) <= WORD
    if few:
        at = np.zeros((len(rows), len(letters)), np.uint64)
        for j in range(width):
            at[each, b[:, j]] |= np.where(inside_b[:, j], _BIT[j], np.uint64(0))
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used, matched = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
    for i in range(width):
        same = at[each, a[:, i]] if few else ((b == a[:, i:i + 1]) & inside_b) @ _BIT[:width]
        found = _lowest(np.where(inside_a[:, i], same & _WITHIN[reach, i] & ~used, np.uint64(0)))
        used |= found
        matched |= np.where(found != 0, _BIT[i], np.uint64(0))
    m = np.bitwise_count(used).astype(np.int64)
    moved = np.zeros(len(rows), np.int64)
    for _ in range(int(m.max(initial=0))):
        x, y = _lowest(matched), _lowest(used)
        i, j = (np.bitwise_count(v - np.uint64(1)).astype(np.int64) % WORD for v in (x, y))
        moved += (x != 0) & (a[each, np.minimum(i, width - 1)] != b[each, np.minimum(j, width - 1)])
        matched ^= x
        used ^= y
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la + m / lb + (m - moved // 2) / some) / 3, 0.0)
    ahead = min(width, PREFIX_LENGTH)
    alike = (a[:, :ahead] == b[:, :ahead]) & inside_a[:, :ahead] & inside_b[:, :ahead]
    prefix = np.cumprod(alike, axis=1).sum(1)
    score = np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1 - jaro), jaro)
    whole = (la == lb) & ((a == b) | ~inside_a).all(1)
    out[rows] = np.where(whole, 1.0, score)
    return out


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    out = np.full(len(left), np.nan)
    present = np.flatnonzero((left.notna() & right.notna()).to_numpy())
    for k in range(0, len(present), 2048):
        some = present[k:k + 2048]
        out[some] = jaro_winkler_many(left.iloc[some].tolist(), right.iloc[some].tolist())
    return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("Float64")


#: Characters are counted in so many classes. Two texts have at most as many characters in common as their counts do.
CLASSES = 32


def _least_common(threshold: float) -> list[float]:
    """For 0 to 4 equal first characters: the least m / p + m / q of m common ones of p and q with which ``threshold`` can be reached."""
    credit = [PREFIX_WEIGHT * k for k in range(PREFIX_LENGTH + 1)]
    return [3 * (max(BOOST_ABOVE, (threshold - c) / (1 - c)) if c and threshold > BOOST_ABOVE else threshold) - 1 for c in credit]


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length, characters by class, first characters and the first ``WORD`` characters' classes (``CLASSES`` beyond its end) of each text."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    counts = np.array([np.bincount(c % CLASSES, minlength=CLASSES) for c in codes], np.int64).reshape(-1, CLASSES)
    heads = np.array([[*c[:PREFIX_LENGTH], *[-1] * (PREFIX_LENGTH - len(c))] for c in codes], np.int64).reshape(-1, PREFIX_LENGTH)
    classes = np.full((len(codes), WORD), CLASSES, np.uint8)
    for row, c in zip(classes, codes):
        row[:len(c)] = c[:WORD] % CLASSES
    return lengths, counts.astype(np.uint8 if lengths.max(initial=0) < 256 else np.uint32), heads, classes


def _places(classes: np.ndarray) -> np.ndarray:
    """For each text and class the positions that hold it, as the bits of one number; none for what is beyond an end."""
    at = np.zeros((len(classes), CLASSES + 1), np.uint64)
    each = np.arange(len(classes))
    for k in range(WORD):
        at[each, classes[:, k]] |= _BIT[k]
    at[:, CLASSES] = 0
    return at


def _in_order(left: np.ndarray, places: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of classes of each ``left[i]`` and the text behind ``places[j]``, by bits (Hyyroe 2004)."""
    flat, width = places.ravel(), places.shape[1]
    most = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 13):
        some = slice(k, k + (1 << 13))
        letters, base = np.ascontiguousarray(left[i[some]].T), j[some] * width
        free = np.full(len(base), ~np.uint64(0))
        for letter in letters:
            met = free & flat[base + letter]
            free = (free + met) | (free - met)
        most[some] = np.bitwise_count(~free)
    return most


def _least_counts(need: float, lengths: np.ndarray, others: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """For texts of each length against each other one, the least m of m / p + m / q >= ``need``, as a number of the given kind."""
    share = np.divide(1, lengths, out=np.zeros(len(lengths)), where=lengths > 0)[:, None] + np.divide(1, others, out=np.zeros(len(others)), where=others > 0)
    least = np.divide(need, share, out=np.full(share.shape, np.inf if need > 0 else 0.0), where=share > 0)
    return np.clip(np.ceil(least - 1e-9), 0, np.iinfo(dtype).max).astype(dtype)


def similar_among(left: list[str], right: list[str] | None, threshold: float, strip: int = 256) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of the pairs whose Jaro-Winkler similarity reaches ``threshold``; without ``right``, pairs i < j of ``left``.

    Only pairs with enough characters in common, counted for a strip of ``left`` against all of ``right`` at once, are compared, and of these
    only the ones with enough in the same order: common characters that are not moved are a common subsequence. With m common ones of which at most
    e are in order, the best is at the most m there are or at m = e + 1, since m / p + m / q + e / (2 m) has no peak between.
    """
    needs = _least_common(threshold)
    la, a, head_a, letters = _counted(left)
    lb, b, head_b, other_letters = (la, a, head_a, letters) if right is None else _counted(right)
    places = _places(other_letters)
    other = left if right is None else right
    shares = [np.divide(1, n, out=np.zeros(len(n)), where=n > 0) for n in (la, lb)]
    used = np.flatnonzero(a.any(0) & b.any(0))
    wide = np.promote_types(a.dtype, b.dtype)
    columns = [np.ascontiguousarray(b[:, k]) for k in used]
    kinds, kind = np.unique(la, return_inverse=True)
    least_common = [_least_counts(need - 1e-4, kinds, lb, wide) for need in (needs[0], needs[1], needs[-1])]
    starts = [np.ascontiguousarray(side[:, :2].T) for side in (letters, other_letters)]
    held = np.empty((2, min(strip, len(left)), len(other)), wide)  # small numbers in the same memory, the costliest part of all
    found = []
    for at in range(0, len(left), strip):
        some = slice(at, at + strip)
        common, less = held[:, :len(la[some])]
        common[:] = 0
        for k, column in zip(used, columns):
            common += np.minimum(a[some, k, None], column, out=less)
        bounds = [least[kind[some]] if len(kinds) > 1 else least for least in least_common]
        begun = starts[0][0, some, None] == starts[1][0]
        close = (common >= bounds[1]) & begun
        begun &= starts[0][1, some, None] == starts[1][1]
        close |= (common >= bounds[2]) & begun
        close |= common >= bounds[0]
        i, j = np.divmod(np.flatnonzero(close), len(other))
        if right is None:
            i, j = i[i + at < j], j[i + at < j]
        equal = np.cumprod((head_a[some][i] == head_b[j]) & (head_b[j] >= 0), axis=1).sum(1)
        least = np.array(needs)[equal]
        share = shares[0][i + at] + shares[1][j]
        m = np.maximum(common[i, j], 1).astype(np.float64)
        hopeful = m * share + 1e-4 >= least
        i, j, least, share, m = i[hopeful] + at, j[hopeful], least[hopeful], share[hopeful], m[hopeful]
        ordered = np.minimum(_in_order(letters, places, i, j) + 1, m)
        best = np.maximum(m * share - (1 - ordered / m) / 2, ordered * share) + 1e-4
        hopeful = (best >= least) | (la[i] > WORD) | (lb[j] > WORD)
        i, j = i[hopeful], j[hopeful]
        for k in range(0, len(i), 2048):
            x, y = i[k:k + 2048].tolist(), j[k:k + 2048].tolist()
            near = jaro_winkler_many([left[n] for n in x], [other[n] for n in y]) >= threshold
            found += [(x[n], y[n]) for n in np.flatnonzero(near)]
    return found


def similar_in_cells(cells: DataFrame, keys: list[str], column: str, threshold: float) -> DataFrame:
    """``keys, <column>_l, <column>_r``: similar pairs between the texts of ``_part`` = ``_i`` and those of ``_part`` = ``_j``, each cell of
    (keys, ``_i``, ``_j``) on its own; pairs within the part where the two are one."""
    types = {f.name: f.dataType for f in cells.schema.fields}
    names = [*keys, f"{column}_l", f"{column}_r"]
    schema = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])

    def compare(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        i, j = key[-2:]
        left = cell.loc[cell["_part"] == i, column].tolist()
        right = None if i == j else cell.loc[cell["_part"] == j, column].tolist()
        other = left if right is None else right
        pairs = [(left[x], other[y]) for x, y in similar_among(left, right, threshold)]
        return pd.DataFrame([(*key[:-2], *p) for p in pairs], columns=names)

    return cells.groupBy(*keys, "_i", "_j").applyInPandas(compare, schema)


def jaro_winkler(left: str | Column, right: str | Column) -> Column:
    """Jaro-Winkler similarity; equal pairs are decided in the JVM and never reach Python."""
    a, b = col(left), col(right)
    differing = a != b
    return F.when(a == b, F.lit(1.0)).otherwise(_jaro_winkler(F.when(differing, a), F.when(differing, b)))


def _least_jaro(threshold: float) -> float:
    """The smallest plain Jaro score that can still reach ``threshold`` once the prefix is credited."""
    most = PREFIX_WEIGHT * PREFIX_LENGTH
    return max(min(threshold, BOOST_ABOVE), (threshold - most) / (1 - most))


# Letters from rare to common in English names. Repeats of a letter count as rarer still. The order
# only steers how selective the tokens are.
_RARE_FIRST = {c: i for i, c in enumerate("JQXZKVBPYGFWMUCLDRHSNIOATE")}


def letter_tokens(value: str, threshold: float, lengths: list[int]) -> list[str]:
    """Prefix-filter tokens for Jaro-Winkler >= ``threshold`` against values of the given ``lengths``.

    A Jaro score s over lengths p and q needs m common letters with m/p + m/q >= 3s - 1.
    Two bags of letters with at least m in common share one among the first
    (length - m + 1) of each, in any fixed letter order. Tokens carry both lengths,
    because m depends on them. Without a common first letter the Jaro score itself must
    reach the threshold; with one, a lower score may do, and the token names the letter.
    """
    n = len(value)
    if n == 0:
        return []
    seen: dict[str, int] = {}
    tagged = []
    for ch in value:
        seen[ch] = seen.get(ch, 0) + 1
        tagged.append((-seen[ch], _RARE_FIRST.get(ch, -1), ch))
    tagged.sort()
    tokens = []
    for jaro, family in ((threshold, ""), (_least_jaro(threshold), value[0])):
        need = 3 * jaro - 1
        for other in lengths:
            if other == 0:
                continue
            common = max(1, math.ceil(need * n * other / (n + other) - 1e-9))
            if common <= min(n, other):
                pair = f"{family}.{min(n, other)}.{max(n, other)}."
                tokens += [f"{pair}{ch}{-k}" for k, _, ch in tagged[: n - common + 1]]
    return tokens


def jaro_winkler_tokens(c: str | Column, threshold: float, lengths: list[int]) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict = {}
        for values in batches:
            yield pd.Series([
                None if v is None else remember(memo, v, lambda: letter_tokens(v, threshold, lengths)) for v in values
            ], dtype="object")

    return tokens(col(c))


def _one_shorter(s: Column) -> Column:
    dropped = F.transform(
        F.sequence(F.lit(1), F.length(s)),
        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.when(F.length(s) > 0, dropped).otherwise(F.array().cast("array<string>"))


def edit_tokens(c: str | Column, distance: int) -> Column:
    """The value with up to ``distance`` characters deleted: values that many edits apart share one."""
    s = col(c)
    reached = F.array(s)
    for _ in range(distance):
        reached = F.array_distinct(F.concat(reached, F.flatten(F.transform(reached, _one_shorter))))
    return F.when(s.isNotNull(), reached)


def day_tokens(c: str | Column, days: int) -> Column:
    """Two neighbouring buckets of a date: dates up to ``days`` apart share one."""
    bucket = F.floor(F.unix_date(col(c)) / (days + 1))
    return F.when(col(c).isNotNull(), F.array(bucket.cast("string"), (bucket + 1).cast("string")))
