"""Similarities of two columns.

Set measures and Levenshtein are JVM expressions.  The indel ratio family and
Jaro-Winkler have none in Spark: Arrow-batched UDFs, to be used after candidates are cut.
They run over whole batches in numpy: strings are rows of a matrix of code points, and a step
of the recurrence is a step for all pairs of a batch.  Equal pairs of a batch are computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .text import tokens

Strings = list[str]
_BATCH, _WINDOWS = 2048, 20_000


def _matrix(strings: Strings, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a string, filled up with ``fill``; and lengths."""
    n = np.array(list(map(len, strings)), np.int64)
    out = np.full((len(strings), int(n.max(initial=0))), fill, np.uint32)
    out[np.arange(out.shape[1])[None] < n[:, None]] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    return out, n


def _batches(a: Strings, b: Strings) -> Iterator[np.ndarray]:
    """Pairs of like lengths together."""
    order = np.lexsort((np.array(list(map(len, b)), np.int64), np.array(list(map(len, a)), np.int64)))
    for at in range(0, len(order), _BATCH):
        yield order[at : at + _BATCH]


def lcs_lengths(a: Strings, b: Strings) -> np.ndarray:
    """Length of the longest common subsequence of every pair: a row of the table at a time, for all pairs."""
    out = np.zeros(len(a), np.int64)
    for own in _batches(a, b):
        x, _ = _matrix([a[i] for i in own], 0xFFFFFFFF)
        y, _ = _matrix([b[i] for i in own], 0xFFFFFFFE)
        row = np.zeros((len(own), x.shape[1] + 1), np.int32)
        for j in range(y.shape[1]):
            best = np.maximum(row[:, 1:], row[:, :-1] + (x == y[:, j : j + 1]))
            np.maximum.accumulate(best, axis=1, out=row[:, 1:])
        out[own] = row[:, -1]
    return out


def indel_ratios(a: Strings, b: Strings) -> np.ndarray:
    """200 LCS / (both lengths); 100 for two empty strings."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    return np.where(total == 0, 100.0, 200.0 * lcs_lengths(a, b) / np.maximum(total, 1))


def best_windows(a: Strings, b: Strings) -> np.ndarray:
    """Best ratio of the shorter string with the longer one's windows, those cut off at its ends included."""
    out = np.zeros(len(a))
    held: list[tuple[int, str, str]] = []

    def spend() -> None:
        if held:
            which, short, window = zip(*held, strict=True)
            np.maximum.at(out, np.array(which), indel_ratios(list(short), list(window)))
            held.clear()

    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        short, long = sorted((x, y), key=len)
        n = len(short)
        if short in long:
            out[k] = 100.0 if short or not long else 0.0
            continue
        held += [(k, short, w) for w in {long[max(0, i) : i + n] for i in range(1 - n, len(long))}]
        if len(held) > _WINDOWS:
            spend()
    spend()
    return out


def winklers(a: Strings, b: Strings) -> np.ndarray:
    """Jaro-Winkler: a bonus of 0.1 a common leading letter (4 at most) where Jaro is over 0.7."""
    out = np.zeros(len(a))
    for own in _batches(a, b):
        x, n = _matrix([a[i] for i in own], 0xFFFFFFFF)
        y, m = _matrix([b[i] for i in own], 0xFFFFFFFE)
        k, rows, places = len(own), np.arange(len(own)), np.arange(y.shape[1])[None]
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)[:, None]
        used, hits = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
        for i in range(x.shape[1] if y.shape[1] else 0):
            same = (y == x[:, i : i + 1]) & ~used & (np.abs(places - i) <= reach)
            first = same.argmax(1)
            hits[:, i] = same[rows, first]
            used[rows[hits[:, i]], first[hits[:, i]]] = True
        both = hits.sum(1)
        left, right = (np.zeros((k, int(both.max(initial=0)) + 1), np.uint32) for _ in range(2))
        for to, text, mask in ((left, x, hits), (right, y, used)):
            r, c = np.nonzero(mask)
            to[r, (np.cumsum(mask, 1) - 1)[r, c]] = text[r, c]
        turned = (left != right).sum(1) // 2
        some = np.maximum(both, 1)
        jaro = np.where(both > 0, (both / np.maximum(n, 1) + both / np.maximum(m, 1) + (both - turned) / some) / 3, 0.0)
        width = min(4, x.shape[1], y.shape[1])
        lead = np.cumprod(x[:, :width] == y[:, :width], 1).sum(1) if width else np.zeros(k)
        equal = np.array([a[i] == b[i] for i in own])
        out[own] = np.where(equal, 1.0, np.where(jaro > 0.7, jaro + 0.1 * lead * (1 - jaro), jaro))
    return out


def token_sort_ratios(a: Strings, b: Strings) -> np.ndarray:
    ordered = lambda s: " ".join(sorted(s.split()))
    return indel_ratios(list(map(ordered, a)), list(map(ordered, b)))


def token_set_ratios(a: Strings, b: Strings) -> np.ndarray:
    """100 if one side's words are among the other's; else the best of intersection and differences joined to it; 0 without words."""
    out, ask = np.zeros(len(a)), []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = set(x.split()), set(y.split())
        if not p or not q:
            continue
        both, only_p, only_q = (" ".join(sorted(s)) for s in (p & q, p - q, q - p))
        if both and (not only_p or not only_q):
            out[k] = 100.0
            continue
        with_p, with_q = f"{both} {only_p}".strip(), f"{both} {only_q}".strip()
        ask.append((k, with_p, with_q))
        if both:
            ask += [(k, both, with_p), (k, both, with_q)]
    if ask:
        which, left, right = zip(*ask, strict=True)
        np.maximum.at(out, np.array(which), indel_ratios(list(left), list(right)))
    return out


def distinct_pairs(function: Callable[[Strings, Strings], np.ndarray], a: Strings, b: Strings) -> np.ndarray:
    """The function over each distinct pair once."""
    known = {k: i for i, k in enumerate(dict.fromkeys(zip(a, b, strict=True)))}
    if not known:
        return np.empty(0)
    left, right = zip(*known, strict=True)
    return function(list(left), list(right))[[known[k] for k in zip(a, b, strict=True)]]


def _pairwise(function: Callable[[Strings, Strings], np.ndarray]):
    @pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(distinct_pairs(function, a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    return run


ratio, partial_ratio, jaro_winkler, token_sort_ratio, token_set_ratio = map(_pairwise, (indel_ratios, best_windows, winklers, token_sort_ratios, token_set_ratios))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def set_counts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Sizes of intersection and of both sets."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def jaccard(a: Column, b: Column) -> Column:
    both, n, m = set_counts(a, b)
    return F.when(n + m - both > 0, both / (n + m - both)).otherwise(F.lit(-1.0))


def precision_recall(a: Column, b: Column) -> tuple[Column, Column]:
    """Shared share of b's and of a's tokens; -1 where there are none."""
    both, n, m = set_counts(a, b)
    return F.when(m > 0, both / m).otherwise(F.lit(-1.0)), F.when(n > 0, both / n).otherwise(F.lit(-1.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, -1 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(-1.0))


def equal_flag(a: Column, b: Column) -> Column:
    """1 equal, 0 different, -1 where a side is missing or empty."""
    return F.when(F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe(""), -1).when(a == b, 1).otherwise(0)


def trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
