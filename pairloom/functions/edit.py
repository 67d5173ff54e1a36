"""Edit-distance similarities as Arrow-batched UDFs; Spark has none of them.

Each takes two text columns and gives null where either is null. Repeated value
pairs in a batch are computed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, with one wide integer operation per character of ``b``."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty texts are equal."""
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def lcs_share(a: str, b: str) -> float:
    """Common subsequence over the longer length; 0 for two empty texts."""
    most = max(len(a), len(b))
    return lcs_length(a, b) / most if most else 0.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_parts(a: str, b: str) -> tuple[str, str, str]:
    sa, sb = set(a.split()), set(b.split())
    return " ".join(sorted(sa & sb)), " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))


def token_set(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either rest; 0 without words."""
    if not a.split() or not b.split():
        return 0.0
    both, ra, rb = _token_parts(a, b)
    if both and (not ra or not rb):
        return 1.0
    with_a, with_b = (f"{both} {r}" if both else r for r in (ra, rb))
    found = ratio(with_a, with_b)
    if both:
        found = max(found, ratio(both, with_a), ratio(both, with_b))
    return found


def partial(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter text with a stretch of the longer, stretches at the ends may be shorter.

    What cannot exceed ``least`` is not searched, so a lower best may come out as any value up to that.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n, need, held, both = len(a), Counter(a), Counter(), 0
    stretches = []
    for i in range(1 - n, len(b)):
        # what a stretch shares with the text as a multiset bounds their subsequence
        if i + n <= len(b):
            c = b[i + n - 1]
            held[c] += 1
            both += held[c] <= need[c]
        if i > 0:
            c = b[i - 1]
            both -= held[c] <= need[c]
            held[c] -= 1
        lo, hi = max(0, i), min(i + n, len(b))
        if b[hi - 1] in need or b[lo] in need:
            stretches.append((2.0 * both / (n + hi - lo), lo, hi))
    best = max(0.0, least)
    # places in the shorter text of each letter of the longer, found once for all stretches
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    places, full = [at.get(c, 0) for c in b], (1 << n) - 1
    for bound, lo, hi in sorted(stretches, reverse=True):
        if bound <= best:
            break
        s = full
        for p in places[lo:hi]:
            if p:
                u = s & p
                s = ((s + u) | (s - u)) & full
        best = max(best, 2.0 * (n - s.bit_count()) / (n + hi - lo))
    return best


def weighted(a: str, b: str) -> float:
    """The best of plain, token and (for unlike lengths) partial ratios, each scaled by its reliability."""
    if not a or not b:
        return 0.0
    quotient = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if quotient < 1.5:
        return max(best, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if quotient <= 8 else 0.6
    both, ra, rb = _token_parts(a, b)
    by_token = 1.0 if both else max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial(ra, rb))
    return max(best, partial(a, b) * scale, by_token * 0.95 * scale)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by up to four equal first characters where it is above 0.7."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    # places of each character as bits of one wide integer
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    free, mine = (1 << len(b)) - 1, []
    for i, c in enumerate(a):
        here = at.get(c, 0) & free
        if here:
            lo = max(0, i - reach)
            here = here >> lo & (1 << max(min(len(b), i + reach + 1) - lo, 0)) - 1
            if here:
                free ^= (here & -here) << lo
                mine.append(c)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for j, c in enumerate(b) if not free >> j & 1]
    moved = sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro > 0.7:
        prefix = 0
        while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
            prefix += 1
        jaro += prefix * 0.1 * (1 - jaro)
    return jaro


def unlike_part(a: str, b: str) -> tuple[str, str]:
    """Both texts without what they begin and end with alike."""
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    a, b = a[k:], b[k:]
    k = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        k += 1
    return a[: len(a) - k], b[: len(b) - k]


def damerau_levenshtein(a: str, b: str) -> float:
    """Insertions, deletions, substitutions and swaps, where text may be edited between swapped letters."""
    # what both begin and end with costs nothing
    a, b = unlike_part(a, b)
    if not a or not b:
        return float(len(a) + len(b))
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, ca in enumerate(a, 1):
        met = 0
        row, above = d[i + 1], d[i]
        for j, cb in enumerate(b, 1):
            k, m = last.get(cb, 0), met
            if ca == cb:
                met = j
                cost = above[j]
            else:
                cost = above[j] + 1
            row[j + 1] = min(cost, row[j] + 1, above[j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[ca] = i
    return float(d[len(a) + 1][len(b) + 1])


def shared_items(a: list, b: list) -> float:
    """Size of the common multiset of two lists."""
    if len(a) > len(b):
        a, b = b, a
    left = Counter(a)
    return float(sum(min(n, k) for x, n in Counter(b).items() if (k := left.get(x))))


def _list_udf(fn: Callable[[list, list], float]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(fn(list(x), list(y))) for x, y in zip(a, b)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


def _udf(fn: Callable[[str, str], float]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            v = memo.get((x, y))
            if v is None:
                v = memo[x, y] = fn(x, y)
            out.append(v)
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


lcs_share_udf = _udf(lcs_share)
token_sort_udf = _udf(token_sort)
token_set_udf = _udf(token_set)
weighted_udf = _udf(weighted)
jaro_winkler_udf = _udf(jaro_winkler)
damerau_levenshtein_udf = _udf(damerau_levenshtein)
shared_items_udf = _list_udf(shared_items)
lcs_words_udf = _list_udf(lcs_length)
