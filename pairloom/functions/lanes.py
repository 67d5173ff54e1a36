"""The similarities of ``edit`` and ``sets`` over many pairs of texts at once.

Pairs of like lengths are laid side by side, one lane each, and every step of a
method is one numpy operation over all lanes. Values are those of the scalar
functions; texts too long for lanes go through those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from pairloom.functions import edit as E

#: Lanes of a chunk, cells of its tables, and the longest text that is laid out.
LANES, CELLS, LONG = 2048, 1 << 21, 1024
ONES = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)


def codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def dense(*parts: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Characters as numbers from 1 without gaps, and the largest of them."""
    at = np.zeros(0x110000, dtype=bool)
    for p in parts:
        at[p] = True
    number = np.cumsum(at, dtype=np.int32)
    return [number[p] for p in parts], int(number[-1])


def laid(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One text a row, filled up with 0."""
    out = np.zeros((len(n), int(n.max(initial=0))), dtype=np.int32)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def chunks(xs: list[str], ys: list[str], step: int, cells: Callable[[int, int, int], int]) -> Iterator[tuple]:
    """Pairs of like lengths as ``(places, a, b, la, lb, letters)``; ``a`` and ``b`` hold one text a row.

    First texts of a chunk are alike in length by ``step``, second ones in order.
    ``cells`` gives the table entries of a pair for both lengths and the number of letters.
    """
    la, lb = lengths(xs), lengths(ys)
    fits = np.flatnonzero((la > 0) & (lb > 0) & (la <= LONG) & (lb <= LONG))
    group = (la - 1) // step
    order = fits[np.lexsort((lb[fits], group[fits]))]
    k = 0
    while k < len(order):
        at = order[k : k + LANES]
        at = at[group[at] == group[at[0]]]
        (fa, fb), top = dense(codes([xs[i] for i in at]), codes([ys[i] for i in at]))
        most = max(1, CELLS // max(1, cells(int(la[at].max()), int(lb[at].max()), top)))
        if len(at) > most:
            at = at[:most]
            (fa, fb), top = dense(codes([xs[i] for i in at]), codes([ys[i] for i in at]))
        yield at, laid(fa, la[at]), laid(fb, lb[at]), la[at], lb[at], top
        k += len(at)


def _places(a: np.ndarray, top: int) -> np.ndarray:
    """For each 64 places, the places of each letter in each lane's text as bits, at lane * (top + 1) + letter."""
    lanes, wide = a.shape
    words = (wide + 63) // 64
    out = np.zeros((words, lanes * (top + 1)), dtype=np.uint64)
    base = np.arange(lanes) * (top + 1)
    for j in range(wide):
        # a lane's text has one letter at a place, so no entry is written twice
        out[j // 64][base + a[:, j]] |= np.uint64(1 << j % 64)
    out[:, base] = 0
    return out


def lcs_lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """``edit.lcs_length`` of each pair."""
    out = np.zeros(len(xs), dtype=np.int64)
    for i, (x, y) in enumerate(zip(xs, ys)):
        if len(x) > LONG or len(y) > LONG:
            out[i] = E.lcs_length(x, y)
    for at, a, b, _, _, top in chunks(xs, ys, 64, lambda p, q, t: (p // 64 + 1) * (t + 1)):
        places = _places(a, top)
        words, base = len(places), np.arange(len(at)) * (top + 1)
        s = [np.full(len(at), ONES[64]) for _ in range(words)]
        for c in (b + base[:, None]).T:
            carry = None
            for w in range(words):
                m = places[w][c]
                u = s[w] & m
                total = s[w] + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                s[w] = total | (s[w] ^ u)
                carry = over.astype(np.uint64)
        out[at] = words * 64 - sum(np.bitwise_count(x).astype(np.int64) for x in s)
    return out


def jaro_winklers(xs: list[str], ys: list[str]) -> np.ndarray:
    """``edit.jaro_winkler`` of each pair."""
    out = np.zeros(len(xs))
    for i, (x, y) in enumerate(zip(xs, ys)):
        if len(x) > LONG or len(y) > LONG:
            out[i] = E.jaro_winkler(x, y)
    for at, b, a, lb, la, top in chunks(ys, xs, 64, lambda p, q, t: (p // 64 + 1) * (t + 1)):
        places = _places(b, top)
        words, base = len(places), np.arange(len(at)) * (top + 1)
        free = [ONES[np.clip(lb - 64 * w, 0, 64)] for w in range(words)]
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        met = np.zeros(a.shape, dtype=bool)
        for i, c in enumerate((a + base[:, None]).T):
            lo, hi = i - reach, i + reach + 1
            open_ = None
            for w in range(words):
                here = places[w][c] & free[w]
                here &= ONES[np.clip(hi - 64 * w, 0, 64)] & ~ONES[np.clip(lo - 64 * w, 0, 64)]
                if open_ is not None:
                    here[~open_] = 0
                first = here & (~here + np.uint64(1))
                free[w] = free[w] ^ first
                hit = first != 0
                met[:, i] |= hit
                open_ = ~hit if open_ is None else open_ & ~hit
        bits = np.stack(free, axis=1)
        j = np.arange(b.shape[1])
        theirs = ((bits[:, j // 64] >> (j % 64).astype(np.uint64)) & np.uint64(1) == 0) & (j < lb[:, None])
        m = met.sum(axis=1)
        lane = np.nonzero(met)[0]
        moved = np.bincount(lane, weights=a[met] != b[theirs], minlength=len(at)).astype(np.int64) // 2
        some = np.maximum(m, 1)
        jaro = (m / la + m / lb + (m - moved) / some) / 3
        k = min(4, a.shape[1], b.shape[1])
        prefix = np.cumprod((a[:, :k] == b[:, :k]) & (a[:, :k] > 0), axis=1).sum(axis=1)
        jaro = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
        out[at] = np.where(m > 0, jaro, 0.0)
    return out


def damerau_levenshteins(xs: list[str], ys: list[str]) -> np.ndarray:
    """``edit.damerau_levenshtein`` of each pair."""
    out = np.zeros(len(xs))
    cut = [E.unlike_part(x, y) for x, y in zip(xs, ys)]
    xs, ys = [x for x, _ in cut], [y for _, y in cut]
    for i, (x, y) in enumerate(cut):
        if not x or not y:
            out[i] = len(x) + len(y)
        elif len(x) > LONG or len(y) > LONG:
            out[i] = E.damerau_levenshtein(x, y)
    for at, a, b, la, lb, top in chunks(xs, ys, 16, lambda p, q, t: ((p + 2) * (q + 2) + t) // 8):
        lanes, wa, wb = len(at), a.shape[1], b.shape[1]
        if lanes < 8:
            for i in at:
                out[i] = E.damerau_levenshtein(xs[i], ys[i])
            continue
        lane = np.arange(lanes, dtype=np.int64)
        far = (la + lb).astype(np.int32)
        d = np.empty((wa + 2, wb + 2, lanes), dtype=np.int32)
        d[0], d[:, 0] = far, far
        d[1:, 1] = np.arange(wa + 1)[:, None]
        d[1, 1:] = np.arange(wb + 1)[:, None]
        flat = d.reshape(-1)
        last = np.zeros(lanes * (top + 1), dtype=np.int64)
        at_a, at_b = (np.ascontiguousarray((x + (lane * (top + 1))[:, None]).T) for x in (a, b))
        for i in range(1, wa + 1):
            ca, row, above = at_a[i - 1], d[i + 1], d[i]
            same = at_b == ca
            # where each lane's letter stood last in the row before place j
            stood = np.zeros((wb + 1, lanes), dtype=np.int64)
            np.maximum.accumulate(same * np.arange(1, wb + 1)[:, None], axis=0, out=stood[1:])
            k, m = last[at_b], stood[:-1]
            j = np.arange(1, wb + 1)[:, None]
            swap = flat[(k * (wb + 2) + m) * lanes + lane] + (i - k + j - m - 1)
            # the least but for what comes from the left in this row
            best = np.minimum(np.minimum(above[1:-1] + ~same, above[2:] + 1), swap)
            # an insertion costs 1 a place, so the row is a running minimum of costs less their places
            best -= j
            row[2:] = np.minimum(np.minimum.accumulate(best, axis=0), i) + j
            last[ca] = i
        out[at] = d[la + 1, lb + 1, lane]
    return out


def shared_letters(xs: list[str], ys: list[str]) -> np.ndarray:
    """Size of the common character multiset of each pair."""
    out = np.zeros(len(xs), dtype=np.int64)
    for k in range(0, len(xs), LANES):
        sides = xs[k : k + LANES], ys[k : k + LANES]
        n = len(sides[0])
        parts, top = dense(*map(codes, sides))
        # numbered by text and letter, so that texts of very many letters need no table
        keys, counts = zip(*(np.unique(np.repeat(np.arange(n), lengths(s)) * (top + 1) + p, return_counts=True) for s, p in zip(sides, parts)))
        both, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
        out[k : k + n] = np.bincount(both // (top + 1), weights=np.minimum(counts[0][i], counts[1][j]), minlength=n)
    return out


def _kept(keys: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def ngram_ious(xs: list[str], ys: list[str], most: int) -> list[np.ndarray]:
    """``sets.ngram_iou`` of the lower-case texts' character n-grams, n from 1 to ``most``; exact, without hashes."""
    out = [np.zeros(len(xs)) for _ in range(most)]
    for k in range(0, len(xs), LANES):
        rows = xs[k : k + LANES], ys[k : k + LANES]
        count = len(rows[0])
        texts = [*rows[0], *rows[1]]
        n = lengths(texts)
        (letters,), top = dense(codes(texts))
        letters = letters.astype(np.int64)
        side = np.repeat(np.arange(2 * count), n)
        left = np.repeat(np.cumsum(n), n) - np.arange(len(letters))  # letters from here to the text's end
        gram, size = letters, top + 1
        for g in range(1, most + 1):
            if g > 1:
                # numbers are packed while they fit beside the row, else made dense first
                if size * (top + 1) * (count + 1) >= 1 << 62:
                    seen, gram = np.unique(gram, return_inverse=True)
                    size = len(seen)
                gram = gram[:-1] * (top + 1) + letters[g - 1 :] if len(gram) else gram
                size *= top + 1
            ok = left[: len(gram)] >= g
            at, value = side[: len(gram)][ok], gram[ok]
            second = at >= count
            a, b = (_kept(value[s] + r * size) for s, r in ((~second, at[~second]), (second, at[second] - count)))
            na, nb = (np.bincount(x // size, minlength=count) for x in (a, b))
            both = np.sort(np.concatenate((a, b)))
            hit = np.bincount(both[1:][both[1:] == both[:-1]] // size, minlength=count)
            union = na + nb - hit
            out[g - 1][k : k + count] = np.where(union > 0, hit / np.maximum(union, 1), 0.0)
    return out


def similarities(xs: list[str], ys: list[str], wide: bool) -> dict[str, np.ndarray]:
    """The string similarities of each pair by name; ``wide`` adds those that only short texts get."""
    words = [(x.split(), y.split()) for x, y in zip(xs, ys)]
    ordered = [[" ".join(sorted(w[s])) for w in words] for s in (0, 1)]
    both, rests = [], ([], [])
    for p, q in words:
        p, q = set(p), set(q)
        both.append(" ".join(sorted(p & q)))
        rests[0].append(" ".join(sorted(p - q)))
        rests[1].append(" ".join(sorted(q - p)))
    withs = [[f"{b} {r}" if b else r for b, r in zip(both, rest)] for rest in rests]
    n = len(xs)
    la, lb = lengths(xs), lengths(ys)
    todo = [*ordered[0], *withs[0], *(xs if wide else [])], [*ordered[1], *withs[1], *(ys if wide else [])]
    common = lcs_lengths(*todo)
    total = lengths(todo[0]) + lengths(todo[1])
    found = np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)
    sort, sets = found[:n], found[n : 2 * n].copy()
    nb = lengths(both)
    for w in withs:
        # the shared words begin the longer text, so all of them are common
        sets = np.where(nb > 0, np.maximum(sets, 2.0 * nb / np.maximum(nb + lengths(w), 1)), sets)
    rest = [lengths(r) for r in rests]
    sets = np.where((nb > 0) & ((rest[0] == 0) | (rest[1] == 0)), 1.0, sets)
    sets = np.where([not p or not q for p, q in words], 0.0, sets)
    out = {"token_sort": sort, "token_set": sets, "jaro_winkler": jaro_winklers(xs, ys)}
    equal = np.fromiter((x == y for x, y in zip(xs, ys)), dtype=bool, count=n)
    shared = shared_letters(xs, ys)
    out["dice"] = np.where(equal, 1.0, 2.0 * shared / np.maximum(la + lb, 1))
    if wide:
        # the logarithm is left to Spark
        out["jaccard"] = np.where(equal, 1.0, np.where(shared > 0, shared / np.maximum(la + lb - shared, 1), np.nan))
        out["sorensen"] = out["dice"]
        out["subsequence"] = common[2 * n :] / np.maximum(np.maximum(la, lb), 1)
        out["damerau"] = damerau_levenshteins(xs, ys)
        plain = found[2 * n :]
        near = np.maximum(plain, 0.95 * np.maximum(sort, sets))
        near[(la == 0) | (lb == 0)] = 0.0
        quotient = np.maximum(la, lb) / np.maximum(np.minimum(la, lb), 1)
        for i in np.flatnonzero((quotient >= 1.5) & (la > 0) & (lb > 0)):
            near[i] = _far(xs[i], ys[i], float(plain[i]), 0.9 if quotient[i] <= 8 else 0.6, both[i], (ordered[0][i], ordered[1][i]), (rests[0][i], rests[1][i]))
        out["wratio"] = near
    return out


def _far(x: str, y: str, plain: float, scale: float, both: str, ordered: tuple, rests: tuple) -> float:
    """``edit.weighted`` of texts of unlike lengths; parts that cannot be the best are not searched."""
    best = plain
    if both:
        best = max(best, 0.95 * scale)
    else:
        for p, q in {ordered, rests}:
            best = max(best, E.partial(p, q, best / (0.95 * scale) - 1e-9) * 0.95 * scale)
    return max(best, E.partial(x, y, best / scale - 1e-9) * scale)


def strings_udf(full: tuple[str, ...], short: tuple[str, ...], most: int):
    """A struct of all similarities and n-gram shares over the texts of ``full`` and ``short``, given as first and second of each."""
    wide = ("token_sort", "token_set", "jaro_winkler", "dice", "jaccard", "sorensen", "damerau", "wratio", "subsequence")
    kind = StructType()
    for c in (*full, *short):
        for m in wide if c in full else wide[:4]:
            kind.add(f"{c}_{m}", DoubleType())
        if c in full:
            for n in range(1, most + 1):
                kind.add(f"{c}_iou_{n}", DoubleType())

    def run(*texts: pd.Series) -> pd.DataFrame:
        out: dict = {}
        for i, c in enumerate((*full, *short)):
            a, b = texts[2 * i], texts[2 * i + 1]
            # each distinct pair of texts once
            seen: dict = {}
            at = np.fromiter((seen.setdefault(p, len(seen)) for p in zip(a, b)), dtype=np.int64, count=len(a))
            whole = np.array([x is not None and y is not None for x, y in seen], dtype=bool)
            xs, ys = [x for x, y in seen if x is not None and y is not None], [y for x, y in seen if x is not None and y is not None]
            for m, v in similarities(xs, ys, c in full).items():
                put = np.full(len(seen), np.nan)
                put[whole] = v
                out[f"{c}_{m}"] = put[at]
            if c in full:
                low = [[(t or "").lower() for t in s] for s in zip(*seen)] if seen else [[], []]
                for n, v in enumerate(ngram_ious(low[0], low[1], most), 1):
                    out[f"{c}_iou_{n}"] = v[at]
        return pd.DataFrame({f.name: out[f.name] for f in kind.fields})

    def batches(it):
        for cols in it:
            yield run(*cols)

    batches.__annotations__ = {"it": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(batches, kind)
