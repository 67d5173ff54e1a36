"""Filling fixed-capacity containers with whole texts: exact-complement hashing.

Texts are packed by their length alone, so the plan is made on the histogram of
lengths: at most ``capacity`` numbers, however many texts there are. The plan
is a list of patterns (which lengths share a container) with multiplicities;
every text then finds its container from its rank among texts of its length.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ranking import global_rank
from pairloom.scratch import Scratch


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``(id, n_tokens)`` of every row by a public tokenizer's vocabulary file; null texts count 0.

    Special-token strings in a text are ordinary text.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(count, "id long, n_tokens long")


def pack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their multiplicities, using every item once.

    From the longest on, a length's gap to the capacity is looked up among the
    sums of one, two and three other lengths still available; a hit is consumed
    as often as all its counts allow. Lengths without an exact complement are
    placed best-fit: into the smallest sufficient gap, else into new containers.
    """
    left = Counter({n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0})
    exact: list[tuple[tuple[int, ...], int]] = []
    present = mirrored = 0  # bit n / bit capacity-n is set while length n is available

    def put(n: int, on: bool) -> None:
        nonlocal present, mirrored
        a, b = 1 << n, 1 << (capacity - n)
        present, mirrored = (present | a, mirrored | b) if on else (present & ~a, mirrored & ~b)

    for n in left:
        put(n, True)

    def pair(total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths, the greater at most ``most``, with this sum."""
        both = present & (mirrored >> (capacity - total)) & ((1 << min(most, total - 1) + 1) - 1)
        while both:
            a = both.bit_length() - 1
            if 2 * a < total:
                return None
            if 2 * a > total or left[a] > 1:
                return a, total - a
            both &= ~(1 << a)
        return None

    def complement(n: int) -> tuple[int, ...] | None:
        gap = capacity - n
        if gap == 0:
            return ()
        if gap <= n and left[gap] > (gap == n):
            return (gap,)
        two = pair(gap, min(n, gap)) if gap > 1 else None
        if two and usable((n, *two)):
            return two
        a_bits = present & ((1 << min(n, gap - 2) + 1) - 1) if gap > 2 else 0
        while a_bits:
            a = a_bits.bit_length() - 1
            if 3 * a < gap:
                break
            two = pair(gap - a, a)
            if two and usable((n, a, *two)):
                return (a, *two)
            a_bits &= ~(1 << a)
        return None

    def usable(items: tuple[int, ...]) -> bool:
        return all(left[x] >= k for x, k in Counter(items).items())

    for n in sorted(left, reverse=True):
        while left[n] > 0:
            rest = complement(n)
            if rest is None:
                break
            need = Counter((n, *rest))
            times = min(left[x] // k for x, k in need.items())
            exact.append(((n, *rest), times))
            for x, k in need.items():
                left[x] -= k * times
                if not left[x]:
                    put(x, False)
    # best fit, in bulk: containers with the same content are one entry
    gaps: dict[int, Counter] = {}
    for n in sorted((x for x in left if left[x] > 0), reverse=True):
        count = left[n]
        while count:
            fits = [g for g in gaps if g >= n]
            if fits:
                g = min(fits)
                content, many = next(iter(gaps[g].items()))
                take = min(many, count)
                gaps[g][content] -= take
                if not gaps[g][content]:
                    del gaps[g][content]
                if not gaps[g]:
                    del gaps[g]
                count -= take
                gaps.setdefault(g - n, Counter())[(*content, n)] += take
                continue
            per = capacity // n
            full, rest = divmod(count, per)
            if full:
                gaps.setdefault(capacity - per * n, Counter())[(n,) * per] += full
            if rest:
                gaps.setdefault(capacity - rest * n, Counter())[(n,) * rest] += 1
            count = 0
    fitted = [(content, many) for g in sorted(gaps) for content, many in sorted(gaps[g].items())]
    return exact + fitted


def pack(df: DataFrame, id_col: str, text: str, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """``(id, piece, start_token, n_tokens, container)``: every text in containers of ``capacity`` tokens.

    A text is one piece, or, where it alone exceeds the capacity, full pieces
    that fill containers and a rest that is packed like a text. No container
    holds more than ``capacity``. Texts without tokens take no room: container
    null. Rows with the same id are packed each. Empty input gives no rows.

    The driver sees the histogram of piece lengths (at most ``capacity`` rows)
    and the plan; the ranges of the plan are broadcast, at most a few rows per
    distinct length. Ranks within a length are spread over range partitions, so
    a length that very many texts share is no hot key.
    """
    scratch = Scratch(df.sparkSession, "pack")
    counts = scratch.save(token_counts(df, id_col, text, vocabulary))
    n_pieces = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))
    pieces = counts.select("id", "n_tokens", F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * capacity).cast("long").alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("long").alias("len"))
    hist = {r[0]: r[1] for r in pieces.where("len > 0").groupBy("len").agg(F.count(F.lit(1))).collect()}
    slots, base = [], 0
    used: Counter = Counter()
    for content, many in pack_plan(hist, capacity):
        for n, per in sorted(Counter(content).items()):
            slots.append((n, used[n], used[n] + per * many, per, base))
            used[n] += per * many
        base += many
    spark = df.sparkSession
    ranges = spark.createDataFrame(slots or [(None,) * 5], "len long, lo long, hi long, per long, base long")
    per_len = ranges.groupBy("len").agg(F.array_sort(F.collect_list(F.struct("hi", "lo", "per", "base"))).alias("r"))
    ranked = global_rank(pieces, scratch, [F.asc("id"), F.asc("piece")], "rank", by=["len"])
    # ranges: a few per distinct length, of which there are at most ``capacity``
    found = ranked.join(F.broadcast(per_len), "len", "left").withColumn("s", F.get(F.filter("r", lambda r: r["hi"] >= F.col("rank")), 0))
    container = F.col("s.base") + F.floor((F.col("rank") - 1 - F.col("s.lo")) / F.col("s.per")).cast("long")
    return found.select("id", "piece", "start_token", F.col("len").alias("n_tokens"), container.alias("container"))
