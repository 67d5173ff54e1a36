"""Repair of words that mix Latin and Cyrillic letters of the same shape."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pairloom.functions.text import CYRILLIC_SHAPES, LATIN_SHAPES

_TO_CYR, _TO_LAT = str.maketrans(LATIN_SHAPES, CYRILLIC_SHAPES), str.maketrans(CYRILLIC_SHAPES, LATIN_SHAPES)
_WORD = re.compile("[A-Za-zА-Яа-яЁё]{3,}")


class CharModel:
    """Trigram likelihood with add-one smoothing over two-letter contexts."""

    def __init__(self, counts: dict[str, int]):
        self.n = counts
        self.context: dict[str, int] = {}
        for g, c in counts.items():
            self.context[g[:2]] = self.context.get(g[:2], 0) + c

    def loss(self, text: str) -> float:
        """Mean negative log-likelihood; texts under three characters cost nothing."""
        t = " ".join(text.lower().split())
        grams = [t[i : i + 3] for i in range(len(t) - 2)]
        return sum(-math.log((self.n.get(g, 0) + 1) / (self.context.get(g[:2], 0) + 60)) for g in grams) / len(grams) if grams else 0.0

    def fix(self, text: str, around: int = 2) -> tuple[str, int]:
        """The text with each mixed word in the likelier alphabet (ties stay), and how many changed."""
        out, at, n = [], 0, 0
        for m in _WORD.finditer(text):
            w = m[0]
            if w.isascii() or not re.search("[A-Za-z]", w):
                continue
            before, after = text[max(0, m.start() - around) : m.start()], text[m.end() : m.end() + around]
            cyr, lat = w.translate(_TO_CYR), w.translate(_TO_LAT)
            a, b = self.loss(f" {before}{cyr}{after} "), self.loss(f" {before}{lat}{after} ")
            best = cyr if a < b else lat if b < a else w
            if best != w:
                out += [text[at : m.start()], best]
                at = m.end()
                n += 1
        return "".join([*out, text[at:]]), n


def repair(df: DataFrame, text: str, trigrams: DataFrame) -> DataFrame:
    """``df`` with ``fixed`` and ``n_fixed``; null texts stay null with 0.

    Every word of a text is looked at, wherever it stands. The model is a table
    of at most 59^3 trigrams, small enough to hand to every task.
    """
    model = CharModel({r[0]: r[1] for r in trigrams.collect()})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            done = [(None, 0) if t is None else model.fix(t) for t in p[text]]
            yield p.assign(fixed=[x for x, _ in done], n_fixed=[n for _, n in done])

    return df.mapInPandas(run, f"{', '.join(f'{n} {t}' for n, t in df.dtypes)}, fixed string, n_fixed int")
