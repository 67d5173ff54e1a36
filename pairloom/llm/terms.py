"""Canonical terms of product listings: model codes, measures and words.

Sellers write one thing in many ways: ``KRT-1801 Lite`` and ``krt1801lite``,
``10 Ah`` and ``10000 мАч``, ``Магист`` and ``Magist``, with look-alike letters
of the other alphabet mixed in. A canonical term is equal for all of them.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata

# Latin letters for Cyrillic ones of the same shape, and the other way round.
LOOKALIKE = dict(zip("авекмнорстухь", "abekmhopctyxb"))
TO_CYRILLIC = {"a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "k": "к", "m": "м", "o": "о", "p": "р", "t": "т", "x": "х", "y": "у"}

# Transliteration of Cyrillic letters.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

# Units by quantity, each with its factor to the base unit.
UNITS = {
    "data": {"gb": 1, "гб": 1, "гиг": 1, "гига": 1, "gig": 1, "гигабайт": 1, "tb": 1024, "тб": 1024, "mb": 1 / 1024, "мб": 1 / 1024},
    "charge": {"mah": 1, "мач": 1, "ah": 1000, "ач": 1000},
    "length": {"мм": 1, "mm": 1, "см": 10, "cm": 10, "м": 1000, "m": 1000, "дюймов": 25.4, "дюйма": 25.4, "дюйм": 25.4, "inch": 25.4, "inches": 25.4, "in": 25.4, '"': 25.4},
    "power": {"вт": 1, "w": 1, "ватт": 1, "watt": 1, "квт": 1000, "kw": 1000},
    "mass": {"г": 1, "g": 1, "гр": 1, "грамм": 1, "кг": 1000, "kg": 1000, "кило": 1000},
    "volume": {"мл": 1, "ml": 1, "л": 1000, "l": 1000, "литр": 1000, "литра": 1000, "литров": 1000},
    "count": {"шт": 1, "pcs": 1, "предметов": 1, "предмета": 1, "pieces": 1},
    "size": {"размер": 1, "size": 1, "ru": 1},
}
_UNIT = {u: (q, f) for q, us in UNITS.items() for u, f in us.items()}
_UNIT_ALT = "|".join(sorted(map(re.escape, _UNIT), key=len, reverse=True))

# Words and letters that mark a variant of a model.
SUFFIXES = ("s", "x", "se", "air", "lite", "max", "mini", "plus", "pro", "ultra")

_TAG = re.compile(r"<[^<>]{1,200}>")
_NUM = r"\d+(?:[.,]\d+)?"
_INCH = re.compile(r"(\d)\s*(?:''|″|”|\")")
_MEASURE = re.compile(rf"(?<![\w.,/])({_NUM})[\s\-]*({_UNIT_ALT})(?![\w])")
_AMP = re.compile(r"(?<=\d)\s*([мm]?)\s*[аa]\s*[·.*⋅∙•]?\s*([чh])(?!\w)")
_SIZE_FIRST = re.compile(r"(?:размер|size|р-р|р\.)\s*:?\s*(\d{2}(?:[.,]5)?)(?![\w])")
_COUNT_FIRST = re.compile(r"(?:на|of)\s+(\d+)\s+(?:предметов|предмета|pieces|pcs)")
_TYRE = re.compile(r"(?<!\d)(\d{3})\s*[/\s-]\s*(\d{2})\s*[/\s-]?\s*[rр]\s*(\d{2})(?!\d)")
_L = "a-z" + "".join(LOOKALIKE)
_CODE = re.compile(rf"(?<![^\W_])([{_L}]{{2,5}})[ \-]?(\d{{1,5}})(?:([ \-]?)([{_L}]{{1,5}}))?(?![^\W_])")
_NUMBER_BEFORE = re.compile(r"\d[ \-]?\Z")
_TO_LATIN = str.maketrans(LOOKALIKE)
_WORD = re.compile(r"[^\W_]+")
_CYR, _LAT = re.compile("[а-я]"), re.compile("[a-z]")
_MIXED = re.compile(r"[а-я][^\W_a-zа-я]*[a-z]|[a-z][^\W_a-zа-я]*[а-я]")


def plain(text: str | None) -> str:
    """Lower-case text without markup, entities and compatibility forms."""
    if not text:
        return ""
    t = html.unescape(html.unescape(text)) if "&" in text else text
    t = unicodedata.normalize("NFKC", _TAG.sub(" ", t)).lower()
    return t.replace("ё", "е").replace("\u00ad", "").replace("\u200b", "")


def one_script(word: str) -> str:
    """A word that mixes alphabets, wholly in the one that fits more of its letters."""
    if not (_CYR.search(word) and _LAT.search(word)):
        return word
    as_cyr = "".join(TO_CYRILLIC.get(c, c) for c in word)
    if not _LAT.search(as_cyr):
        as_lat = "".join(LOOKALIKE.get(c, c) for c in word)
        return as_cyr if _CYR.search(as_lat) or sum(map(bool, map(_CYR.match, word))) * 2 >= len(word) else as_lat
    return "".join(LOOKALIKE.get(c, c) for c in word)


def fold_scripts(text: str) -> str:
    """Each word of a lower-case text in one script (``one_script``)."""
    return _WORD.sub(lambda m: one_script(m[0]), text) if _MIXED.search(text) else text


def latin(word: str) -> str:
    """Transliterated, so that both spellings of a name are one term."""
    return "".join(LATIN.get(c, c) for c in word)


def number(s: str) -> float:
    return float(s.replace(",", "."))


def measures(text: str) -> set[str]:
    """``quantity:value`` in base units of every measure that the text states."""
    t = _AMP.sub(lambda m: " mah" if m[1] else " ah", text)
    t = _INCH.sub(r"\1 inch", t)
    out = {f"tyre:{a}/{b}r{c}" for a, b, c in _TYRE.findall(t)}
    for n, u in _MEASURE.findall(t):
        q, f = _UNIT[u]
        v = number(n) * f
        # 14 inches are also given as 35.6 cm
        out.add(f"{q}:{round(v) if q == 'length' else round(v, 1):g}")
    out.update(f"size:{number(n):g}" for n in _SIZE_FIRST.findall(t))
    out.update(f"count:{n}" for n in _COUNT_FIRST.findall(t))
    return out


def codes(text: str) -> list[tuple[str, str]]:
    """``(letters and digits, suffix)`` of every model code in the text.

    Letters that look Latin count as Latin, and only ``SUFFIXES`` are suffixes:
    another word behind the digits is ignored where it stands apart. Letters
    that are also a unit begin a code unless a number stands before them
    (``20 pcs 5``), few digits after them (``шт 5``) or they name the size.
    """
    out = []
    for m in _CODE.finditer(text):
        letters, digits, gap, tail = m.groups()
        a, s = letters.translate(_TO_LATIN), (tail or "").translate(_TO_LATIN)
        # two Cyrillic letters before a number are a preposition, not a code
        if len(letters) == 2 and not _LAT.search(letters) or s not in SUFFIXES and s and not gap:
            continue
        if a in _UNIT and (_UNIT[a][0] == "size" or len(digits) < 3 or _NUMBER_BEFORE.search(text, 0, m.start())):
            continue
        out.append((a + digits, s if s in SUFFIXES else ""))
    return out


def attributes(text: str | None) -> dict:
    """The attributes' members; of cut-off JSON those that still are whole."""
    if not text:
        return {}
    try:
        got = json.loads(text)
        return got if isinstance(got, dict) else {}
    except (ValueError, RecursionError):
        return dict(re.findall(r'"([^"\\{}\[\]]+)"\s*:\s*"([^"\\]*)"', text))


def members(tree, skip: frozenset[str]):
    """``(key, scalar as text)`` of every member at any depth, but for what keys in ``skip`` hold; depth-first."""
    stack = [("", tree)]
    while stack:
        key, v = stack.pop()
        if isinstance(v, dict):
            stack += [(k, x) for k, x in reversed(v.items()) if plain(k).strip() not in skip]
        elif isinstance(v, list):
            stack += [(key, x) for x in reversed(v)]
        elif isinstance(v, str) or type(v) in (int, float):
            yield key, str(v)
