"""Text cleaning and tokenising as native column expressions.

Null gives null everywhere unless stated. Regular expressions are written with
explicit Unicode classes, since the JVM's ``\\w`` and ``\\b`` are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
# The four emoji blocks that are removed.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
# Latin letters and the Cyrillic ones of the same shape.
LATIN_SHAPES, CYRILLIC_SHAPES = "eyopakxcETOPAHKXCBM", "еуоракхсЕТОРАНКХСВМ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Maximal runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(_col(c), F.lit(WORD), F.lit(0))


def split_blank(c: Column | str) -> Column:
    """Parts between runs of white space; an empty text has none."""
    return F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")


def clean_html_emoji(c: Column | str) -> Column:
    """Tags deleted, line breaks as blanks, emoji deleted, in this order."""
    t = F.regexp_replace(_col(c), "(?d)<.*?>", "")
    return F.regexp_replace(F.replace(t, F.lit("\n"), F.lit(" ")), EMOJI, "")


def extract_latin(c: Column | str) -> Column:
    """Lower-case words of ASCII letters only, joined by blanks."""
    return F.array_join(F.filter(words(F.lower(_col(c))), lambda w: w.rlike("^[a-z]+$")), " ")


def extract_mixed(c: Column | str) -> Column:
    """Words of Latin or Cyrillic letters and digits that have both letters and digits."""
    fits = lambda w: w.rlike("^[A-Za-zА-Яа-яЁё0-9]+$") & w.rlike("[0-9]") & w.rlike("[A-Za-zА-Яа-яЁё]")
    return F.array_join(F.filter(words(c), fits), " ")


def mixed_script_pct(c: Column | str) -> Column:
    """Per cent of white-space words with Cyrillic and Latin letters and no digit; 0 without words."""
    ws = split_blank(c)
    bad = F.filter(ws, lambda w: w.rlike("[а-яА-Я]") & w.rlike("[a-zA-Z]") & ~w.rlike("[0-9]"))
    return F.when(_col(c).isNull(), None).otherwise(F.coalesce(F.try_divide(F.size(bad) * F.lit(100.0), F.size(ws)), F.lit(0.0)))


def normalize_underscore(c: Column | str) -> Column:
    """Lower-case runs of letters and digits joined by underscores."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def lowered(c: Column | str) -> Column:
    return F.lower(F.trim(_col(c)))


def squeezed(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def token_length(c: Column | str) -> Column:
    """Single blanks plus one: an empty text counts 1, two blanks in a row an empty token."""
    t = _col(c)
    return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("int")


def digit_tokens(c: Column | str, more_than: int = 2) -> Column:
    """White-space tokens with more than ``more_than`` digits, joined by blanks; null as empty."""
    return F.coalesce(F.array_join(F.filter(split_blank(c), lambda w: F.regexp_count(w, F.lit("[0-9]")) > more_than), " "), F.lit(""))


def latin_runs(c: Column | str) -> Column:
    """Distinct runs of ASCII letters, also inside words; null as none."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z]+"), F.lit(0))), F.array().cast("array<string>"))


def char_ngrams(c: Column | str, n: int) -> Column:
    """Distinct character n-grams of the lower-case text; none for shorter or null texts."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    at = F.sequence(F.lit(1), F.length(t) - (n - 1))
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def char_tokenize(c: Column | str) -> Column:
    """Characters of the lower-case words apart, blanks as ``<space>``: a character model's input."""
    t = F.array_join(words(F.lower(_col(c))), " ")
    return F.array_join(F.transform(F.filter(F.split(t, ""), lambda x: x != ""), lambda x: F.when(x == " ", "<space>").otherwise(x)), " ")


def layout_fix(c: Column | str, threshold: float = 0.6) -> Column:
    """Words whose share of Latin letters is below ``threshold``, in Cyrillic shapes.

    Words are parts between white space and come back joined by one blank; a
    word without letters stays as it is.
    """

    def fix(w: Column) -> Column:
        latin = F.length(F.regexp_replace(w, "[^A-Za-z]", ""))
        letters = F.length(F.regexp_replace(w, r"[^\p{L}]", ""))
        return F.when((letters > 0) & (latin < letters * threshold), F.translate(w, LATIN_SHAPES, CYRILLIC_SHAPES)).otherwise(w)

    return F.array_join(F.transform(split_blank(c), fix), " ")


def name_variants(c: str, out: str) -> dict[str, Column]:
    """The cleaned, Latin-only and mixed variants of a text column, by output name.

    For each variant: ``_norm`` (underscored), ``_tokens`` (lower-case) and the
    squeezed text itself.
    """
    cols: dict[str, Column] = {}
    for suffix, base in (("", clean_html_emoji(c)), ("_en", clean_html_emoji(extract_latin(c))), ("_mix", extract_mixed(c))):
        cols[f"{out}{suffix}_norm"] = normalize_underscore(base)
        cols[f"{out}{suffix}_tokens"] = lowered(base)
        cols[f"{out}{suffix}"] = squeezed(lowered(base))
    return cols
