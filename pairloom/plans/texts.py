"""Queries: text cleaning, tokenising and prompt building over the pair table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.plans.base import IDS, Registry, pairs
from pairloom.sources.tables import table

R = Registry()
CATS = [f"category_level_{k}" for k in (1, 2, 3, 4)]

_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
S_WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+')"
S_BLANK = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def s_clean(c):
    return f"regexp_replace(replace(regexp_replace({c}, '<.*?>', '', 'g'), chr(10), ' '), '{_EMOJI}', '', 'g')"


def s_latin(c):
    return f"array_to_string(list_filter({S_WORDS.format(f'lower({c})')}, lambda w: regexp_full_match(w, '[a-z]+')), ' ')"


def s_mixed(c):
    return (
        f"array_to_string(list_filter({S_WORDS.format(c)}, lambda w: regexp_full_match(w, '[A-Za-zА-Яа-яЁё0-9]+')"
        " AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-zА-Яа-яЁё]')), ' ')"
    )


def s_norm(c):
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"


def s_squeeze(c):
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def s_lowered(c):
    return f"lower(trim({c}, ' '))"


def _sql(cols: str, source: str = "train_df") -> str:
    return f"SELECT variantid_1, variantid_2, {cols} FROM {source}"


def _both(fn, *names):
    """``fn`` over both sides of each named column."""
    return [fn(f"{n}_{k}").alias(f"{n}_{k}") for n in names for k in (1, 2)]


def _s_both(fn, *names):
    return ", ".join(f"{fn(f'{n}_{k}')} AS {n}_{k}" for n in names for k in (1, 2))


@R.add(_sql(_s_both(s_clean, "name", "description")))
def clean_html_emoji(spark, d):
    return pairs(spark, d).select(*IDS, *_both(T.clean_html_emoji, "name", "description"))


@R.add(_sql(_s_both(s_latin, "name", "description")))
def extract_latin(spark, d):
    return pairs(spark, d).select(*IDS, *_both(T.extract_latin, "name", "description"))


@R.add(_sql(_s_both(s_mixed, "name", "description")))
def extract_mixed(spark, d):
    return pairs(spark, d).select(*IDS, *_both(T.extract_mixed, "name", "description"))


def _s_mixed_pct(c):
    ws = S_BLANK.format(c)
    bad = f"list_filter({ws}, lambda w: regexp_matches(w, '[а-яА-Я]') AND regexp_matches(w, '[a-zA-Z]') AND NOT regexp_matches(w, '[0-9]'))"
    return f"CASE WHEN {c} IS NOT NULL THEN round(coalesce(len({bad}) * 100.0::DOUBLE / nullif(len({ws}), 0), 0), 6) END"


@R.add(_sql(_s_both(_s_mixed_pct, "name", "description")))
def mixed_script_pct(spark, d):
    return pairs(spark, d).select(*IDS, *_both(lambda c: F.round(T.mixed_script_pct(c), 6), "name", "description"))


@R.add(_sql(_s_both(s_norm, "name", "description")))
def normalize_underscore(spark, d):
    return pairs(spark, d).select(*IDS, *_both(T.normalize_underscore, "name", "description"))


def _variants_sql(suffix, base):
    cols = []
    for n in ("name", "description"):
        for k in (1, 2):
            b = base(f"{n}_{k}")
            cols += [f"{s_norm(b)} AS {n}{suffix}_norm_{k}", f"{s_lowered(b)} AS {n}{suffix}_tokens_{k}", f"{s_squeeze(s_lowered(b))} AS {n}{suffix}_{k}"]
    return _sql(", ".join(cols))


def _variants(spark, d, suffix):
    cols = []
    for n in ("name", "description"):
        for k in (1, 2):
            made = T.name_variants(f"{n}_{k}", "v")
            cols += [made[f"v{suffix}{kind}"].alias(f"{n}{suffix}{kind}_{k}") for kind in ("_norm", "_tokens", "")]
    return pairs(spark, d).select(*IDS, *cols)


@R.add(_variants_sql("", s_clean))
def normalize_names(spark, d):
    return _variants(spark, d, "")


@R.add(_variants_sql("_en", lambda c: s_clean(s_latin(c))))
def normalize_en(spark, d):
    return _variants(spark, d, "_en")


@R.add(_variants_sql("_mix", s_mixed))
def normalize_mix(spark, d):
    return _variants(spark, d, "_mix")


def _s_len(c):
    t = s_lowered(s_clean(c))
    return f"(length({t}) - length(replace({t}, ' ', '')) + 1)::INTEGER"


@R.add(_sql(_s_both(_s_len, "name", "description")))
def token_lengths(spark, d):
    return pairs(spark, d).select(*IDS, *_both(lambda c: T.token_length(T.lowered(T.clean_html_emoji(c))), "name", "description"))


def _s_digits(c):
    return f"coalesce(array_to_string(list_filter({S_BLANK.format(c)}, lambda w: len(regexp_extract_all(w, '[0-9]')) > 2), ' '), '')"


@R.add(_sql(_s_both(_s_digits, "name", "description")))
def digit_tokens(spark, d):
    return pairs(spark, d).select(*IDS, *_both(T.digit_tokens, "name", "description"))


def _s_chars(c):
    t = f"array_to_string({S_WORDS.format(f'lower({c})')}, ' ')"
    return f"array_to_string(list_transform(list_filter(string_split({t}, ''), lambda x: x <> ''), lambda x: CASE WHEN x = ' ' THEN '<space>' ELSE x END), ' ')"


@R.add(f"SELECT doc_id, {_s_chars('text')} AS chars FROM documents")
def char_tokenize(spark, d):
    """A character model's training lines, as its text sink writes them."""
    return table(spark, d, "documents").select("doc_id", T.char_tokenize("text").alias("chars"))


def _s_layout(c):
    latin, letters = "length(regexp_replace(w, '[^A-Za-z]', '', 'g'))", "length(regexp_replace(w, '[^\\p{L}]', '', 'g'))"
    fix = f"CASE WHEN {letters} > 0 AND {latin} < {letters} * 0.6 THEN translate(w, '{T.LATIN_SHAPES}', '{T.CYRILLIC_SHAPES}') ELSE w END"
    return f"array_to_string(list_transform({S_BLANK.format(c)}, lambda w: {fix}), ' ')"


@R.add(_sql(_s_both(_s_layout, "name", "description")))
def layout_fix(spark, d):
    return pairs(spark, d).select(*IDS, *_both(T.layout_fix, "name", "description"))


# prompts and exports


@R.add(
    _sql(
        ", ".join(f"coalesce(category_level_{k}_1, 'none') || '_' || coalesce(category_level_{k}_2, 'none') AS unique_cat_{k}" for k in (1, 2, 3, 4))
        + ", "
        + ", ".join(f"category_level_{k}_1 || '_' || category_level_{k}_2 AS plain_cat_{k}" for k in (1, 2, 3, 4))
    )
)
def category_concat(spark, d):
    """Both sides' categories as one, missing ones filled, and without filling."""
    df = pairs(spark, d)
    plain = [F.concat(df[f"{c}_1"], F.lit("_"), df[f"{c}_2"]).alias(f"plain_cat_{i}") for i, c in enumerate(CATS, 1)]
    cols = [F.concat(F.coalesce(f"{c}_1", F.lit("none")), F.lit("_"), F.coalesce(f"{c}_2", F.lit("none"))).alias(f"unique_cat_{i}") for i, c in enumerate(CATS, 1)]
    return df.select(*IDS, *cols, *plain)


def _prompt(k):
    path = F.concat_ws("->", *[F.coalesce(f"{c}_{k}", F.lit("none")) for c in CATS])
    return F.concat(F.lit("NAME: "), F.col(f"name_{k}"), F.lit("\nCATEGORY: "), path, F.lit("\nDESCRIPTION: "), F.col(f"description_{k}"))


def _s_prompt(k):
    path = " || '->' || ".join(f"coalesce({c}_{k}, 'none')" for c in CATS)
    return f"'NAME: ' || name_{k} || chr(10) || 'CATEGORY: ' || {path} || chr(10) || 'DESCRIPTION: ' || description_{k}"


@R.add(_sql(f"{_s_prompt(1)} AS text_1, {_s_prompt(2)} AS text_2"))
def prompt_biencoder(spark, d):
    """One text per side; a missing name or description makes it null."""
    return pairs(spark, d).select(*IDS, _prompt(1).alias("text_1"), _prompt(2).alias("text_2"))


def _cross(a, b):
    path = lambda k: F.concat_ws("->", *[F.coalesce(f"{c}_{k}", F.lit("none")) for c in CATS])
    parts = ["NAME1: ", F.col(f"name_{a}"), "; NAME2: ", F.col(f"name_{b}"), "\nCATEGORY1: ", path(a), "; CATEGORY2: ", path(b)]
    parts += ["\nDESCRIPTION1: ", F.substring(f"description_{a}", 1, 1000), "; DESCRIPTION2: ", F.substring(f"description_{b}", 1, 1000)]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _s_cross(a, b):
    path = lambda k: " || '->' || ".join(f"coalesce({c}_{k}, 'none')" for c in CATS)
    return (
        f"'NAME1: ' || name_{a} || '; NAME2: ' || name_{b} || chr(10) || 'CATEGORY1: ' || {path(a)} || '; CATEGORY2: ' || {path(b)} || chr(10)"
        f" || 'DESCRIPTION1: ' || substring(description_{a}, 1, 1000) || '; DESCRIPTION2: ' || substring(description_{b}, 1, 1000)"
    )


@R.add(_sql(f"{_s_cross(1, 2)} AS text, {_s_cross(2, 1)} AS text_reversed"))
def prompt_crossencoder(spark, d):
    """Both sides in one text, forward and reversed; descriptions count to 1,000 characters there."""
    return pairs(spark, d).select(*IDS, _cross(1, 2).alias("text"), _cross(2, 1).alias("text_reversed"))


def swapped(df):
    """Every ``_1`` column under the name of its ``_2`` column and the other way round."""
    other = {c: f"{c[:-2]}_{'2' if c.endswith('_1') else '1'}" for c in df.columns if c.endswith(("_1", "_2"))}
    return df.select(*[F.col(other[c]).alias(c) if other.get(c) in df.columns else F.col(c) for c in df.columns])


@R.add("SELECT variantid_2 AS variantid_1, variantid_1 AS variantid_2, name_2 AS name_1, name_1 AS name_2, price_2 AS price_1, price_1 AS price_2, is_double FROM train_df")
def swap_sides(spark, d):
    return swapped(pairs(spark, d).select(*IDS, "name_1", "name_2", "price_1", "price_2", "is_double"))


# Russian and English function words left out of the bag-of-words export.
STOP = "и в на не с по к за из от до о у а но the a of and in to for with".split()


def _marking(mark, up):
    return lambda w: F.concat(F.lit(mark), up(w))


def _bag(side, upper):
    up = F.upper if upper else (lambda c: c)
    bag = lambda c: F.filter(T.words(F.lower(F.coalesce(c, F.lit("")))), lambda w: ~w.isin(STOP))
    marked = [F.array_join(F.transform(bag(F.col(f"name_{side}")), lambda w: F.concat(F.lit("_"), up(w))), " ")]
    for mark, c in zip("~!@#", CATS):
        marked.append(F.array_join(F.transform(T.split_blank(F.coalesce(f"{c}_{side}", F.lit(""))), _marking(mark, up)), " "))
    marked.append(F.array_join(F.transform(bag(F.col(f"description_{side}")), up), " "))
    return marked


def _s_bag(side, upper):
    up = "upper({})" if upper else "{}"
    stop = ", ".join(f"'{w}'" for w in STOP)

    def bag(c):
        words = S_WORDS.format(f"lower(coalesce({c}, ''))")
        return f"list_filter({words}, lambda w: w NOT IN ({stop}))"

    w = up.format("w")
    parts = [f"array_to_string(list_transform({bag(f'name_{side}')}, lambda w: '_' || {w}), ' ')"]
    parts += [f"array_to_string(list_transform({S_BLANK.format(f'''coalesce({c}_{side}, '')''')}, lambda w: '{m}' || {w}), ' ')" for m, c in zip("~!@#", CATS)]
    parts.append(f"array_to_string(list_transform({bag(f'description_{side}')}, lambda w: {w}), ' ')")
    return " || ' ' || ".join(f"coalesce({p}, '')" for p in parts)


@R.add(f"SELECT '__label__' || is_double || ' ' || {_s_bag(1, False)} || ' ' || {_s_bag(2, True)} AS line FROM train_df WHERE is_double <> -1")
def fasttext_format(spark, d):
    """Labelled lines of a bag-of-words classifier: marked names and categories, the second side in capitals."""
    df = pairs(spark, d).where("is_double <> -1")
    return df.select(F.concat(F.lit("__label__"), F.col("is_double").cast("string"), F.lit(" "), F.concat_ws(" ", *_bag(1, False), *_bag(2, True))).alias("line"))
