"""Template residue, filler, error pages and script notices in a corpus.

Messages (lines and sentences) of all documents are mined for templates with a
prefix tree of fixed depth: a message's leaf is its number of words and its
first words, numbers masked, a status code before it taken off; a leaf's
template has at each further place the word that all its messages share, or a
wildcard. Each template is classified once, by how its words compose (which
notions it names, and that it names nothing else) and by the status codes that
stand before its messages anywhere in the corpus; its verdict goes to all its
messages, and from them to their documents.

Two things stand inside ordinary records and are detected there: unresolved
slots (an identifier between paired delimiters) and printed nulls. Filler is
found by how its words recombine; the vocabulary of such texts, mined over the
corpus, then finds its shorter pieces.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.terms import fold_scripts
from pairloom.operators.skew import salted_join
from pairloom.scratch import Scratch

DEPTH = 6  # words on the way to a leaf
LONGEST = 40  # words; longer messages have no leaf
MASK = "<*>"

# Beginnings of words, by the notion they name. All lower-case, in one alphabet, е for ё.
STATUS = "error ошибка код code http status статус сбой".split()
NOTIONS = {
    # what fails
    "thing": "страниц сайт сервер сервис доступ раздел сесси запрос объявлен ответ приложен ресурс соединен портал адрес page site website server service access gateway request session resource connection address application listing url catalog",
    # that it fails
    "failure": "ошибк сбой недоступ запрещ ограничен закрыт удален снят истек превыш устарел прерван пошло error fail denied forbidden unavailable expired exceeded timeout timed offline wrong removed broken bad",
    # what it is not, after a negation
    "state": "найден существ доступн найти found locat available exist find",
    "negation": "не нет not no cannot could couldn doesn isn unable",
    # what goes with these
    "detail": "внутренн временн врем ожидан числ слишком больше войд снова попроб позже обнов internal temporar requested many too please try again later login moved time oops ой упс извин увы sorry так",
    "script": "javascript js script скрипт сценари cookie куки браузер browser robot робот captcha капч блокировщик adblock",
    "demand": "включ необходим требу нуж разреш отключ провер подожд поддерж активир enabl disabl requir need allow turn check support wait verif activat",
    "purpose": "просмотр работ увид продолж выполнен view contin run work display see our наш",
    "ask": "здесь тут сюда введите вставь вставить добавьте укажите напишите insert add enter type replace put your",
    "told": "будет позже появится появятся with your here",
    "content": "заголов описан товар вещ характеристик текст объявлен подробн рассказ назван цен фото text item description headline product summary title name price content",
    "joint": "а the a an is are am be been was this that it you we i to for of from in on at and or by with has have что то такой такая такое такие этот эта это эти на в во к с со по и или из до о об для чтобы был была было были ваш ваша your turned",
}
SHORT_NOTIONS = frozenset({"negation", "joint", "told"})  # whole words only
WHOLE = {n: frozenset(ws.split()) for n, ws in NOTIONS.items() if n in SHORT_NOTIONS}
STEMS = {n: re.compile("|".join(sorted(ws.split(), key=len, reverse=True))) for n, ws in NOTIONS.items() if n not in SHORT_NOTIONS}
# Stems of at most three letters are words, not beginnings, but for these.
TINY = frozenset(w for n, ws in NOTIONS.items() if n not in SHORT_NOTIONS for w in ws.split() if len(w) <= 3) - {"цен", "вещ", "нуж", "run"}
# Words of texts that speak of templates.
SPEAKS_OF = re.compile(r"шаблон|подставля|плейсхолдер|переменн|верстальщик|placeholder|template|merge field|variable", re.I)
# Markup tags, which are no slots.
TAGS = frozenset("a abbr b big blockquote body br center code dd del div dl dt em font h head hr html i img ins li link meta nobr ol p pre s script small span strike strong style sub sup table tbody td th thead tr tt u ul".split())
# Sample texts.
SAMPLES = re.compile(r"lorem ipsum|dolor sit amet|съешь (?:же )?ещ[её] этих мягких", re.I)

# one word between signs that are neither prose punctuation nor emphasis
_SLOT = re.compile(r"(?<!\w)([{}\[\]<>%#$@&^][{}\[\]<>%#$@&^=]{0,3}|__)\s?([^\W\d][\w.]*?)\s?([{}\[\]<>%#$@&^]{1,3}|/>|__)(?!\w)|(?<=\w)([{\[<]{2,3}|[{<]%=?|\$\{)\s?([^\W\d][\w.]*)\s?([}\]>]{2,3}|%[}>]|\})")
_MIRROR = str.maketrans("{[<", "}]>")
_NULLISH = re.compile(r"\[object Object\]|(?<!\w)(?:null|undefined|None|NaN)(?![a-z0-9_])")
_LABELLED = re.compile(r"\s*[\w ]{2,30}:\s*(?:null|undefined|None|NaN)\W*")
_BREAK = re.compile(r"<(?:br|/?p|/?div|/?li|/?ul)\s*/?>|[\r\n]+|(?<=[.!?…])\s+|\s[—–|]\s", re.I)
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_CODE = re.compile(r"[45]\d\d")


def messages(text: str) -> list[str]:
    """The lines and sentences of a text, entities resolved."""
    t = html.unescape(html.unescape(text)) if "&" in text else text
    return [m for m in _BREAK.split(t) if m and not m.isspace()]


def masked(message: str) -> list[str]:
    """The message's words, lower-case, in one alphabet each, numbers masked."""
    words = _WORD.findall(fold_scripts(message.lower().replace("ё", "е").replace("­", "")))
    return [MASK if _DIGIT.search(w) else w for w in words] if _DIGIT.search(message) else words


def coded(message: str, tokens: list[str]) -> tuple[int, list[str]]:
    """``(status code, words after it)`` of a message that a status word and a code begin; else ``(0, tokens)``."""
    for i in (0, 1):
        if len(tokens) > i + 1 and tokens[i] == MASK and (i == 0 or tokens[0] in STATUS):
            n = _WORD.findall(message)[i]
            if _CODE.fullmatch(n):
                return (int(n) if i else -int(n)), tokens[i + 1 :]
            break
    return 0, tokens


def leaf(tokens: list[str]) -> str:
    return f"{len(tokens)} {' '.join(tokens[:DEPTH])}"


_notions: dict[str, frozenset[str]] = {}


def notions(word: str) -> frozenset[str]:
    """The notions that a word names; none for a word of ordinary content."""
    got = _notions.get(word)
    if got is None:
        if len(_notions) > 200_000:  # a memo, not data
            _notions.clear()
        got = frozenset([n for n, ws in WHOLE.items() if word in ws] + [n for n, stem in STEMS.items() if (m := stem.match(word)) and (m[0] == word or m[0] not in TINY)])
        _notions[word] = got
    return got


def verdict(template: list[str], codes: int = 0, behind_code: bool = False) -> str | None:
    """What a message of this template is: ``error``, ``script``, ``request`` or None.

    A verdict needs every word of the template to name a notion of its kind, so
    a sentence that says anything besides is none. ``codes`` is the number of
    different status codes that stand before messages of this template in the
    corpus: behind two of them, any short template is an error message.
    ``behind_code`` tells that this message itself follows a status code.
    """
    if not template or len(template) > LONGEST:
        return None
    if len(template) <= 8 and (codes >= 2 or behind_code):
        return "error"
    names = [notions(w) for w in template if w != "todo"]
    if not names or not all(names):
        return None
    said = frozenset().union(*names)
    if "todo" in template or "ask" in names[0]:
        rest = names[1:] if "ask" in names[0] else names
        if rest and all(n & {"ask", "told", "content", "joint"} for n in rest) and any("content" in n and "ask" not in n for n in rest):
            return "request"
    if "script" in said and "demand" in said and all(n & {"script", "demand", "purpose", "thing", "joint", "negation", "detail", "told"} for n in names):
        return "script"
    fails = "failure" in said or {"negation", "state"} <= said or {"negation", "thing"} <= said and "detail" in said or {"thing", "detail"} <= said and _overmuch(template)
    if fails and ("thing" in said or len(template) > 1) and all(n & {"thing", "failure", "state", "negation", "detail", "joint", "purpose"} for n in names):
        return "error"
    return "error" if template == ["forbidden"] else None


def _overmuch(template: list[str]) -> bool:
    return any(w in ("many", "слишком") for w in template)


def may_match(tokens: list[str]) -> bool:
    """Whether any rule of ``verdict`` could accept a template that begins like this without status codes.

    The first words are the same for all messages of a leaf, so a leaf is
    wholly kept or wholly left out, and no verdict changes.
    """
    return bool(tokens) and len(tokens) <= LONGEST and all(w == "todo" or notions(w) for w in tokens[:DEPTH])


def has_slot(message: str) -> bool:
    """Whether the message holds an unfilled slot and does not speak of slots itself.

    A slot is one identifier between an opening sign or run of signs and its
    mirror image, whatever the signs; markup tags are none.
    """
    for m in _SLOT.finditer(message):
        a, name, z = (m[1], m[2], m[3]) if m[1] else (m[4], m[5], m[6])
        want = a.rstrip("=").translate(_MIRROR)[::-1]
        if a == "<" and z in (">", "/>"):
            if name.lower().rstrip("123456") in TAGS:
                continue
        elif z != want and z != want.rstrip("$#@%&^") and z.lstrip(want) != "":
            continue
        if any(c in "}]>" for c in a) or len(a) == 1 and (len(name) < 2 or a in "$&^@"):
            continue
        return not SPEAKS_OF.search(message)
    return False


def prints_null(message: str) -> bool:
    """Whether the message shows values that were never there."""
    found = _NULLISH.findall(message)
    return len(found) >= 2 or "[object Object]" in found or bool(found and _LABELLED.fullmatch(message))


def repeats(words: list[str], least: int) -> bool:
    """Whether the words are one unit of at most four, ``least`` times or more."""
    n = len(words)
    return any(n >= least * k and words == (words[:k] * (n // k + 1))[:n] for k in range(1, 5))


def bare(words: list[str]) -> bool:
    """Whether a message is a row of long words only: no number, no word as short as the ones that join sentences."""
    return len(words) >= 4 and min(map(len, words)) > 3 and len(set(words)) >= 3 and not any(_DIGIT.search(w) for w in words)


def recombined(rows: list[list[str]]) -> bool:
    """Whether bare messages in a row recombine a small closed vocabulary evenly, as filler does.

    Words come again (at least three and a quarter of all), but not behind the
    words they followed before (sequences of a language repeat with their
    words), and not at the places they had before (as in one sentence form with
    other words put in).
    """
    n = sum(map(len, rows))
    if n < 10:
        return False
    seen: dict[str, set[int]] = {}
    twos: set[tuple[str, str]] = set()
    total = 0
    times: dict[str, int] = {}
    for r in rows:
        for i, w in enumerate(r):
            seen.setdefault(w, set()).add(i)
            times[w] = times.get(w, 0) + 1
        twos.update(zip(r, r[1:]))
        total += len(r) - 1
    again = n - len(seen)
    often = [w for w, k in times.items() if k > 1]
    moved = sum(len(seen[w]) > 1 for w in often)
    return again >= 3 and again * 4 >= n and (total - len(twos)) * 3 <= again and moved * 10 >= len(often) * 7


_SIGN = re.compile(r"[{\[<%#$@^&]|__")


def text_residue(text: str) -> str | None:
    """``filler`` that a text is as a whole, or None."""
    words = _WORD.findall(text.lower())
    if not words:
        return "filler" if len(text.strip()) >= 5 and len(set(text.split())) <= 2 else None
    if len(words) >= 3 and repeats(words, 3) or SAMPLES.search(text):
        return "filler"
    return "null" if len(words) < 40 and len(_NULLISH.findall(text)) >= 3 and prints_null(text) else None


def message_residue(message: str, tokens: list[str]) -> str | None:
    """Residue that one message holds whatever stands around it: ``slot``, ``null``, ``filler`` or None."""
    if _SIGN.search(message) and has_slot(message):
        return "slot"
    if prints_null(message):
        return "null"
    return "filler" if len(tokens) >= 4 and len(set(tokens)) <= 4 and MASK not in tokens and repeats(tokens, 4) else None


# what the one pass over the texts yields, by kind
LEAF_OF_DOC, OWN, LEAF, PLACE, CODE, FILLER_WORD, BARE_WORD = range(7)
ROWS = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("key", pa.int64()), ("place", pa.int32()), ("n", pa.int64()), ("word", pa.string()), ("word2", pa.string())])
_ROWS_DDL = "kind tinyint, doc_id long, key long, place int, n long, word string, word2 string"


def _key(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s)
    return h - (1 << 64) if h >> 63 else h


class _Pass:
    """One task's pass: rows to emit, and what it has counted per leaf."""

    def __init__(self, everything: bool):
        self.everything = everything
        self.memo: dict[str, tuple] = {}
        self.leaves: dict[int, list] = {}
        self.rows: list[tuple] = []

    def message(self, m: str) -> tuple:
        """``(leaf key, bare words, findings)`` of a message, counted in its leaf."""
        got = self.memo.get(m)
        if got is None:
            tokens = masked(m)
            code, tail = coded(m, tokens)
            if code < 0 and not may_match(tail):
                code, tail = 0, tokens  # a number before other words is no status
            name = leaf(tail) if tail and len(tail) <= LONGEST else None
            key = _key(name) if name else None
            kept = name is not None and (self.everything or code > 0 or may_match(tail))
            words = tokens if code == 0 and bare(tokens) else None
            own = [k for k in (message_residue(m, tokens), code > 0 and verdict(tail, behind_code=True)) if k]
            got = (key, words, own, abs(code), tail if kept else None)
            if len(m) <= 200:
                if len(self.memo) > 50_000:
                    self.memo.clear()
                self.memo[m] = got
        key, _, _, code, tail = got
        if tail is not None:
            held = self.leaves.get(key)
            if held is None:
                held = self.leaves[key] = [0, tail, list(tail), list(tail), set()]
            held[0] += 1
            if tail is not held[1]:
                lo, hi = held[2], held[3]
                for p in range(DEPTH, len(tail)):
                    w = tail[p]
                    if w < lo[p]:
                        lo[p] = w
                    if w > hi[p]:
                        hi[p] = w
            if code and len(held[4]) < 200:  # there are no more status codes
                held[4].add(code)
        return got

    def document(self, doc: int, text: str) -> None:
        keys, own, runs, run = set(), {text_residue(text)}, [], []
        for m in messages(text):
            key, words, found, _, _ = self.message(m)
            if key is not None:
                keys.add(key)
            own.update(found)
            if words:
                run.append(words)
            elif run:
                runs.append(run)
                run = []
        number = 0
        for run in [*runs, run]:
            if recombined(run):
                own.add("filler")
                self.rows += [(FILLER_WORD, doc, None, None, None, w, None) for w in {w for b in run for w in b}]
            else:
                for b in map(set, run):
                    number += 1
                    self.rows += [(BARE_WORD, doc, number, None, len(b), w, None) for w in b]
        self.rows += [(OWN, doc, None, None, None, k, None) for k in own if k]
        self.rows += [(LEAF_OF_DOC, doc, k, None, None, None, None) for k in keys]

    def flush(self, leaves: bool) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        if leaves:
            for key, (n, tail, lo, hi, codes) in self.leaves.items():
                rows.append((LEAF, None, key, len(tail), n, " ".join(tail[:DEPTH]), None))
                rows += [(PLACE, None, key, p, None, lo[p], hi[p]) for p in range(DEPTH, len(tail))]
                rows += [(CODE, None, key, c, None, None, None) for c in codes]
            self.leaves = {}
        cols = list(zip(*rows)) or [()] * len(ROWS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ROWS)], schema=ROWS)


def scan(docs: DataFrame, doc_id: str, text: str, everything: bool = False) -> DataFrame:
    """The one pass over the whole texts: rows of ``ROWS``, leaves counted per task.

    Every message's leaf is noted for its document. The words of a leaf are
    noted where it could get a verdict (``may_match``, or a status code before
    it); ``everything`` notes those of all leaves.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _Pass(everything)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p.document(i, t)
                if len(p.rows) > 50_000:
                    yield p.flush(len(p.leaves) > 100_000)
        yield p.flush(True)

    ids = F.col(doc_id).cast("long").alias("doc_id")
    return docs.select(ids, F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(read, _ROWS_DDL)


def templates(rows: DataFrame) -> DataFrame:
    """``(key, n_messages, codes, template)`` of the leaves that ``scan`` noted."""
    heads = rows.where(F.col("kind") == LEAF).groupBy("key").agg(F.sum("n").alias("n_messages"), F.min("word").alias("head"))
    places = rows.where(F.col("kind") == PLACE).groupBy("key", "place").agg(F.min("word").alias("lo"), F.max("word2").alias("hi"))
    # at most LONGEST places in a leaf
    tails = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(MASK)).alias("w")))).alias("tail"))
    codes = rows.where(F.col("kind") == CODE).groupBy("key").agg(F.count_distinct("place").alias("codes"))
    out = heads.join(tails, "key", "left").join(codes, "key", "left")
    template = F.concat(F.split("head", " "), F.coalesce(F.transform("tail", lambda e: e["w"]), F.array().cast("array<string>")))
    return out.select("key", "n_messages", F.coalesce("codes", F.lit(0)).alias("codes"), template.alias("template"))


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kinds)`` of documents that are, or hold, residue where content should stand.

    ``kinds`` are ``error``, ``script``, ``request`` (a field that asks for its
    content), ``slot``, ``null`` and ``filler``. Every message of every whole
    text is looked at, in one pass whose findings are staged. Texts that quote
    or discuss such things among other words get no verdict. Null and empty
    texts are no residue; rows with the same id are one document.
    """
    scratch = Scratch(docs.sparkSession, "residue")
    rows = scratch.save(scan(docs, doc_id, text), partition_by=["kind"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, v, m) for k, m, n, t in zip(*(c.to_pylist() for c in b.columns)) if (v := verdict(t, n))]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], ["key", "said", "n"])

    bad = scratch.save(templates(rows).select("key", "n_messages", "codes", "template").mapInArrow(judge, "key long, said string, n long"))
    # one template may stand in very many documents; where the verdicts are few, adaptive execution broadcasts them by their size
    noted = rows.where(F.col("kind") == LEAF_OF_DOC).select("doc_id", "key")
    by_template = salted_join(noted, bad, ["key"], "n", bad.agg(F.sum("n")).scalar(), F.col("doc_id")).select("doc_id", "said")
    own = rows.where(F.col("kind") == OWN).select("doc_id", F.col("word").alias("said"))
    found = own.unionByName(by_template).unionByName(_pieces(rows, scratch).select("doc_id", F.lit("filler").alias("said")))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("said")).alias("kinds"))


def _pieces(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents with a bare message all of whose words are in the vocabulary that at least two filler texts share."""
    vocabulary = rows.where(F.col("kind") == FILLER_WORD).groupBy("word").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 2").select("word")
    held = rows.where(F.col("kind") == BARE_WORD).select("doc_id", F.col("key").alias("message"), F.col("n").alias("words"), "word")
    known = scratch.save(held.groupBy("word").agg(F.count(F.lit(1)).alias("times")).join(vocabulary, "word"))
    total = known.agg(F.sum("times")).scalar()
    hits = salted_join(held, known, ["word"], "times", total, F.col("doc_id"))
    return hits.groupBy("doc_id", "message", "words").agg(F.count_distinct("word").alias("hit")).where("hit = words").select("doc_id")


def without_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus without documents that ``residue`` finds; all columns, repeated rows kept."""
    bad = residue(docs, doc_id, text).select(F.col("doc_id").alias("__bad"))
    return docs.join(bad, F.col(doc_id).cast("long") == F.col("__bad"), "left_anti")
