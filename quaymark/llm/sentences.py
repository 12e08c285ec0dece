"""Sentence units of every document (problem 9): statistics learnt from the corpus, then each mark classified.

Per language, all documents are counted once: how often a word is followed by a period, what follows it, how
often it closes a line, and which words open sentences. Log-likelihood ratios of these counts give
abbreviations, collocations across a period and sentence starters. A second pass classifies every mark with
them, minding quotes, brackets, labels, list numbers, wrapped lines and scripts without blanks or periods.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.session import cut as write_once

NUMBER = "##"
#: What the tests of a type, or of two across a period, must reach, whatever its share of the corpus.
ABBREVIATION, COLLOCATION, STARTER, ENDS = 3.0, 7.88, 30.0, 0.2
#: Frequent words a language, to tell it by.
TELLING = 200
COUNTS = ("period", "bare", "closing", "digit", "lower", "other", "start")
_BREAK = regex.compile(r"\s*[\n\r\x0b\x0c\x1c-\x1e\x85  ]\s*")
_HARD = regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])[^\S\n\r\x0b\x0c\x1c-\x1e\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])")
_NUMERIC = regex.compile(r"[\p{N}.,:%/\-–°]*\p{N}[\p{N}.,:%/\-–°]*")
_DIGITS, _RUN, _LETTERS, _SPACES = regex.compile(r"\p{N}+"), regex.compile(r"\S+"), regex.compile(r"\p{L}*$"), regex.compile(r"\s+")
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}.]+$")
_MARKS = ".!?…。！？｡؟।॥։"
_FULL, _FIRM = "。！？｡", "؟।॥։"
_OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‹": "›", '"': '"'}
_BRACKET = "(（[【"
_CLOSE = set("".join(_OPEN.values())) | {"’", "'"}
_THAI = regex.compile(r"\p{Thai}")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_LABEL = regex.compile(r"\s*(?:[(（]?\p{N}{1,9}[.)）:]\s*|[(（]\p{L}[)）]\s*|[\p{L}\p{M}]+(?: [\p{L}\p{M}]+)?\s*[:：]\s+|[\p{L}\p{M}]+\s+[-–]\s+)*[-–—•*]?\s*")
_LISTED = regex.compile(r"\s*[(（]?(?:\p{N}{1,9}|\p{Lu})")


@lru_cache(maxsize=100_000)
def _type(token: str) -> str:
    core = _EDGE.sub("", token).rstrip(".")
    return NUMBER if _NUMERIC.fullmatch(core) else _DIGITS.sub("#", core.casefold())


@lru_cache(maxsize=100_000)
def _initial(token: str) -> str:
    """A single letter with a period, folded; '' for any other token."""
    first = _EDGE.sub("", token)
    return first.casefold() if len(first) == 2 and first[1] == "." and first[0].isalpha() else ""


def kind(token: str, before: str) -> str:
    """The type of a token: folded, numbers alike, parts of a spaced abbreviation ('z. B.') named with what precedes."""
    core = _type(token)
    if core != NUMBER and "." in before and (first := _initial(before)):
        return f"{first} {core}"
    return core


def _lines(text: str) -> list[str]:
    return [x for x in _BREAK.split(text) if x]


def count(texts: list[str]) -> Counter:
    """(what, type, next) of the texts of one language."""
    bare: Counter = Counter()
    start: Counter = Counter()
    dotted: Counter = Counter()
    tokens_seen = starts = digit_starts = asked = asked_closing = 0
    for text in texts:
        lines = _lines(text)
        for k, line in enumerate(lines):
            tokens = line.split()
            closes = k + 1 == len(lines) or not lines[k + 1][0].islower()
            opens, before, size = True, "", len(tokens)
            if not closes:
                size -= 1  # a wrapped line tells nothing about its last word
            for j in range(size):
                w = tokens[j]
                last = j + 1 == len(tokens)
                t = kind(w, before)
                tokens_seen += 1
                body = w if w[-1].isalnum() else w.rstrip("\"”“»)’'」,;:")
                end = body[-1:]
                if t:
                    if end == "." and not body.endswith("..") and not (opens and _LISTED.fullmatch(body.rstrip("."))):
                        dotted["period", t, ""] += 1
                        if last:
                            dotted["closing", t, ""] += 1
                        elif body == w:
                            following = tokens[j + 1]
                            dotted["pair", t, kind(following, "")] += 1
                            dotted["digit" if following[0].isdigit() else "lower" if following[0].islower() else "other", t, ""] += 1
                    else:
                        bare[t] += 1
                    if opens:
                        start[t] += 1
                        starts += 1
                        digit_starts += w[0].isdigit()
                opens = False
                if end == "!" or end == "?":
                    opens = not last and tokens[j + 1][0].isupper()
                    asked += 1
                    asked_closing += last
                before = w
    out: Counter = Counter(dotted)
    out.update({("bare", t, ""): n for t, n in bare.items()})
    out.update({("start", t, ""): n for t, n in start.items()})
    ends = sum(n for (what, _, _), n in dotted.items() if what == "period")
    sums = {"all": tokens_seen, "periods": ends, "starts": starts, "digit start": digit_starts, "other start": starts - digit_starts, "asked": asked, "asked closing": asked_closing}
    out.update({(what, "", ""): n for what, n in sums.items() if n})
    return out


def _llr(k1: np.ndarray, n1: np.ndarray, k2: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Dunning's log-likelihood ratio of two binomials."""

    def part(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    n1, n2 = np.maximum(n1, 1e-9), np.maximum(n2, 1e-9)
    both = (k1 + k2) / (n1 + n2)
    return 2 * (part(k1, n1, k1 / n1) + part(k2, n2, k2 / n2) - part(k1, n1, both) - part(k2, n2, both))


@dataclass
class Language:
    """What a language's documents teach: abbreviations, those of them that may end a sentence, those that a number
    belongs to, collocations across a period, sentence starters, and frequent words to tell the language by."""

    abbreviations: set[str] = field(default_factory=set)
    ending: set[str] = field(default_factory=set)
    numbered: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    words: dict[str, float] = field(default_factory=dict)


def tested(wide: pd.DataFrame, one: dict[str, int]) -> pd.DataFrame:
    """Of types with their COUNTS: may each be an abbreviation, one that may end a sentence, one that a number belongs to, a
    sentence starter. ``one``: the sums of the language. Every type is tested by itself."""
    total, periods = one.get("all", 1), one.get("periods", 0)
    n = (wide["period"] + wide["bare"]).to_numpy(float)
    p = wide["period"].to_numpy(float)
    letters = np.array([sum(c.isalpha() for c in t) for t in wide["a"]], float)
    dots = np.array([t.count(".") + 1 for t in wide["a"]], float)
    more = p / np.maximum(n, 1) > periods / max(total, 1)
    score = _llr(p, n, periods - p, total - n) * np.exp(-letters) * dots * np.where(more, 1.0, 0.0) * (p / np.maximum(n, 1)) ** 2
    # followed by lower case: what a sentence's end hardly ever is
    lower = wide["lower"].to_numpy(float) / np.maximum(p, 1)
    # closing a line less often than marks do that always end a sentence
    base = (one.get("asked closing", 0) + 1) / (one.get("asked", 0) + 4)
    closing = wide["closing"].to_numpy(float) / np.maximum(p, 1)
    rarely = (closing < ENDS * base) & (p * base >= np.where(letters <= 4, 3, 15))
    number = np.array([t == NUMBER for t in wide["a"]], bool)
    abbreviated = number | (p >= 3) & (((score >= ABBREVIATION) & (letters <= 6)) | (lower > 0.2) | (rarely & (letters <= 8)))
    start_digit = (one.get("digit start", 0) + 1) / (one.get("starts", 0) + 2)
    after = (wide["digit"] + wide["other"]).to_numpy(float)
    digit = wide["digit"].to_numpy(float)
    s, starts = wide["start"].to_numpy(float), one.get("starts", 0)
    return pd.DataFrame({
        "a": wide["a"].to_numpy(object), "period": wide["period"].to_numpy(np.int64), "abbreviated": abbreviated, "ending": closing >= ENDS * base,
        "numbered": abbreviated & (digit >= 3) & (digit / np.maximum(after, 1) > 4 * start_digit),
        "starter": (_llr(s, n, starts - s, total - n) >= STARTER) & (s / np.maximum(n, 1) > starts / max(total, 1)),
    })


def tied(both: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """Do two types that stand ``both`` times across a period belong together? ``a``: periods after the first, ``b``: all of the second."""
    return (both >= 3) & (both / np.maximum(a, 1) > b / np.maximum(total, 1)) & (_llr(both, a, b - np.minimum(both, b), total - a) >= COLLOCATION)


def _language(types: pd.DataFrame, pairs: pd.DataFrame, top: pd.DataFrame, total: int) -> Language:
    """From types and pairs with what the tests said, and the most frequent words with their number."""
    return Language(
        *(set(types["a"][types[c].to_numpy(bool)]) for c in ("abbreviated", "ending", "numbered")), set(zip(pairs["a"], pairs["b"], strict=True)), set(types["a"][types["starter"].to_numpy(bool)]),
        {w: float(np.log(k / total)) for w, k in zip(top["a"], top["n"], strict=True) if any(c.isalpha() for c in w)},
    )


def learn(rows: pd.DataFrame) -> Language:
    """A language's model from its counts (``what``, ``a``, ``b``, ``n``), in one place; ``statistics`` does the same in tasks."""
    one = rows[rows["a"] == ""].set_index("what")["n"].to_dict()
    wide = rows[(rows["a"] != "") & (rows["b"] == "") & (rows["what"] != "pair")].pivot_table(index="a", columns="what", values="n", aggfunc="sum", fill_value=0)
    wide = wide.reindex(columns=COUNTS, fill_value=0).reset_index()
    if wide.empty:
        return Language()
    total = one.get("all", 1)
    types = tested(wide, one)
    pairs = rows[rows["what"] == "pair"]
    n = (wide["period"] + wide["bare"]).to_numpy()
    of, seen = dict(zip(wide["a"], wide["period"], strict=True)), dict(zip(wide["a"], n, strict=True))
    a, b = (np.array([known.get(x, 0) for x in pairs[c]], float) for known, c in ((of, "a"), (seen, "b")))
    top = wide.assign(n=n).query("bare > 0").nlargest(TELLING, "n")
    return _language(types, pairs[tied(pairs["n"].to_numpy(float), a, b, total)], top, total)


def _asked(t: str) -> bool:
    """Is what a type tells looked up even if it is no abbreviation? So it is if its last part is a single capital letter, folded."""
    return t[t.rfind(" ") + 1 :] in _capitals()


@lru_cache(maxsize=1)
def _capitals() -> frozenset[str]:
    return frozenset(c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.isupper() and c.isalpha())


def statistics(docs: DataFrame) -> dict[str, Language]:
    """A model per language from every document of ``lang``, ``text``: counts are summed map-side, every type and every two
    across a period are tested in the tasks, however rare. What passes, and is ever looked up, goes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, texts in b.groupby("lang")["text"]:
                out += [(lang, what, a, c, k) for (what, a, c), k in count(list(texts)).items()]
            yield pd.DataFrame(out, columns=["lang", "what", "a", "b", "n"])

    counted = write_once(docs.where("text is not null and lang is not null").mapInPandas(run, "lang string, what string, a string, b string, n bigint").groupBy("lang", "what", "a", "b").agg(F.sum("n").alias("n")))
    sums: dict[str, dict[str, int]] = {}
    for lang, what, n in counted.where("a = ''").select("lang", "what", "n").collect():  # seven a language
        sums.setdefault(lang, {})[what] = n
    numbers = [F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTS]
    wide = write_once(counted.where("a <> '' and what <> 'pair'").groupBy("lang", "a").agg(*numbers))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, types in b.groupby("lang"):
                out = tested(types, sums[lang])
                asked = out["abbreviated"] | out["starter"] | np.array([_asked(t) for t in out["a"]], bool)
                yield out[asked].assign(lang=lang)[["lang", *out.columns]]

    types = write_once(wide.mapInPandas(test, "lang string, a string, period bigint, abbreviated boolean, ending boolean, numbered boolean, starter boolean"))

    def test_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = np.array([sums[la].get("all", 1) for la in b["lang"]], float)
            hit = tied(b["n"].to_numpy(float), b["period"].to_numpy(float), b["seen"].to_numpy(float), total)
            yield b[hit][["lang", "a", "b"]]

    first = types.select("lang", "a", "period")
    second = wide.select("lang", F.col("a").alias("b"), (F.col("period") + F.col("bare")).alias("seen"))
    two = counted.where("what = 'pair' and n >= 3").select("lang", "a", "b", "n").join(first, ["lang", "a"]).join(second, ["lang", "b"], "left")
    pairs = two.select("lang", "a", "b", "n", "period", F.coalesce("seen", F.lit(0)).alias("seen")).mapInPandas(test_two, "lang string, a string, b string").toArrow().to_pandas()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "a"))
    top = wide.where("bare > 0").select("lang", "a", (F.col("period") + F.col("bare")).alias("n")).withColumn("place", place).where(F.col("place") <= TELLING).toArrow().to_pandas().sort_values(["lang", "place"])
    known = types.toArrow().to_pandas()
    return {lang: _language(*(x[x["lang"] == lang] for x in (known, pairs, top)), one.get("all", 1)) for lang, one in sums.items()}


def guess(text: str, models: dict[str, Language]) -> str:
    """The language whose frequent words a text of unknown language has most of; '' if it has none."""
    words = Counter(kind(w, "") for w in text.split())
    score = {la: sum(k for w, k in words.items() if w in m.words) for la, m in models.items()}
    best = max(sorted(score), key=lambda la: score[la], default="")
    return best if best and score[best] else _by_script(text)


def _by_script(text: str) -> str:
    if _THAI.search(text):
        return "th"
    return "zh" if _CJK.search(text) else ""


def _lowercase(c: str) -> bool:
    return c.islower()


def sentences(text: str, model: Language, lang: str = "") -> list[tuple[int, int]]:
    """(start, end) of each sentence, in code points, blanks at either side left out."""
    cuts = _thai(text) if lang == "th" else _cuts(text, model, lang)
    out, at = [], 0
    for e in [*cuts, len(text)]:
        a, b = at, e
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        at = e
    return out


def _thai(text: str) -> list[int]:
    """A blank ends a sentence unless it touches a digit; a line break always does."""
    cuts = []
    for m in _SPACES.finditer(text):
        a, b = m.span()
        if any(c in "\n\r\x0b\x0c\x85  " for c in m[0]) or not (a and text[a - 1].isdigit() or b < len(text) and text[b].isdigit()):
            cuts.append(b)
    return cuts


_EVENT = {
    greek: regex.compile(rf"(?P<nl>\s*[\n\r\x0b\x0c\x1c-\x1e\x85  ]\s*)|(?P<mark>[{_MARKS}{';;' if greek else ''}](?:\s?[!?])?[{_MARKS}]*)|(?P<o>[(（\[【“„«「『‹\"])|(?P<c>[)）\]】”»」』›])")
    for greek in (False, True)
}


def _token_before(text: str, start: int, at: int) -> tuple[str, str]:
    """The run of characters that ends at ``at`` and the one before it, not beyond ``start``."""
    a = at
    while a > start and not text[a - 1].isspace():
        a -= 1
    b = a
    while b > start and text[b - 1].isspace():
        b -= 1
    c = b
    while c > start and not text[c - 1].isspace():
        c -= 1
    return text[a:at], text[c:b]


def _cuts(text: str, model: Language, lang: str) -> list[int]:
    cuts: list[int] = []
    size, start, stack = len(text), 0, []  # stack: (closing sign, opened at the sentence's start, is a bracket)
    content = _LABEL.match(text, 0).end()
    pos, event = 0, _EVENT[lang == "el"]

    def begin(at: int) -> None:
        nonlocal start, content
        cuts.append(at)
        start = at
        content = max(at, _LABEL.match(text, at).end())
        stack.clear()

    def abbreviated(at: int) -> str | None:
        """The abbreviation whose period stands at ``at``, else None."""
        w, before = _token_before(text, start, at)
        core = _EDGE.sub("", w).rstrip(".")
        t = kind(w + ".", before)
        if t in model.abbreviations or len(core) == 1 and core.isalpha() and core.isupper():
            return t
        return None

    while m := event.search(text, pos):
        pos = m.end()
        if m["nl"] is not None:
            if pos >= size:
                break
            hard = _HARD.search(m[0])
            if hard or not _lowercase(text[pos]) or _finished(text, start, m.start(), abbreviated, stack):
                begin(pos)
            continue
        if m["o"] is not None or m["c"] is not None:
            c = m[0]
            if stack and c == stack[-1][0]:
                stack.pop()
            elif m["o"] is not None and _closes_later(text, pos, _OPEN[c]):
                stack.append((_OPEN[c], m.start() <= content, c in _BRACKET))
            continue
        mark, at = m[0], m.start()
        # closing signs that follow directly, or after a blank where the sign is written so
        j, last, quoted = pos, None, False
        while j < size:
            k = j
            if text[k] in " \xa0 " and k + 1 < size and text[k + 1] in "»›" and stack and stack[-1][0] == text[k + 1]:
                k += 1
            if stack and text[k] == stack[-1][0]:
                last = stack.pop()
                quoted = True
                j = k + 1
            elif text[k] in "’'" and not quoted and k + 1 < size and text[k + 1].isspace() and not stack:
                j = k + 1
            else:
                break
        pos = max(pos, j)
        if stack and not all(b and s for _, s, b in stack):
            continue  # inside a quotation or a remark
        if stack:
            continue
        n = j
        while n < size and text[n].isspace() and not _BREAK.match(text[n]):
            n += 1
        if n >= size or _BREAK.match(text[n]):
            continue
        blank, c = n > j, text[n]
        firm = mark[-1] in _FULL or any(x in _FULL for x in mark) or mark[-1] in _FIRM
        if last is not None and not last[2] and last[1]:
            # a quotation that opens the sentence: what follows is its attribution, unless a full stop ended it
            if not (mark[-1] == "." and not mark.endswith("..") and blank and c.isupper()):
                continue
        if last is not None and last[2] and not last[1]:
            if mark[-1] == "." or firm or mark[-1] in "!?":
                continue  # a remark in brackets inside the sentence
        if c in ",;:,、，；：)]}）」』”»%/=" or _lowercase(c):
            continue
        if c in "—–-":
            d = n + 1
            while d < size and text[d] in " \xa0":
                d += 1
            if not blank or d >= size or not (text[d].isupper() or text[d] in "¡¿«“\"„"):
                continue
        if firm:
            begin(n)
            continue
        if set(mark) <= {"…", "."} and (mark != "."):
            if _CJK.match(text[at - 1 : at] or " ") or _CJK.match(c):
                continue
            if blank:
                begin(n)
            continue
        if mark[-1] in "!?;;" or mark[0] in "!?":
            if blank or c.isupper() or c in "¡¿«“\"„—" or not (c.isascii() or c.isalpha() and c.lower() != c.upper()):
                begin(n)
            continue
        # a period
        if last is None:
            if _LISTED.fullmatch(text, start, at):
                continue
            t = abbreviated(at)
            if t is not None:
                _, ahead = None, kind(_RUN.match(text, n)[0], "")
                if t not in model.ending or t in model.numbered and c.isdigit():
                    continue
                if (t, ahead) in model.collocations and ahead not in model.starters and not (t in model.ending and c.isupper()):
                    continue
                if len(t) == 1 and text[at - 1].isupper():
                    continue
            if not blank:
                w, _ = _token_before(text, start, at)
                core = _EDGE.sub("", w)
                tail = _LETTERS.search(core)[0]
                odd = any(x in w for x in "/\\@_") or w.startswith("www.")
                if odd or len(tail) < 2 and not (any(x.isdigit() for x in core[-2:]) and c.isupper()) or not (c.isupper() or c in "¡¿«“\"„(" or c.isdigit() and len(tail) > 2):
                    continue
        elif not blank and not c.isupper():
            continue
        begin(n)
    return cuts


def _closes_later(text: str, at: int, sign: str) -> bool:
    end = _HARD.search(text, at)
    return text.find(sign, at, end.start() if end else len(text)) >= 0


def _finished(text: str, start: int, end: int, abbreviated, stack: list) -> bool:
    """Does the line that ends at ``end`` end its sentence, if the next goes on in lower case?"""
    k = end
    closed = False
    while k > start and (text[k - 1].isspace() or text[k - 1] in _CLOSE):
        closed |= text[k - 1] in _CLOSE
        k -= 1
    if k == start or text[k - 1] not in _MARKS + ";":
        return False
    if text[k - 1] == ";" or closed or stack:
        return False
    if text[k - 1] == "…" or text[max(start, k - 2) : k] == "..":
        return False
    return not (text[k - 1] == "." and abbreviated(k - 1) is not None)


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, ``start_pos``, ``end_pos``: a row per sentence, in code points, end exclusive.

    A document without a language gets the one whose frequent words it has most of. Null, empty and blank texts
    have no rows. A repeated document has its sentences as often. Other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("bigint").alias(key), F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null")
    models = statistics(rows.select("lang", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ours = shared.value
        for b in batches:
            keys, starts, ends = [], [], []
            for k, la, t in b.itertuples(index=False):
                la = la if la in ours else guess(t, ours)
                for a, e in sentences(t, ours.get(la, Language()), la):
                    keys.append(k)
                    starts.append(a)
                    ends.append(e)
            yield pd.DataFrame({key: keys, "start_pos": starts, "end_pos": ends})

    return rows.mapInPandas(run, f"{key} bigint, start_pos bigint, end_pos bigint")
