"""Generations that stop before their end (problem 5).

Near-copies are found by shared rare shingles and aligned: the one whose alignment ends early, inside a sentence of
the other, is cut. Whatever has no copy is scored by the terminality of its closing words: how often, over the
whole corpus, a text ends after these words rather than going on.
"""

from __future__ import annotations

import bisect
import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.chars import FOLD_CASED, caseless
from quaymark.llm.copies import _markers, _members, canonical
from quaymark.llm.wording import WORDS
from quaymark.session import cut as write_once

#: A context enters the model if it is seen so often, at least; a share of all tokens bounds their number.
LEAST, FLOOR, TERMINAL, PHRASE = 20, 1e-6, 0.03, 0.5
SHINGLE, SIMILAR = 5, 0.8
#: Answers without content, to validate what empty ones are told by.
EMPTIES = ("</s>", "<pad><pad>", "...", "[]", '""', "- -")
START, NEXT, MASK = "\x02", "\x06", "ʘ"
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]|[^\s\p{Han}\p{Hiragana}\p{Katakana}ー々]+")
_SIDES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}]+$")
_SAYS_CUT = regex.compile(r"(?:�+|\s*[\[<(]\s*(?:cut|truncated|\.{3}|…|max[^\]>)]*)\s*[\]>)])\s*$", regex.I)
_TAIL = regex.compile(r"(?:\s|…|\.{2,}|[-–—~_|*\\/]|�|<[^<>]{0,20}>|\[[^\[\]]{0,20}\])+$")
_WRAPPED = regex.compile(r"^\s*\{\s*[\"'][\p{L}_]+[\"']\s*:\s*[\"']?")
_FINAL = regex.compile(r"[.!?。！？।؟…][\"'”’»›“)\]）」』\s]*$")
_LIST = regex.compile(r"[,;]\s+|[、，]\s*")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_STOPS = ".!?。！？"
_CLOSING = set(_STOPS + "।؟…\"'”’»›“)]）」』")
_ANY, _DIGIT = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"\p{N}")
_MARKUP, _ANSWER, _SINGLE = regex.compile(r"<[^<>]*>|\[[^\[\]]*\]"), regex.compile(r"^\W*answer\s*:"), regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]")


def words(text: str) -> list[str]:
    """Words with what is attached to them; each character of scripts without blanks."""
    return text.split() if text.isascii() or not _UNSPACED.search(text) else _WORD.findall(text)


def core(word: str) -> str:
    """A word without its outer signs, digits alike."""
    return word if word.isalpha() else alike(_SIDES.sub("", word))


def alike(text: str) -> str:
    """Any digit is as good as another."""
    return text if text.isalpha() else _DIGIT.sub("0", text)


def fold(generation: F.Column) -> F.Column:
    """The form in which generations are compared: no outer blanks, one case."""
    return F.lower(F.btrim(generation, F.lit(" \t\n\r")))


@dataclass
class Model:
    """Frequent words, and of every frequent context of up to three words how often it occurs, ends a text, and stands
    before a pause; and of every phrase that is a whole answer or list member how often it is."""

    vocabulary: set[str] = field(default_factory=set)
    total: dict[tuple[str, ...], int] = field(default_factory=dict)
    final: dict[tuple[str, ...], int] = field(default_factory=dict)
    pause: dict[tuple[str, ...], int] = field(default_factory=dict)
    after: dict[str, list[str]] = field(default_factory=dict)
    items: dict[str, int] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)

    def longer(self, item: str) -> int:
        """How often a longer phrase occurs that begins so."""
        k = bisect.bisect_right(self.order, item)
        total = 0
        while k < len(self.order) and self.order[k].startswith(item):
            total += self.items[self.order[k]]
            k += 1
        return total

    seen: dict[str, str] = field(default_factory=dict, repr=False)

    def masked(self, segment: str, first: bool = True) -> list[str]:
        seen = self.seen
        return [START if first else NEXT, *(seen.get(w) or self._mask(w) for w in words(segment))]

    def _mask(self, word: str) -> str:
        c = core(word)
        out = c if c in self.vocabulary else MASK if c else "\x03"
        if len(self.seen) < 100_000:
            self.seen[word] = out
        return out


class Patterns:
    """Texts cut into sentence-like segments with rare words masked and digits alike.

    Generations are made from few patterns, so what is worked out for a segment is worked out once per worker.
    """

    def __init__(self, known: set[str], most: int = 200_000) -> None:
        self.known, self.cache, self.most = known, {}, most

    def _word(self, w: str) -> str:
        c = core(w)
        if not c or c in self.known or _UNSPACED.search(w):
            out = alike(w)
        else:  # a name, or a number, whose length tells nothing
            inner = _SIDES.sub("", w)
            out = w.replace(inner, MASK if any(x.isalpha() for x in inner) else "0")
        if len(self.cache) < self.most:
            self.cache[w] = out
        return out

    def of(self, text: str) -> list[str]:
        """The segments of a folded text; the last word of one that no final mark follows stays as it is."""
        parts = text.replace('." ', '."\x00').replace(". ", ".\x00").replace("。", "。\x00").split("\x00")
        out, cache = [], self.cache
        for k, part in enumerate(parts):
            ws = part.split()
            if not ws:
                continue
            keep = alike(ws.pop()) if k == len(parts) - 1 and not final(body(part)) else None
            masked = [cache.get(w) or self._word(w) for w in ws]
            out.append(" ".join(masked if keep is None else [*masked, keep]))
        return out or [""]


def contexts(masked: list[str], pauses: list[bool]) -> Iterator[tuple[tuple[str, ...], bool, bool]]:
    """Every run of up to three words with whether the text ends, or pauses, after it; signs by themselves don't count."""
    seen = [(w, p) for w, p in zip(masked, (False, *pauses), strict=True) if w != "\x03"]
    names, last = [w for w, _ in seen], len(seen) - 1
    for k in range(1, len(seen)):
        for n in (1, 2, 3):
            if k - n + 1 >= 0:
                yield tuple(names[k - n + 1 : k + 1]), k == last, k == last or seen[k][1]


def body(text: str) -> str:
    """Without what may follow a cut: blanks, dots, dashes, marks of truncation."""
    if not text or text[-1].isalnum() or text[-1] in _STOPS and text[-2:-1].isalnum():
        return text
    return _TAIL.sub("", text)


def final(text: str) -> bool:
    """Does the text end with a final mark, closing signs aside?"""
    if not text or text[-1].isalnum():
        return False
    return text[-1] in _STOPS + "…" or bool(_FINAL.search(text[-12:]))


def is_cut(segments: list[str], model: Model, classes: tuple[str, ...] = (), cache: dict | None = None) -> bool:
    """Does a text, given by its segments, end inside a word or a sentence, judged by its closing words?

    ``classes``: the task's labels; a proper beginning of one that is none itself is cut.
    Text without letters and digits is not cut but empty.
    """
    tail, single = segments[-1], len(segments) == 1
    wrapped = _WRAPPED.match(segments[0])
    if wrapped and not tail.endswith("}"):
        return True
    inner = body(tail[wrapped.end() :] if wrapped and single else tail)
    like = not single and not final(inner) and _sentence_like(" ".join([*segments[:-1], inner]))
    key = (tail, single, like, classes if single else ())
    if cache is not None and key in cache:
        return cache[key]
    out = _ends_inside(tail, inner, model, classes if single else (), single, like)
    if cache is not None and len(cache) < 100_000:
        cache[key] = out
    return out


def _ends_inside(tail: str, inner: str, model: Model, classes: tuple[str, ...], single: bool, like: bool) -> bool:
    if not _ANY.search(_MARKUP.sub("", tail)):
        return not single and bool(_SAYS_CUT.search(tail))
    if _SAYS_CUT.search(tail):
        return True
    if inner.endswith((",", "、", "，", ":", "：", ";")):
        return True
    label = _SIDES.sub("", _ANSWER.sub("", inner)).strip()
    if classes:
        if label in classes:
            return False
        if label and any(c.startswith(label) for c in classes):
            return True
    seen = [(w, c) for w, c in zip(model.masked(inner, single), ("", *map(core, words(inner))), strict=True) if w != "\x03"]
    masked, last = [w for w, _ in seen], seen[-1][1]
    if len(masked) < 2:
        return False
    ends = final(inner)
    if not ends:
        if like or _sentence_like(inner):
            return True
        item = items(inner)[-1]
        whole, longer = model.items.get(item, 0), model.longer(item)
        if whole >= LEAST // 4 or longer:
            return longer > 5 * whole
    before, seen_so = masked[-2], model.total.get((masked[-2], masked[-1]), 0)
    if not ends and any(w.startswith(last) and len(w) > len(last) and model.total[before, w] > 5 * seen_so for w in model.after.get(before, ())):
        return True
    for n in (3, 2, 1):
        ctx = tuple(masked[-n:])
        total = model.total.get(ctx, 0)
        if len(masked) >= n and total >= LEAST:
            if ends:
                return n > 1 and model.final.get(ctx, 0) / total < TERMINAL  # one word tells too little against a final mark
            return model.pause.get(ctx, 0) / total < PHRASE
    return False


def breaks_off(tail: str) -> bool:
    """Does the last segment say that it is cut, or end in a mark that something must follow?"""
    return bool(_SAYS_CUT.search(tail)) or body(tail).endswith((",", "、", "，", ":", "：", ";", "-"))


def items(text: str) -> list[str]:
    """The members of a list, or the one phrase, with digits alike and without outer signs and a leading 'answer:'."""
    return [core(x) for x in _LIST.split(_ANSWER.sub("", text)) if core(x)] or [""]


def _sentence_like(text: str) -> bool:
    """Longer than a label or phrase, and no list of such."""
    parts = _LIST.split(text)
    most = 4 if len(parts) == 1 else 3
    return any(len(words(x)) > (8 if _UNSPACED.search(x) else most) for x in parts)


def text_id(table: int) -> F.Column:
    """The id of a distinct text (``task``, ``g``) of the log rows (0) or the instances (1)."""
    return F.xxhash64("task", "g") if table == 0 else F.xxhash64("task", "g", F.lit(table))


def distinct_texts(rows: DataFrame, table: int = 0) -> DataFrame:
    """``t``, ``task``, ``g``, ``copies``, ``tid``: every distinct folded generation of a task once."""
    folded = rows.select("task", fold(F.col("generation")).alias("g")).where("g is not null and g <> ''")
    return folded.groupBy("task", "g").agg(F.count("*").alias("copies")).select(F.lit(table).alias("t"), "task", "g", "copies", text_id(table).alias("tid"))


def vocabulary(texts: DataFrame, tasks: DataFrame) -> set[str]:
    """Words of a share of at least 1e-5 of all, so at most 1e5 of them, counted map-side; and the words of class labels."""
    named = tasks.select(F.explode("class_labels").alias("c")).select(F.explode(F.split(F.lower("c"), r"\s+")).alias("w")).distinct().limit(100_001).toArrow().to_pandas()["w"]
    if len(named) > 100_000:
        raise ValueError("more than 100,000 words in class labels")
    spread = write_once(texts.select("copies", F.explode(F.split("g", " ")).alias("w")).groupBy("w").agg(F.sum("copies").alias("n")))
    total = spread.agg(F.sum("n")).first()[0] or 0
    kept = spread.where((F.col("n") >= max(LEAST, total * 1e-5)) & ~F.regexp_like("w", F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")))
    found = {core(w) for (w,) in kept.select("w").toArrow().to_pandas().itertuples(index=False)}
    return _Mixed((found | {core(w) for w in named if w}) - {""} | {MASK, "answer"} | WORDS)


PARTS = "t int, task string, tid bigint, copies bigint, g string, segs array<string>, words int, class bigint, head string, heads string, last int, mix bigint, shingles array<bigint>"


def taken_apart(texts: DataFrame, known: set[str]) -> DataFrame:
    """Every text of ``t``, ``task``, ``tid``, ``copies``, ``g`` taken apart, once for all that follows.

    ``segs``: its segments; ``words``: the number of its words; ``class``: equal for texts of equal words that end
    their sentences alike; ``head``: the first letter of its last word, ``heads``: of each of its last words, ``last``:
    a hash of the last; ``mix``: what letters it is made of (see ``mixture``); ``shingles``: see ``placed``.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, cache = Patterns(shared.value), {}
        for b in batches:
            segs, rows, flat, sizes = [], [], [], []
            tables = b.column("t").to_pylist()
            for t, g in zip(tables, b.column("g").to_pylist(), strict=True):
                segs.append(made.of(g))
                found = [cache.get(w) or _word(w, cache) for w in words(body(g))]
                n = len(found)
                heads = "".join([w[2] for w in found[n - min(n, n // 4 + 2) :]])
                flat += [w[0] for w in found]
                sizes.append(n)
                kind = xxhash.xxh64_intdigest(array("Q", [w[1] for w in found]).tobytes(), t) >> 1
                rows.append((n, kind, heads[-1:], heads, found[-1][0] >> 33 if n else 0, mixture(amounts(g))))
            hashes, text = placed(np.array(flat, np.uint64), np.array(sizes, np.int64), np.array(tables, np.uint64))
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sizes)))]).astype(np.int32)
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
            own = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segs, pa.list_(pa.string())), *own, shingles], [x.split()[0] for x in PARTS.split(", ")])

    return texts.select("t", "task", "tid", "copies", "g").mapInArrow(run, PARTS)


def learn(parts: DataFrame, known: set[str]) -> Model:
    """The model from the segments of all texts, each as often as it occurs; counted map-side, rare contexts left out
    by their share."""
    shared = parts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Model(shared.value)
        for b in batches:
            all_, end, halt = Counter(), Counter(), Counter()
            for t, first, closes, k in b.itertuples(index=False):
                inner = body(t) if closes else t
                for ctx, last, pause in contexts(mine.masked(inner, first), [w[-1] in ",.;!?、。，" for w in words(inner)]):
                    all_[ctx] += k
                    if pause:
                        halt[ctx] += k
                        end[ctx] += k * (last and closes)
                if first and closes and not final(inner) and not _sentence_like(inner):
                    for x in items(inner):
                        all_["\x04", x] += k
            yield pd.DataFrame({"ctx": ["\x1f".join(c) for c in all_], "n": list(all_.values()), "ends": [end.get(c, 0) for c in all_], "pauses": [halt.get(c, 0) for c in all_]})

    each = parts.select("copies", F.size("segs").alias("size"), F.posexplode("segs").alias("at", "seg"))
    once = each.groupBy("seg", (F.col("at") == 0).alias("first"), (F.col("at") == F.col("size") - 1).alias("closes")).agg(F.sum("copies").alias("n"))
    found = once.mapInPandas(count, "ctx string, n bigint, ends bigint, pauses bigint").groupBy("ctx").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("pauses").alias("pauses"))
    least = F.when(F.col("ctx").startswith("\x04"), 2).otherwise(LEAST // 2)
    found = write_once(found)
    total = found.agg(F.sum("n")).first()[0] or 0
    kept = found.where((F.col("n") >= least) & (F.col("n") >= total * FLOOR)).select("ctx", "n", "ends", "pauses").toArrow().to_pandas()
    model = Model(known)
    after = defaultdict(list)
    for ctx, n, ends, pauses in kept.itertuples(index=False):
        key = tuple(ctx.split("\x1f"))
        if key[0] == "\x04":
            model.items[key[1]] = n
            continue
        model.total[key], model.final[key], model.pause[key] = n, ends, pauses
        if len(key) == 2:
            after[key[0]].append(key[1])
    model.after = dict(after)
    model.order = sorted(model.items)
    return model


class _Mixed(set):
    """A vocabulary that also holds every single character of a script without blanks."""

    def __contains__(self, w: object) -> bool:
        return set.__contains__(self, w) or len(w) == 1 and bool(_SINGLE.match(w))


def shingles(tokens: list[str]) -> set[int]:
    return {xxhash.xxh32_intdigest(" ".join(tokens[k : k + SHINGLE])) for k in range(len(tokens) - SHINGLE + 1)}


Word = tuple[int, int, str]


def _word(w: str, cache: dict[str, Word]) -> Word:
    """Hash of a word without its outer signs, the same with whether it ends a sentence, and its first letter (a blank if it has none)."""
    c = core(w)
    h = xxhash.xxh64_intdigest(c)
    out = h, h ^ (w[-1] in _CLOSING and bool(_FINAL.search(w))), c[:1] or " "
    if len(cache) < 100_000:
        cache[w] = out
    return out


_MIX = np.array([xxhash.xxh64_intdigest(str(k)) | 1 for k in range(SHINGLE + 2)], np.uint64)


def placed(flat: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of texts, each with the place where it first stands, and the text of each.

    ``flat``: the hashes of all words, text by text; ``sizes``: how many words each text has; ``seeds``: texts of
    different seeds have no shingle in common. A text of fewer than SHINGLE words has none.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = place + SHINGLE <= np.repeat(sizes, sizes)
    sums = np.zeros(len(flat), np.uint64)
    for k in range(SHINGLE):
        sums[: len(flat) - k] += flat[k:] * _MIX[k]
        sums ^= sums >> np.uint64(29)
    sums, text, place = sums[whole], text[whole], place[whole]
    order = np.lexsort((place, sums, text))
    first = np.ones(len(order), bool)
    first[1:] = (sums[order][1:] != sums[order][:-1]) | (text[order][1:] != text[order][:-1])
    kept = order[first]
    out = (sums[kept] ^ (place[kept].astype(np.uint64) * _MIX[SHINGLE])) * _MIX[SHINGLE + 1] + seeds[text[kept]]
    return ((out ^ (out >> np.uint64(32))) >> np.uint64(1)).astype(np.int64), text[kept]


#: Cells in which shingles are counted, to tell the frequent ones: a fixed size, whatever the corpus.
CELLS, CHUNK = 1 << 20, 1 << 14


def rarest(flat: np.ndarray, sizes: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's shingles the rarest, of which it shares one, at least, with any text of SIMILAR; and the text of each.

    ``flat``: the shingles of all texts, ``sizes``: how many each has; ``often``: counts by cell. Any order that is
    the same for all texts loses no pair; equally rare ones are ordered by their hash.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, often[flat & (CELLS - 1)], text))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = order[place < np.repeat(sizes - np.ceil(SIMILAR * sizes - 1e-9).astype(np.int64) + 1, sizes)]
    return flat[kept], text[kept]


Tokens = tuple[list[str], list[str]]


def tokens(text: str, cache: dict[str, str] | None = None) -> Tokens:
    """The words of a text's body, as they stand and without their outer signs."""
    ws, cores = words(body(text)), []
    for w in ws:
        c = cache.get(w) if cache is not None else None
        if c is None:
            c = core(w)
            if cache is not None and len(cache) < 100_000:
                cache[w] = c
        cores.append(c)
    return ws, cores


def ends_early(a: str, b: str) -> bool:
    """Is ``a`` a copy of ``b``, a few other words aside, that stops inside one of its sentences, whatever mark follows?"""
    return _stops(tokens(a)[1], *tokens(b))


def _stops(p: list[str], whole: list[str], q: list[str]) -> bool:
    n = len(p)
    if n > len(q) or not p:
        return False
    last, there = p[-1], q[n - 1]
    if last != there:
        if not (len(last) < len(there) and there.startswith(last)):
            return False
    elif not any(q[n:]) or _FINAL.search(whole[n - 1]):  # a mark alone is no rest
        return False
    return sum(v != w for v, w in zip(p[:-1], q, strict=False)) <= (1 - SIMILAR) * len(q)  # else too unlike anyway


def near(p: list[str], q: list[str]) -> bool:
    """Are two texts near-copies: of their shingles, each taken with its first place, SIMILAR are common?"""
    flat = np.array([xxhash.xxh64_intdigest(w) for w in (*p, *q)], np.uint64)
    hashes, text = placed(flat, np.array([len(p), len(q)]), np.zeros(2, np.uint64))
    a, b = set(hashes[text == 0].tolist()), set(hashes[text == 1].tolist())
    return len(a & b) >= SIMILAR * len(a | b) > 0


def aligned(texts: DataFrame, known: set[str] | None = None) -> DataFrame:
    """``tid`` of every text (``tid``, ``g``) that a near-copy of at least SIMILAR shows to end early."""
    rows = texts.select(F.lit(0).alias("t"), F.lit("").alias("task"), "tid", F.lit(1).cast("bigint").alias("copies"), "g")
    return cut_early(write_once(taken_apart(rows, known or _Mixed()))).select("tid")


def counted(parts: DataFrame) -> np.ndarray:
    """How often the shingles of each cell occur. The counts are summed in the tasks, then by chunk of cells while
    they stream by, so that neither a worker nor the driver ever holds more than CELLS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for b in batches:
            seen += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False) & (CELLS - 1), minlength=CELLS)
        filled = [k for k in range(CELLS // CHUNK) if seen[k * CHUNK : (k + 1) * CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([seen[k * CHUNK : (k + 1) * CHUNK].tobytes() for k in filled], pa.binary())], ["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "n"])

    kind = "chunk int, n binary"
    out = np.zeros(CELLS, np.int64)
    for k, n in parts.select("shingles").mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind).collect():  # at most CELLS numbers
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(n, np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def cut_early(parts: DataFrame) -> DataFrame:
    """``t``, ``tid`` of every text that a near-copy of at least SIMILAR shows to end early.

    Every text asks and answers, whatever its length and its last mark. Of texts of one class one stands for all. Near
    copies share one of their rarest shingles (prefix filtering: no pair is lost), so texts of one pattern rarely meet;
    of those that meet only such travel on whose last word begins like the word in its place.
    """
    often = parts.sparkSession.sparkContext.broadcast(counted(parts))
    once = parts.select("class", "tid", "words", "head", "heads", "last", "shingles").where(F.size("shingles") > 0).dropDuplicates(["class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("shingles")
            sizes = np.diff(lists.offsets.to_numpy())
            band, text = rarest(lists.flatten().to_numpy(zero_copy_only=False), sizes, often.value)
            rest = b.select(["tid", "words", "head", "heads", "last"]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(band), *rest.columns, pa.array(sizes[text], pa.int32())], ["band", "tid", "words", "head", "heads", "last", "size"])

    keys = once.mapInArrow(run, "band bigint, tid bigint, words int, head string, heads string, last int, size int")
    keys = write_once(keys)
    asking = keys.select("band", F.col("tid").alias("a"), F.col("words").alias("na"), F.col("head").alias("ha"), F.col("last").alias("la"), F.col("size").alias("sa"))
    place = F.col("na") - F.col("words") + F.length("heads")  # of the asking text's last word among the heads, from 1
    # what a similar copy that ends early must have: no more words, nearly as many shingles, and a last word that begins so
    able = (F.col("na") < F.col("words")) | (F.col("na") == F.col("words")) & (F.col("la") != F.col("last"))
    able &= F.least("sa", "size") >= SIMILAR * F.greatest("sa", "size")
    able &= (F.col("ha") == " ") | (place < 1) | (F.substring("heads", place, F.lit(1)) == F.col("ha"))
    pairs = asking.join(keys, "band").where((F.col("a") != F.col("tid")) & able).select("a", F.col("tid").alias("b")).distinct()
    ta, tb = parts.select(F.col("tid").alias("a"), F.col("g").alias("ga")), parts.select(F.col("tid").alias("b"), F.col("g").alias("gb"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}
        for b in batches:
            out = []
            for a, ga, gb in b.itertuples(index=False):
                (_, x), (whole, y) = tokens(ga, cache), tokens(gb, cache)
                if _stops(x, whole, y) and near(x, y):
                    out.append(a)
            yield pd.DataFrame({"tid": out})

    hits = pairs.join(ta, "a").join(tb, "b").select("a", "ga", "gb").mapInPandas(verify, "tid bigint").distinct()
    classes = parts.select("tid", "class").join(hits, "tid", "left_semi").select("class").distinct()
    return parts.select("t", "tid", "class").join(classes, "class", "left_semi").select("t", "tid")


def scored(parts: DataFrame, tasks: DataFrame, model: Model) -> DataFrame:
    """``tid`` of every text whose closing words show it to be cut."""
    shared = parts.sparkSession.sparkContext.broadcast(model)
    classes = tasks.select("task", F.transform("class_labels", lambda c: F.lower(F.regexp_replace(c, r"\p{N}", "0"))).alias("classes")).dropDuplicates(["task"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        cache, lists = {}, {}
        for b in batches:
            out = []
            for tid, task, segs, c in b.itertuples(index=False):
                if task not in lists:
                    lists[task] = tuple(x for x in c if x) if c is not None else ()
                if is_cut(list(segs), m, lists[task], cache):
                    out.append(tid)
            yield pd.DataFrame({"tid": out})

    return parts.join(classes, "task", "left").select("tid", "task", "segs", "classes").mapInPandas(run, "tid bigint")


_NOT_WORD = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


def bare(text: str) -> str:
    """Letters, digits and marks in one case: a text whatever its layout."""
    return _NOT_WORD.sub("", caseless(text))


def fields(text: str, labels: tuple[str, ...]) -> list[str]:
    """The texts under the labels of an input."""
    found = _members(text)
    if found is not None:
        return [v for _, v in found]
    marker = _markers(labels)
    return marker.split(caseless(text))[2::2] if marker else []


def is_copy(generation: str, whole: str | None, prompt: str | None, labels: tuple[str, ...]) -> bool:
    """Is a generation nothing but its prompt, its whole input or a whole field of it again, once or repeatedly, in any layout?"""
    g = bare(generation)
    if not g:
        return False
    sources = []
    if whole:
        sources.append(bare(whole))
        for f in fields(whole, labels):
            sources.append(bare(f))
        for name, f in _labelled(whole, labels):
            sources.append(bare(name) + bare(f))
    if prompt:
        sources.append(bare(prompt))
    if any(s and len(g) % len(s) == 0 and g == s * (len(g) // len(s)) for s in sources):
        return True
    # the whole input with its fields in another order
    return bool(whole and labels) and len(g) == len(sources[0]) and canonical(generation, labels) == canonical(whole, labels)


def _labelled(text: str, labels: tuple[str, ...]) -> list[tuple[str, str]]:
    found = _members(text)
    if found is not None:
        return found
    marker = _markers(labels)
    parts = marker.split(caseless(text)) if marker else []
    return list(zip(parts[1::2], parts[2::2], strict=True))


_PLAIN = bytes(c for c in range(256) if not chr(c).isalnum() or c > 127)
_OTHER = bytes(xxhash.xxh32_intdigest(bytes([c])) & 255 for c in range(256))


Amounts = tuple[int, int, int]


def amounts(text: str) -> Amounts:
    """Three sums over the letters, digits and marks of a text whatever its layout; they add up for joined texts."""
    b = text.lower().encode().translate(None, _PLAIN) if text.isascii() else bare(text).encode("utf-8", "surrogatepass")
    return len(b), sum(b), sum(b.translate(_OTHER))


def mixture(found: Amounts) -> int:
    """Equal for all texts that only differ in layout, that repeat each other, or that have the same parts in another order."""
    least = math.gcd(*found) or 1
    return hash(tuple(x // least for x in found))


def given_amounts(text: str, labels: tuple[str, ...], names: dict[str, Amounts]) -> Iterator[Amounts]:
    """Of a whole input, of each of its fields, and of each with its label."""
    found = _members(text)
    if found is not None:
        yield amounts(text)
        parts = [x for member in found for x in member]
    else:
        marker = _markers(labels)
        head, *parts = marker.split(caseless(text)) if marker else [text]
        total = amounts(head)
    for name, f in zip(parts[0::2], parts[1::2], strict=True):
        if name not in names:
            if len(names) > 10_000:
                names.clear()
            names[name] = amounts(name)
        own = amounts(f)
        both = own[0] + names[name][0], own[1] + names[name][1], own[2] + names[name][2]
        yield own
        yield both
        if found is None:
            total = total[0] + both[0], total[1] + both[1], total[2] + both[2]
    if found is None:
        yield total


def mixtures(instances: DataFrame, tasks: DataFrame) -> DataFrame:
    """``mix``, distinct: of every input, of each of its fields, and of each with its label."""
    labels = tasks.select("task", F.col("field_labels").alias("labels")).dropDuplicates(["task"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[str, Amounts] = {}
        for b in batches:
            out = {mixture(x) for i, la in b.itertuples(index=False) for x in given_amounts(i, tuple(x for x in la if x) if la is not None else (), names)}
            yield pd.DataFrame({"mix": list(out)}, dtype="int64")

    return instances.where("input is not null").select("task", "input").join(labels, "task", "left").select("input", "labels").mapInPandas(run, "mix bigint").distinct()


def prepare(rows: DataFrame, tasks: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, Model]:
    """The distinct texts of ``rows`` (and ``more`` of table 1), taken apart and written, and the model that ``rows`` teach."""
    texts = distinct_texts(rows)
    texts = write_once(texts if more is None else texts.unionByName(distinct_texts(more, 1)))
    known = vocabulary(texts.where("t = 0"), tasks)
    parts = write_once(taken_apart(texts, known))
    return parts, learn(parts.where("t = 0"), known)


def truncated(logs: DataFrame, tasks: DataFrame, instances: DataFrame) -> DataFrame:
    """``log_id``, distinct: the generation ends inside a word or a sentence.

    A copy of the prompt, the input or a whole field is whole, however it ends. Null, empty and letterless
    generations are no case, nor are rows without a log_id.
    """
    parts, model = prepare(logs, tasks)
    tids = cut_early(parts).select("tid").unionByName(scored(parts, tasks, model)).distinct()
    rows = logs.where("log_id is not null and generation is not null").select(F.col("log_id").cast("bigint").alias("log_id"), "task", "instance_id", "generation", F.col("full_prompt_string").alias("prompt"))
    rows = rows.withColumn("g", fold(F.col("generation"))).withColumn("tid", text_id(0)).withColumn("again", begins_alike(F.col("g"), F.col("prompt")))
    hits = rows.select("log_id", "tid", "task", "instance_id", "g", F.when(F.col("again"), F.col("prompt")).alias("prompt")).join(tids, "tid", "left_semi")
    return repeating(hits, instances, tasks, keep=False)


def repeating(rows: DataFrame, instances: DataFrame, tasks: DataFrame, keep: bool = True) -> DataFrame:
    """``log_id``, distinct, of the rows (``log_id``, ``task``, ``instance_id``, ``g``, ``prompt``) whose text only repeats what
    it was given; of the others, if not ``keep``."""
    given = instances.select("instance_id", "input").dropDuplicates(["instance_id"])
    labels = tasks.select("task", F.col("field_labels").alias("labels")).dropDuplicates(["task"])
    # a row without an instance looks for one that isn't there, each its own, so that nulls don't meet in one task
    wanted = F.coalesce(F.col("instance_id").cast("bigint"), F.xxhash64("log_id"))
    asked = rows.withColumn("wanted", wanted).drop("instance_id").join(given.withColumnRenamed("instance_id", "wanted"), "wanted", "left").join(labels, "task", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [k for k, g, p, i, la in b.itertuples(index=False) if is_copy(g, i, p, tuple(x for x in la if x) if la is not None else ()) == keep]
            yield pd.DataFrame({"log_id": out}, dtype="int64")

    return asked.select("log_id", "g", "prompt", "input", "labels").mapInPandas(run, "log_id bigint").distinct()


#: Letters that fold to themselves, or by SAME, so that text of them is equal if and only if it is so after folding.
_SIMPLE = r"a-z0-9\u00e0-\u00fe\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fff"
_SAME = {chr(o): c for o, c in FOLD_CASED.items() if 0x430 <= o <= 0x44F}


def begins_alike(text: F.Column, given: F.Column) -> F.Column:
    """May the text be the whole of what was given, in another layout? Its first eight letters are the same; or some are
    such that only ``is_copy`` can tell. False for nulls."""
    first = r"^[^\p{L}\p{N}\p{M}]*((?:[\p{L}\p{N}\p{M}][^\p{L}\p{N}\p{M}]*){1,8})"
    a, b = (F.regexp_replace(F.lower(F.regexp_extract(x, first, 1)), r"[^\p{L}\p{N}\p{M}]+", "") for x in (text, given))
    odd = F.regexp_like(F.concat(a, b), F.lit(f"[^{_SIMPLE}]"))
    fold_ = [F.translate(x, "".join(_SAME), "".join(_SAME.values())) for x in (a, b)]
    return F.coalesce((a != "") & (odd | (fold_[0] == fold_[1])), F.lit(False))


def shares(logs: DataFrame, runs: DataFrame, cut_ids: DataFrame) -> DataFrame:
    """``model_name``, ``generations``, ``truncated``, ``share`` over distinct log rows; a null model is a source too."""
    rows = logs.select("log_id", "run_id").where("log_id is not null").dropDuplicates(["log_id"])
    named = rows.join(runs.select("run_id", "model_name").dropDuplicates(["run_id"]), "run_id", "left").join(cut_ids.withColumn("hit", F.lit(1)), "log_id", "left")
    out = named.groupBy("model_name").agg(F.count("*").alias("generations"), F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("truncated"))
    return out.withColumn("share", F.col("truncated") / F.col("generations"))
