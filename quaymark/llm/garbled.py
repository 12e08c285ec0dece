"""Text decoded with the wrong character encoding: found, and restored where possible (problem 6).

Smoothed character trigram models are trained on the clean records of each language. For every record, each
candidate chain (read as A, really B) is undone on the stretches it applies to, and the likeliest result is
taken if it beats the stored text by more than a margin validated on held-out clean and purposely garbled
records. Steps repeat, so text that was misread twice is undone twice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.chars import skeleton
from quaymark.session import cut as write_once

_BYTEWISE = ("latin_1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866")
_WIDE = ("gbk", "cp932", "euc_jp")
#: Candidate chains: (what the bytes were read as, what they were).
CHAINS = (
    *((a, "utf_8") for a in (*_BYTEWISE, *_WIDE)),
    *((a, "cp1252") for a in ("cp437", "cp850", "mac_roman", "cp1251")),
    *((a, "mac_roman") for a in ("cp1252", "latin_1")),
    *((a, "cp437") for a in ("cp1252",)),
    *((a, "cp1251") for a in ("latin_1", "cp1252", "koi8_r", "cp866")),
    *((a, "koi8_r") for a in ("latin_1", "cp1252", "cp1251", "cp866")),
    *((a, "cp866") for a in ("latin_1", "cp1252", "cp1251", "koi8_r")),
    *((a, b) for b in ("gbk", "cp932", "euc_jp") for a in ("latin_1", "cp1252")),
)
_CYRILLIC = ("cp1251", "koi8_r", "cp866")
_NEEDS = {c: "cyrillic" for c in _CYRILLIC} | {c: "wide" for c in _WIDE}
_SCRIPTS = {"latin": regex.compile(r"\p{Latin}"), "cyrillic": regex.compile(r"\p{Cyrillic}"), "wide": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]")}
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "".join(map(chr, range(0x410, 0x450))), "wide": "".join(map(chr, (*range(0x3041, 0x30FF), *range(0x4E00, 0xA000))))}
#: Two Cyrillic encodings turn letters into letters, so a name may gain by chance: such a chain needs this much more, on this many characters.
SWAP_COST, SWAP_LEAST = 7.0, 4
LOST = "\N{REPLACEMENT CHARACTER}"
#: Cells a language for single characters as stored, and folded, for pairs and for triples. A count goes into two cells
#: and is read as the smaller, so that models have a fixed size and a chance meeting of two grams seldom matters.
BITS = (18, 18, 20, 20)
_SEQUENCE = regex.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_SPLIT = regex.compile(r"([ \t\r\n]+)")
_C1 = regex.compile(r"[\x80-\x9f]")


@lru_cache(maxsize=None)
def _byte_of(codec: str) -> dict[str, int]:
    """Character to byte of a one-byte codec; bytes without a character stand for themselves, as readers have them."""
    out = {chr(b): b for b in range(256)} if codec == "latin_1" else {}
    if not out:
        for b in range(256):
            out[bytes([b]).decode(codec, "replace").replace(LOST, chr(b))] = b
        if codec != "cp437" and codec != "mac_roman":
            for b in range(0x80, 0xA0):
                out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _readable(codec: str) -> regex.Pattern:
    """Stretches of characters that the codec could have produced, at least one of them beyond ASCII."""
    odd = "".join(map(regex.escape, (c for c in _byte_of(codec) if ord(c) > 127)))
    return regex.compile(f"[\\x21-\\x7e{odd}]*[{odd}][\\x21-\\x7e{odd}]*")


def _raw(text: str, codec: str) -> bytes | None:
    if codec in _WIDE:
        kept = text.replace(LOST, "")
        if kept.isascii():
            return None
        try:
            return kept.encode(codec)
        except UnicodeEncodeError:
            return None
    table = _byte_of(codec)
    return bytes(table[c] for c in text)


def _undo(stretch: str, read_as: str, really: str) -> str | None:
    raw = _raw(stretch, read_as)
    if raw is None:
        return None
    if really != "utf_8":
        try:
            return raw.decode(really)
        except UnicodeDecodeError:
            if LOST in stretch:
                return raw.decode(really, "replace")
            return None
    if read_as in _WIDE:
        out = raw.decode("utf_8", "replace")
        lost = out.count(LOST)
        return None if lost and (LOST not in stretch and lost > 1 or lost > len(out) // 3) else out
    # byte by byte: only whole sequences are read again, whatever surrounds them stays as it is
    parts, at, hit = [], 0, False
    for m in _SEQUENCE.finditer(raw):
        try:
            new = m[0].decode("utf_8")
        except UnicodeDecodeError:
            continue
        parts += [stretch[at : m.start()], new]
        at, hit = m.end(), True
    return "".join(parts) + stretch[at:] if hit else None


@lru_cache(maxsize=100_000)
def undo(token: str, read_as: str, really: str) -> str | None:
    """``token`` with the chain undone wherever it applies; None if nowhere."""
    if read_as in _WIDE:
        out = _undo(token, read_as, really)
        return out if out != token else None
    parts, at, hit = [], 0, False
    for start, end in _stretches(token, read_as):
        old = token[start:end]
        new = _undo(old, read_as, really)
        if new is not None and new != old:
            parts += [token[at:start], new]
            at, hit = end, True
    return "".join(parts) + token[at:] if hit else None


@lru_cache(maxsize=50_000)
def _stretches(token: str, read_as: str) -> list[tuple[int, int]]:
    return [m.span() for m in _readable(read_as).finditer(token)]


_MIX = tuple(xxhash.xxh64_intdigest(f"gram {k}") | 1 for k in range(8))
_ALL = (1 << 64) - 1


def _cells(gram: str, size: int) -> tuple[int, int]:
    """The two cells of a gram; as ``_cells_of`` for many."""
    h = _MIX[size]
    for k, c in enumerate(gram):
        h = h + ord(c) * _MIX[4 + k] & _ALL
    h = (h ^ h >> 32) * _MIX[7] & _ALL
    h ^= h >> 29
    mask = (1 << BITS[size]) - 1
    return h & mask, (h >> 32) & mask


def _cells_of(points: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.full(len(points[0]), _MIX[size], np.uint64)
    for k, p in enumerate(points):
        h += p * np.uint64(_MIX[4 + k])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX[7])
    h ^= h >> np.uint64(29)
    mask = np.uint64((1 << BITS[size]) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def looks_clean(text: str) -> bool:
    """Fit for training: nothing lost, no control characters, no misread UTF-8."""
    if text.isascii():
        return True
    if LOST in text or _C1.search(text):
        return False
    for w in text.split():
        if not w.isascii():
            for a in _BYTEWISE:
                new = undo(w, a, "utf_8")
                if new is not None and (a not in _CYRILLIC or not {c for c in new if not c.isascii()} & set(w)):
                    return False  # between Cyrillic letters it only counts if nothing stayed as it was
    return True


class Model:
    """Interpolated trigram model over look-alike-folded characters.

    ``own`` counts are those of the record that is judged: they are taken off, so that no record speaks for itself.
    """

    def __init__(self, tables: list[np.ndarray], total: int) -> None:
        self.tables, self.total = tables, max(total, 1)
        self.n = lru_cache(maxsize=100_000)(self._n)
        self.rare = max(3.0, 1e-5 * self.total)
        share = {k: sum(self.n(c, 0) for c in letters) / self.total for k, letters in _LETTERS.items()}
        self.chains = [c for c in CHAINS if share.get(_NEEDS.get(c[1], ""), 1.0) >= 0.05]
        self.scripts = {k for k, v in share.items() if v >= 0.02}
        self.cost = lru_cache(maxsize=50_000)(self._cost)
        self.known = lru_cache(maxsize=50_000)(self._known)
        self.options = lru_cache(maxsize=50_000)(lambda token: options(token, self))

    def _n(self, gram: str, size: int) -> int:
        a, b = _cells(gram, size)
        t = self.tables[size]
        return int(min(t[a], t[b]))

    def _known(self, c: str) -> bool:
        """Of a script that the language is written in; a sign is known if it is seen often enough."""
        if c.isascii():
            return True
        if c.isalpha():
            kind = next((k for k, p in _SCRIPTS.items() if p.match(c)), None)
            return kind in self.scripts and (kind == "latin" or self.n(c, 0) >= 3)
        return self.n(c, 0) >= self.rare

    def _cost(self, token: str, own: Counter | None = None) -> float:
        """Log-likelihood of a token between blanks."""
        s, n = "  " + skeleton(token) + " ", self.n
        out = 0.0
        for i in range(2, len(s)):
            c, b, a, h1, h2 = s[i], s[i - 1 : i + 1], s[i - 2 : i + 1], s[i - 1], s[i - 2 : i]
            k = (n(c, 1), n(b, 2), n(a, 3), n(h1, 1), n(h2, 2))
            if own:
                k = tuple(max(x - own[g], 0) for x, g in zip(k, (c, b, a, h1, h2), strict=True))
            p2 = (k[1] + 2.0 * (k[0] + 0.2) / (self.total + 20_000)) / (k[3] + 2.0)
            out += math.log((k[2] + 2.0 * p2) / (k[4] + 2.0))
        return out

    def apart(self, text: str) -> "Apart":
        return Apart(self, grams(text))


class Apart:
    """A model without one record's own counts."""

    def __init__(self, model: Model, own: Counter) -> None:
        self.model, self.own, self.seen = model, own, {}
        self.known, self.chains = model.known, model.chains

    def options(self, token: str) -> dict[tuple[str, str], tuple[str, float]]:
        return options(token, self)

    def cost(self, token: str) -> float:
        if token not in self.seen:
            self.seen[token] = self.model._cost(token, self.own)
        return self.seen[token]


def grams(text: str) -> Counter:
    """Folded characters, pairs and triples of a text with their counts."""
    out: Counter = Counter()
    s = "  " + skeleton(" ".join(text.split())) + " "
    out.update(s[2:])
    out.update(map(add, s[1:], s[2:]))
    out.update(map(add, map(add, s, s[1:]), s[2:]))
    return out


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def filled_cells(texts: list[str]) -> Cells:
    """(size, cell, number) of everything that a model counts: characters as stored, and folded characters, pairs and triples."""
    if not texts:
        return np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros(0, np.int64)
    folded = ["  " + skeleton(" ".join(t.split())) + " " for t in texts]
    s, ends = _points("".join(folded)), np.cumsum([len(t) for t in folded])
    inside = np.ones(len(s), bool)
    inside[ends[:-1]] = inside[ends[:-1] + 1] = False  # the first two of each text have nothing before them
    inside[:2] = False
    at = np.flatnonzero(inside)
    grams_ = [[_points("".join(texts))], [s[at]], [s[at - 1], s[at]], [s[at - 2], s[at - 1], s[at]]]
    out = [(np.array([-1], np.int8), np.zeros(1, np.int32), np.array([len(at)], np.int64))]
    for size, points in enumerate(grams_):
        a, b = _cells_of(points, size)
        n = np.bincount(a, minlength=1 << BITS[size]) + np.bincount(b[b != a], minlength=1 << BITS[size])
        cell = np.flatnonzero(n)
        out.append((np.full(len(cell), size, np.int8), cell.astype(np.int32), n[cell].astype(np.int64)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def cells(texts: Counter) -> Counter:
    """(size, cell) of everything that a model counts, from texts with their number."""
    out: Counter = Counter()
    for t, n in texts.items():
        for size, cell, k in zip(*(x.tolist() for x in filled_cells([t])), strict=True):
            out[size, cell] += k * n
    return out


def model(counted: dict[tuple[int, int], int]) -> Model:
    """A model from the (size, cell) counts of ``cells``."""
    size, cell = (np.array([k[j] for k in counted], np.int64) for j in (0, 1))
    return _model(size, cell, np.array(list(counted.values()), np.int64))


def _model(size: np.ndarray, cell: np.ndarray, n: np.ndarray) -> Model:
    tables = []
    for k, bits in enumerate(BITS):
        mine = n[size == k]
        t = np.zeros(1 << bits, np.int32 if mine.max(initial=0) < 2**31 else np.int64)
        t[cell[size == k]] = mine
        tables.append(t)
    return Model(tables, int(n[size == -1].sum()))


def _admissible(old: str, new: str, model: Model | Apart, read_as: str, really: str) -> bool:
    """No character that the language doesn't have; no blank made of a letter by a one-byte chain."""
    if really == "utf_8" and read_as not in _CYRILLIC and read_as not in _WIDE:
        return all(c in old or not c.isalpha() or model.known(c) for c in new)  # whole multi-byte sequences are rare by chance
    if really != "utf_8":
        return "\xa0" not in new and all(map(model.known, new))
    return all(map(model.known, new)) or sum(not model.known(c) for c in new) < sum(not model.known(c) for c in old)


def options(token: str, model: Model | Apart) -> dict[tuple[str, str], tuple[str, float]]:
    """What each chain that may apply makes of a token, and the gain in log-likelihood."""
    out, cost = {}, None
    for chain in model.chains:
        new = undo(token, *chain)
        if new is not None and _admissible(token, new, model, *chain):
            cost = model.cost(token) if cost is None else cost
            out[chain] = new, model.cost(new) - cost
    return out


def best_step(tokens: list[str], model: Model | Apart) -> tuple[float, int, int, list[str]]:
    """The chain and run of tokens with the largest gain in log-likelihood: gain, start, end, new tokens."""
    best: tuple[float, int, int, list[str]] = (0.0, 0, 0, [])
    odd = [(k, model.options(w)) for k, w in enumerate(tokens) if not w.isascii()]
    hopeful = {chain for _, found in odd for chain, (_, step) in found.items() if step > 0}
    for read_as, really in (c for c in model.chains if c in hopeful):
        swap = read_as in _CYRILLIC and really in _CYRILLIC
        gain, start, new = 0.0, None, {}
        for k, found in odd:
            w, step = found.get((read_as, really), (None, -1e9))
            if gain + step > 0 and (start is not None or step > 0):
                if start is None:
                    start, new = k, {}
                gain += step
                new[k] = w
                net = gain - SWAP_COST * swap
                if net > best[0] and not (swap and sum(c.isalpha() for j in new for c in tokens[j]) < SWAP_LEAST):
                    best = (net, start, k + 1, [new.get(j, tokens[j]) for j in range(start, k + 1)])
            else:
                gain, start, new = 0.0, None, {}
    return best


def first_gain(tokens: list[str], text: str, model: Model) -> float:
    """What the best step gains without the text's own counts; taking them off only matters where something is gained."""
    return best_step(tokens, model.apart(text))[0] if best_step(tokens, model)[0] > 0 else 0.0


def restore(text: str, model: Model, margin: float) -> tuple[str, bool]:
    """The text with every accepted step undone, and whether any was. Each makes it likelier, so there is an end."""
    parts = _SPLIT.split(text)
    hit = False
    if first_gain(parts[0::2], text, model) <= margin:
        return text, False
    model = model.apart(text)
    while True:
        tokens = parts[0::2]
        gain, a, b, new = best_step(tokens, model)
        if gain <= margin:
            break
        parts[0::2] = tokens[:a] + new + tokens[b:]
        hit = True
    return "".join(parts), hit


def train(rows: DataFrame, before: dict[str, Cells] | None = None) -> dict[str, Cells]:
    """The filled cells of a model per language from all clean records of ``lang``, ``text``; the counts are summed map-side into a
    fixed number of cells, so what comes to the driver has a bound that doesn't depend on the data.

    With models from ``before``, records that any chain makes likelier under them aren't clean either, and their
    counts are taken off: what is garbled alike many times would otherwise speak for itself.
    """
    shared = rows.sparkSession.sparkContext.broadcast(before) if before is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[str, Model] = {}

        def counts(lang: str, t: str) -> bool:
            if shared is not None:
                if t.isascii():
                    return False
                if lang not in first:
                    first[lang] = _model(*shared.value[lang]) if lang in shared.value else model({})
                return looks_clean(t) and best_step(_SPLIT.split(t)[0::2], first[lang])[0] > 0
            return looks_clean(t)

        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                size, cell, n = filled_cells([t for t in texts if counts(lang, t)])
                yield pd.DataFrame({"lang": lang, "size": size.astype(np.int32), "cell": cell, "n": n})

    found = rows.where("text is not null").mapInPandas(run, "lang string, size int, cell int, n bigint").groupBy("lang", "size", "cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    made = {lang: (p["size"].to_numpy(np.int8), p["cell"].to_numpy(np.int32), p["n"].to_numpy(np.int64)) for lang, p in found.groupby("lang")}
    return made if before is None else {lang: _less(have, made.get(lang)) for lang, have in before.items()}


def _less(have: Cells, off: Cells | None) -> Cells:
    """Counts without others that are part of them."""
    if off is None:
        return have
    at = dict(zip(zip(off[0].tolist(), off[1].tolist(), strict=True), off[2].tolist(), strict=True))
    n = have[2] - np.array([at.get(k, 0) for k in zip(have[0].tolist(), have[1].tolist(), strict=True)], np.int64)
    return have[0][n > 0], have[1][n > 0], n[n > 0]


#: The margins that are tried.
MARGINS = np.arange(1.5, 15.0, 0.5)


def misread(text: str, chains: list[tuple[str, str]]) -> tuple[str, tuple[str, str]] | None:
    """A text with one chain applied to it (the first that changes it, from a place by a hash on), and that chain."""
    at = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) % max(len(chains), 1)
    for read_as, really in chains[at:] + chains[:at]:
        try:
            wrong = text.encode(really).decode(read_as)
        except UnicodeError:
            continue
        if wrong != text:
            return wrong, (read_as, really)
    return None


def _gains(tokens: list[str], model: Model | Apart, chain: tuple[str, str], enough: float) -> bool:
    """Does undoing this chain gain more than ``enough``? Then the best step does, whatever other chains gain."""
    swap = chain[0] in _CYRILLIC and chain[1] in _CYRILLIC
    gain, letters = 0.0, 0
    for w in tokens:
        if w.isascii():
            continue
        new = undo(w, *chain)
        step = model.cost(new) - model.cost(w) if new is not None and _admissible(w, new, model, *chain) else -1e9
        if gain + step > 0:
            gain, letters = gain + step, letters + sum(map(str.isalpha, w))
            if gain - SWAP_COST * swap > enough and not (swap and letters < SWAP_LEAST):
                return True
        else:
            gain, letters = 0.0, 0
    return False


def told_apart(text: str, model: Model) -> tuple[float, float | None]:
    """What the best step gains on a clean record, and on the same with one chain applied to it (infinite if more than any
    margin; None if no chain changes it); neither speaks for itself."""
    clean, made = first_gain(_SPLIT.split(text)[0::2], text, model), misread(text, model.chains)
    if made is None:
        return clean, None
    tokens, apart = _SPLIT.split(made[0])[0::2], model.apart(text)
    return clean, math.inf if _gains(tokens, apart, made[1], MARGINS[-1]) else best_step(tokens, apart)[0]


def steps(gains: list[float]) -> np.ndarray:
    """How many gains exceed just the first k of MARGINS, by k."""
    return np.bincount(np.searchsorted(MARGINS, gains), minlength=len(MARGINS) + 1)


def best_margin(clean: np.ndarray, wrong: np.ndarray) -> float:
    """The lowest margin that best tells clean records from garbled ones, from their ``steps``; the first without any."""
    if not clean.sum() or not wrong.sum():
        return float(MARGINS[0])
    taken, left = clean.sum() - np.cumsum(clean)[:-1], np.cumsum(wrong)[:-1]
    return float(MARGINS[(taken * 5 + left).argmin()])


def validate(rows: DataFrame, filled: Broadcast, key: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows (``key``, ``lang``, ``text``) on which something is lost, or a step gains more than the lowest margin; and the
    ``steps`` of all clean records beyond ASCII, and of the same with one chain applied to them. Every record is looked at
    once; the steps are summed in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours: dict[str, Model] = {}
        counts = np.zeros((2, len(MARGINS) + 1), np.int64)
        for b in batches:
            out, clean, wrong = [], [], []
            for k, la, t in zip(*(b.column(c).to_pylist() for c in (key, "lang", "text")), strict=True):
                if t.isascii():
                    continue
                if la not in ours:
                    ours[la] = _model(*filled.value[la]) if la in filled.value else model({})
                if looks_clean(t) and la in filled.value:
                    gain, other = told_apart(t, ours[la])
                    clean.append(gain)
                    wrong += [] if other is None else [other]
                else:
                    gain = first_gain(_SPLIT.split(t)[0::2], t, ours[la])
                if gain > MARGINS[0] or LOST in t:
                    out.append((k, la, t, None, None, None))
            counts += np.array([steps(clean), steps(wrong)])
            yield batch(out)
        yield batch([(None, None, None, k, int(c), int(w)) for k, (c, w) in enumerate(counts.T) if c or w])

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    names = (key, "lang", "text", "step", "clean", "wrong")

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    found = write_once(rows.select(key, "lang", "text").mapInArrow(run, f"{key} bigint, lang string, text string, step int, clean bigint, wrong bigint"))
    summed = found.where("step is not null").groupBy("step").agg(F.sum("clean"), F.sum("wrong")).collect()  # a row for each margin at most
    counts = np.zeros((2, len(MARGINS) + 1), np.int64)
    for k, c, w in summed:
        counts[:, k] = c, w
    return found.where("step is null").select(key, "lang", "text"), *counts


def garbled(records: DataFrame, key: str = "instance_id", lang: str = "lang", text: str = "text", margin: float | None = None) -> DataFrame:
    """``key``, ``restored``, ``complete`` of every record that was decoded wrongly, wholly or in part.

    ``complete`` is false where characters were lost for good; the rest is restored all the same. A null
    language has a model of its own. Null and empty texts are no case. An empty table gives an empty result.
    """
    rows = records.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text")).where("text is not null")
    once = rows.select("lang", "text")
    filled = train(once, train(once))
    shared = records.sparkSession.sparkContext.broadcast(filled)
    if margin is None:
        rows, clean, wrong = validate(rows, shared, key)
    limit = margin if margin is not None else best_margin(clean, wrong)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ours: dict[str, Model] = {}
        for b in batches:
            out = []
            for k, la, t in b.itertuples(index=False):
                if t.isascii():
                    continue
                if la not in ours:
                    ours[la] = _model(*shared.value[la]) if la in shared.value else model({})
                new, hit = restore(t, ours[la], limit)
                if hit or LOST in t:
                    out.append((k, new, LOST not in new))
            yield pd.DataFrame(out, columns=[key, "restored", "complete"])

    return rows.mapInPandas(run, f"{key} bigint, restored string, complete boolean")
