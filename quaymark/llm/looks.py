"""Text of equal look in one spelling (problem 3).

Tokens in odd characters are looked up in tries of the corpus's own plain tokens by an automaton whose edits
cost nothing between look-alikes and for ignorables; the most frequent plain spelling is taken, and what no
trie holds is spelled by table. Tries are sharded by a key that zero-cost edits don't change, so no worker
holds the vocabulary.
"""

from __future__ import annotations

import unicodedata as U
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.chars import CYRILLIC, CYRILLIC_AS, FOLD, GREEK, GREEK_AS, LAYOUT, plain, skeleton, stays
from quaymark.session import cut

_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}͏︀-️]+")
_ORDINARY = str.maketrans("", "", " \t\n\r\x0b\x0c")
_BLANK = regex.compile(r"\s+")
_LAT = regex.compile(r"\p{Latin}")
_CYR = regex.compile(r"\p{Cyrillic}")
_GRE = regex.compile(r"\p{Greek}")
_AS = {"c": dict(zip(CYRILLIC_AS, CYRILLIC, strict=True)), "g": dict(zip(GREEK_AS, GREEK, strict=True))}
_SHARED = {"l": set(CYRILLIC_AS + GREEK_AS), "c": set(CYRILLIC), "g": set(GREEK)}


def script(text: str) -> str:
    """The alphabet that look-alikes are spelled in: that of most letters which have no look-alike; Latin on a tie."""
    if stays(text):
        return "l"
    count = {k: sum(c not in _SHARED[k] for c in p.findall(text)) for k, p in (("l", _LAT), ("c", _CYR), ("g", _GRE))}
    return max(("l", "c", "g"), key=lambda k: count[k])


def spelled(token: str, alphabet: str) -> str:
    """The table's spelling: plain characters, look-alikes in the letters of ``alphabet``."""
    folded = U.normalize("NFD", token.translate(LAYOUT)).translate(FOLD)
    back = _AS.get(alphabet)
    if back and not any(_LAT.match(c) and c not in back for c in folded):
        folded = "".join(back.get(c, c) for c in folded)
    return U.normalize("NFC", folded)


@lru_cache(maxsize=100_000)
def is_plain(token: str, alphabet: str) -> bool:
    """Written as the table writes it, so a spelling that others may be brought to."""
    return alphabet == "l" and stays(token) or token == spelled(token, alphabet)


class Trie:
    """Plain spellings with their counts; ``nearest`` walks it with edits that cost nothing."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, token: str, count: int) -> None:
        node = self.root
        for c in U.normalize("NFD", token):
            node = node.setdefault(c, {})
        node[""] = max(node.get("", (0, ""))[0], count), token

    def nearest(self, token: str, limit: int = 0) -> str | None:
        """The most frequent spelling within ``limit`` edits, the smallest on a tie; None if there is none.

        Weighted edits: look-alikes and ignorables 0, any other substitution, insertion or deletion 1.
        States are (trie node, place in the token); with limit 0 only zero-cost moves remain.
        """
        text = U.normalize("NFD", token.translate(LAYOUT))  # expands ligatures, drops ignorables: zero cost
        todo, best, seen = [(0, 0, id(self.root), self.root)], None, set()
        while todo:
            cost, at, key, node = todo.pop()
            if (cost, at, key) in seen:
                continue
            seen.add((cost, at, key))
            if at == len(text):
                if "" in node:
                    found = (cost, -node[""][0], node[""][1])
                    best = min(best, found) if best else found
            else:
                look = FOLD.get(ord(text[at]), text[at])
                for c, child in node.items():
                    if c == "":
                        continue
                    step = 0 if c == text[at] or FOLD.get(ord(c), c) == look else 1
                    if cost + step <= limit:
                        todo.append((cost + step, at + 1, id(child), child))
                if cost < limit:
                    todo.append((cost + 1, at + 1, key, node))
            if cost < limit:
                todo.extend((cost + 1, at, id(child), child) for c, child in node.items() if c != "")
        return best[2] if best else None


def vocabulary(texts: DataFrame) -> DataFrame:
    """``alphabet``, ``token``, ``plain``, ``n``, ``shard`` of every token in the corpus, counted map-side.

    Plain tokens matter only where they hold a letter that something else may be mistaken for, which is any;
    all are kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, Counter] = {"l": Counter(), "c": Counter(), "g": Counter()}
            for t in b["text"]:
                seen[script(t)].update(_TOKEN.findall(t))
            rows = [(a, w, is_plain(w, a), n, xxhash.xxh32_intdigest(skeleton(w)) & 0x7FFFFFFF) for a, found in seen.items() for w, n in found.items()]
            yield pd.DataFrame(rows, columns=["alphabet", "token", "plain", "n", "shard"])

    return texts.mapInPandas(run, "alphabet string, token string, plain boolean, n bigint, shard int").groupBy("alphabet", "token", "plain", "shard").agg(F.sum("n").alias("n"))


def spellings(vocab: DataFrame) -> DataFrame:
    """``alphabet``, ``token``, ``spelling`` of every token that isn't plain.

    Tokens are spread and sorted by their shard, which zero-cost edits don't change; a trie is built from as many whole
    shards as come in a batch, so their number grows with the vocabulary and no trie does.
    """
    odd = vocab.where("not plain")
    wanted = odd.select("alphabet", "shard").distinct()
    ours = vocab.where("plain").join(wanted, ["alphabet", "shard"], "left_semi").unionByName(odd).select("alphabet", "token", "plain", "shard", "n")

    def spell(rows: pd.DataFrame) -> pd.DataFrame:
        tries: dict[str, Trie] = {}
        for a, w, n in rows.loc[rows["plain"], ["alphabet", "token", "n"]].itertuples(index=False):
            tries.setdefault(a, Trie()).add(w, n)
        out = []
        for a, w in rows.loc[~rows["plain"], ["alphabet", "token"]].itertuples(index=False):
            found = tries[a].nearest(w) if a in tries else None
            out.append((a, w, found if found is not None else spelled(w, a)))
        return pd.DataFrame(out, columns=["alphabet", "token", "spelling"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            begun = b["shard"] == b["shard"].iloc[-1]  # may go on in the next batch
            rest = b[begun]
            yield spell(b[~begun])
        if rest is not None:
            yield spell(rest)

    return ours.repartition("shard").sortWithinPartitions("shard").mapInPandas(run, "alphabet string, token string, spelling string")


def consistent(records: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``records`` (``key`` columns and ``text``) with ``canonical``: the text in one consistent form.

    Only texts that hold a token to respell are taken apart; a null text stays null, an empty one empty.
    Line breaks and ordinary blanks stay, other blanks become ordinary ones.
    """
    parts = records.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    table = spellings(cut(vocabulary(parts)))

    def odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks, tokens = [], []
            for t in b["text"]:
                alphabet = script(t) if t is not None else "l"
                marks.append(alphabet)
                tokens.append([] if t is None or stays(t) else sorted({w for w in _TOKEN.findall(t) if not is_plain(w, alphabet)}))
            yield b.assign(alphabet=marks, tokens=tokens)

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, pairs in zip(b["text"], b["pairs"], strict=True):
                if t is not None:
                    new = {p["token"]: p["spelling"] for p in pairs} if pairs is not None else {}
                    t = plain(_TOKEN.sub(lambda m: new.get(m[0], m[0]), t)) if new else plain(t)
                out.append(t)
            yield b.drop(columns="pairs").assign(canonical=out)

    kinds = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in key)
    base = records.select(*key, F.col(text).alias("text"))
    marked = base.mapInPandas(odd, f"{kinds}, text string, alphabet string, tokens array<string>")
    marked = cut(marked.withColumn("row", F.monotonically_increasing_id()))
    clean = marked.where(F.size("tokens") == 0).select(*key, "text", F.lit(None).cast("array<struct<token:string,spelling:string>>").alias("pairs"))
    asked = marked.where(F.size("tokens") > 0).select("row", "alphabet", F.explode("tokens").alias("token"))
    found = asked.join(table, ["alphabet", "token"]).groupBy("row").agg(F.collect_list(F.struct("token", "spelling")).alias("pairs"))
    dirty = marked.where(F.size("tokens") > 0).join(found, "row", "left").select(*key, "text", "pairs")
    return clean.unionByName(dirty).mapInPandas(rewrite, f"{kinds}, text string, canonical string")


def same_look(records: DataFrame, id_col: str = "instance_id", group: str = "task", text: str = "input") -> DataFrame:
    """``id_a``, ``id_b``: all pairs in a group whose texts look the same but are stored in different characters.

    Ordinary blanks, tabs and line breaks are left out of both comparisons. Texts stored alike are one form:
    forms are paired, then their ids, so copies of one form are never compared with each other. Null ids,
    groups and texts and blank texts are no case.
    """
    named = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(group).alias("grp"), F.col(text).alias("text")).where("id is not null and grp is not null and text is not null")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            look = [_BLANK.sub("", c) for c in b["canonical"]]
            stored = [t.translate(_ORDINARY) for t in b["text"]]
            out = b[["id", "grp"]].assign(look=[xxhash.xxh3_128_digest(x.encode()) for x in look], stored=[xxhash.xxh3_128_digest(x.encode()) for x in stored])
            yield out[[bool(x) for x in look]]

    keys = cut(consistent(named, ["id", "grp"]).mapInPandas(digest, "id bigint, grp string, look binary, stored binary"))
    forms = keys.groupBy("grp", "look", "stored").agg(F.count("*").alias("rows"))
    several = forms.groupBy("grp", "look").agg(F.min("stored").alias("least"), F.max("stored").alias("most")).where("least <> most").select("grp", "look")
    ours = cut(keys.join(several, ["grp", "look"], "left_semi").distinct())
    forms = ours.select("grp", "look", "stored").distinct()
    apart = forms.withColumnRenamed("stored", "a").join(forms.withColumnRenamed("stored", "b"), ["grp", "look"]).where("a < b")
    one, two = (ours.select("grp", "look", F.col("stored").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    pairs = apart.join(one, ["grp", "look", "a"]).join(two, ["grp", "look", "b"]).where("id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
