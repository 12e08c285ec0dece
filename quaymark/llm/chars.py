"""One form for text that looks the same: ignorables, compatibility forms, combining marks, look-alike letters."""

from __future__ import annotations

import re
import sys
import unicodedata as U

# Letters of other scripts that are drawn as the Latin letter in the same place below.
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαο", "ABEZHIKMNOPTYXao"
CYRILLIC, CYRILLIC_AS = "АВЕКМНОРСТХУЅІЈаеорсухѕіј", "ABEKMHOPCTXYSIJaeopcyxsij"

_PREPENDED = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_LAYOUT = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>"}


def _ignorable(c: str) -> bool:
    o = ord(c)
    return (U.category(c) == "Cf" and o not in _PREPENDED) or o == 0x34F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def _same_look(c: str) -> bool:
    kind = U.decomposition(c).partition(" ")[0]
    name = U.name(c, "")
    return kind in _LAYOUT or kind == "<compat>" and ("LIGATURE" in name or name.startswith("ROMAN NUMERAL") or U.category(c) == "Zs")


def _layout_table() -> dict[int, str]:
    """Ignorables to nothing, compatibility forms of the same look to their plain form; by rule, over all of Unicode."""
    table: dict[int, str] = {}
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        if _ignorable(c):
            table[o] = ""
        elif U.decomposition(c).startswith("<") and _same_look(c):
            table[o] = U.normalize("NFKC", c)
    table[0x2010] = table[0x2011] = "-"
    return table


LAYOUT = _layout_table()
OTHER, LATIN = GREEK + CYRILLIC, GREEK_AS + CYRILLIC_AS
FOLD = {ord(o): a for o, a in zip(OTHER, LATIN, strict=True)}
#: As FOLD, for text whose case is folded; the lower case of a capital that looks Latin follows its capital.
FOLD_CASED = {ord(o.lower()): a.lower() for o, a in zip(OTHER, LATIN, strict=True)}


#: Characters that the full way below leaves as they are, case aside, whatever stands beside them: composed Latin letters, ordinary signs, kana, Han.
_STILL = "\\x00-\\x7f\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b4\u00b6-\u0131\u0134-\u0148\u014a-\u017e\u2013\u2014\u2018-\u201e\u2026\u3001-\u3003\u3005-\u3011\u3041-\u3096\u30a1-\u30fa\u30fc-\u30fe\u4e00-\u9fff"
_STAYS = re.compile(f"[{_STILL}]*").fullmatch
#: With Cyrillic letters that aren't composed of a look-alike and a mark.
_CYRILLIC = re.compile(f"[{_STILL}\u0410-\u044f]*").fullmatch


def stays(text: str) -> bool:
    """Is the text surely its own skeleton?"""
    return text.isascii() or bool(_STAYS(text))


def plain(text: str) -> str:
    """Without ignorables, compatibility forms made plain, marks composed."""
    return text if text.isascii() or _CYRILLIC(text) else U.normalize("NFC", text.translate(LAYOUT))


def skeleton(text: str) -> str:
    """Equal for texts of equal look, case kept; only a key, not a spelling."""
    if text.isascii() or _STAYS(text):
        return text
    if _CYRILLIC(text):
        return text.translate(FOLD)
    return U.normalize("NFC", U.normalize("NFD", text.translate(LAYOUT)).translate(FOLD))


def caseless(text: str) -> str:
    """Equal for texts that differ in look-alikes and case; punctuation and blanks kept."""
    if text.isascii() or _STAYS(text):
        return text.casefold()
    if _CYRILLIC(text):
        return text.casefold().translate(FOLD_CASED)
    return U.normalize("NFC", U.normalize("NFD", U.normalize("NFD", text.translate(LAYOUT)).casefold()).translate(FOLD_CASED))
