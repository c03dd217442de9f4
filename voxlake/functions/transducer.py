"""Longest-match rewriting of strings by a table of sequences, in built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

# What a phoneme sequence or symbol is written as; marks of stress and length have no letters.
ROMAN = {
    "dʒ": "j", "tʃ": "ch", "q1": "gh",
    "ʃ": "sh", "ʒ": "zh", "x": "kh", "q": "gh", "j": "y", "ɡ": "g", "ʔ": "",
    "a": "a", "ɑ": "aa", "e": "e", "o": "o", "i": "i", "u": "u",
    "ɪ": "i", "ə": "e", "ɛ": "e", "ɹ": "r", "ɒ": "o", "ʊ": "u", "ʌ": "a", "ð": "d", "ɔ": "o", "ɐ": "a", "ŋ": "ng", "ɜ": "e", "θ": "s", "w": "w",
    "ˈ": "", "ˌ": "", "ː": "", "ʲ": "", "̩": "", "1": "",
}
# What a mark after a word is written as.
MARKS = {",": ",", ".": ".", "?": "?", "!": "!", ";": ",", ":": ""}


def tokens(d, x: str, table: Mapping[str, str]) -> str:
    """`x` as an array of the longest sequences of the table, any other character being one of its own.

    Engines try alternatives in order, so longer sequences stand first.
    """
    keys = "|".join(re.escape(k) for k in sorted(table, key=len, reverse=True))
    return f"regexp_extract_all({x}, '(?s)(?:{keys}|.)'{', 0' if d.name == 'spark' else ''})"


def _lookup(d, w: str, table: Mapping[str, str], otherwise: str) -> str:
    if d.name == "spark":
        pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
        return f"coalesce(element_at(map({pairs}), {w}), {otherwise})"
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in table.items())
    return f"coalesce((MAP {{{pairs}}})[{w}], {otherwise})"


def rewritten(d, x: str, table: Mapping[str, str] = ROMAN, same: str = "^[a-z]$") -> str:
    """`x` rewritten; characters that match `same` stay, and null results if any other one isn't in the table."""
    one = _lookup(d, "w", table, f"CASE WHEN {d.like('w', same)} THEN w END")
    mapped = d.map(tokens(d, x, table), one)
    failed = d.some(mapped, "w IS NULL")
    return f"CASE WHEN {x} IS NULL OR {failed} THEN NULL ELSE coalesce({d.glued(mapped, '')}, '') END"


def _in_passes(x: str) -> str:
    """What `romanised` gives, in a few passes over whole texts: Spark evaluates functions of array elements row by row, and each as often as it is named.

    Sequences stand for themselves as private characters until all others are written, so that nothing is rewritten twice.
    Texts that hold such a character have no letters. Two sequences never overlap.
    """
    long = [k for k in ROMAN if len(k) > 1]
    assert not any(a[-i:] == b[:i] for a in long for b in long for i in range(1, min(len(a), len(b)) + (a != b)))
    single = "".join(k for k in ROMAN if len(k) == 1)
    marks = "".join(re.escape(m) for m in MARKS)
    out = {v: chr(0xE000 + i) for i, v in enumerate(sorted({v for v in ROMAN.values() if len(v) > 1} | {ROMAN[k] for k in long}))}
    one = {k: out.get(v, v) for k, v in {**ROMAN, **MARKS}.items() if len(k) == 1}
    one = {k: v for k, v in one.items() if k != v}
    kept, gone = [k for k in one if one[k]], [k for k in one if not one[k]]
    line = f"concat(' ', {x})"
    for k in long:
        line = f"replace({line}, '{k}', '{out[ROMAN[k]]}')"
    line = f"translate({line}, '{''.join(kept + gone)}', '{''.join(one[k] for k in kept)}')"
    for v, c in out.items():
        line = f"replace({line}, '{c}', '{v}')"
    line = f"regexp_replace(regexp_replace({line}, ' +', ' '), r' (?=[{marks}]|$)', '')"
    failed = f"regexp_like({x}, r'[^a-z {marks}{single}]|[{marks}][^ {marks}]')"
    return f"CASE WHEN {x} IS NULL OR {failed} THEN NULL ELSE regexp_replace({line}, '^[^ ]* ?', '') END"


def romanised(d, x: str) -> str:
    """Phonemes as words of ASCII letters, with the marks after each word; null if a symbol has no letters.

    A chunk of marks alone joins the word before it, or is dropped if there is none.
    """
    if d.name == "spark":
        return _in_passes(x)
    end = "[" + "".join(re.escape(m) for m in MARKS) + "]*$"
    body = d.replace("w", end, "")
    trail = d.map(d.filter(d.split(f"substr(w, length({body}) + 1)", ""), "w <> ''"), _lookup(d, "w", MARKS, "''"))
    word = f"(CASE WHEN {{0}} <> '' THEN concat(' ', {{0}}, {{1}}) WHEN {{0}} = '' THEN {{1}} END)".format(rewritten(d, body), f"coalesce({d.glued(trail, '')}, '')")
    words = d.map(d.filter(d.split(x, " "), "w <> ''"), word)
    line = f"coalesce({d.glued(words, '')}, '')"
    return f"CASE WHEN {x} IS NULL OR {d.some(words, 'w IS NULL')} THEN NULL ELSE {d.replace(line, '^[^ ]* ?', '')} END"
