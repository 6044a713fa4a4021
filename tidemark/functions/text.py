"""Text functions: folding, tokens, Porter stems, normalisation, snippets, token estimates."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token characters of the full-text index.
TOKEN = r"[\p{L}\p{N}]+"


def accent_pairs() -> tuple[str, str, str]:
    """Lower-case letters and digits with marks, by canonical decomposition; what is below their marks; and the marks."""
    pairs, marks = {}, []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.combining(c):
            marks.append(c)
        elif c == c.lower() and unicodedata.decomposition(c):
            base, *rest = unicodedata.normalize("NFD", c)
            if base.isalnum() and rest and all(map(unicodedata.combining, rest)):
                pairs[c] = base
    return "".join(pairs), "".join(pairs.values()), "".join(marks)


#: ``translate`` drops what stands in ACCENTED beyond the length of PLAIN: the marks.
LETTERS, PLAIN, MARKS = accent_pairs()
ACCENTED = LETTERS + MARKS


def fold(text: Column) -> Column:
    """Lower case without marks; texts in ASCII need no second pass."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.lower(text), ACCENTED, PLAIN))


def tokens(text: Column) -> Column:
    """Folded tokens in order; none for null."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


FOLDED = str.maketrans(LETTERS, PLAIN, MARKS)


def fold_python(text: str) -> str:
    return text.lower().translate(FOLDED)


def tokens_python(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", fold_python(text)) if t]


def query_phrases(text: str, stemmed: bool = False) -> list[list[str]]:
    """White-space separated terms; one that holds several tokens is a phrase, one without any is left out."""
    out = [tokens_python(term) for term in text.split()]
    return [[stem(t) for t in p] if stemmed else p for p in out if p]


# Porter's algorithm. A word's measure counts the changes from vowels to consonants.


def _shape(word: str) -> str:
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(part: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(part))))


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last none of w, x and y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


#: Suffixes of steps 2, 3 and 4 and what replaces them.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize sion tion"


def _table(spec: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(":")) for x in spec.split()), key=lambda x: -len(x[0]))


TABLE_2, TABLE_3, ENDS_4 = _table(STEP_2), _table(STEP_3), sorted(STEP_4.split(), key=len, reverse=True)


def _replace(word: str, table: list[tuple[str, str]]) -> str:
    for end, new in table:
        if word.endswith(end):
            part = word[: -len(end)]
            return part + new if _measure(part) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter stem of a folded token; tokens that aren't plain letters, or of one or two, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if end:
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, TABLE_2), TABLE_3)
    for end in ENDS_4:
        if word.endswith(end):
            part = word[: -len(end)] + (end[0] if end in ("sion", "tion") else "")
            word = part if _measure(part) > 1 else word
            break
    if word.endswith("e"):
        part = word[:-1]
        if _measure(part) > 1 or (_measure(part) == 1 and not _short_end(part)):
            word = part
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stems_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and the dictionary of words' stems; a batch's distinct words alone become Python strings."""
    coded = words.dictionary_encode()
    stemmed = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    return stemmed.indices.to_numpy()[coded.indices.to_numpy()], stemmed.dictionary


def normalize_text(text: Column) -> Column:
    """Unicode white space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def token_estimate(text: Column) -> Column:
    """Half the bytes and one more: more tokens than there are."""
    return F.expr("1") + F.floor(F.octet_length(text) / 2)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes that splits no character."""
    raw, out = text.cast("binary"), F.lit(None).cast("string")
    for cut in range(max(0, most - 3), max(0, most) + 1):  # the latest cut whose next byte begins a character
        begins = ~F.hex(F.substring(raw, cut + 1, 1)).between("80", "BF")
        out = F.when(begins, F.decode(F.substring(raw, 1, cut), "UTF-8")).otherwise(out)
    return F.when(F.octet_length(text) <= max(0, most), text).otherwise(out)


def fallback_snippet(text: Column, most: int = 160) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def fallback_snippet_python(text: str, most: int = 160) -> str:
    return text[:most] + "…" if len(text) > most else text


SNIPPET_TOKENS = 12
#: A token of a text that isn't folded yet holds the marks of its letters.
RAW_TOKEN = re.compile(rf"[^\W_](?:[^\W_]|[{MARKS}])*")


def snippet_python(text: str, phrases: list[list[str]], stemmed: bool = False) -> str | None:
    """The window of 12 tokens with the most distinct phrases, the earliest of these, matches in brackets; null without a match."""
    spans = [(m.start(), m.end()) for m in RAW_TOKEN.finditer(text)]
    folded = [fold_python(text[a:b]) for a, b in spans]
    if stemmed:
        folded = [stem(t) for t in folded]
    hits = [(k, k + len(p), n) for n, p in enumerate(phrases) for k in range(len(folded) - len(p) + 1) if folded[k] == p[0] and folded[k : k + len(p)] == p]
    if not hits:
        return None
    hits.sort()
    best, at, k = (0, 0), 0, 0
    for first, _, _ in hits:
        while hits[k][0] < first:
            k += 1
        kinds = set()
        for a, b, n in hits[k:]:
            if a >= first + SNIPPET_TOKENS:
                break
            if b <= first + SNIPPET_TOKENS:
                kinds.add(n)
        if len(kinds) > best[0]:
            best, at = (len(kinds), first), first
    begin = max(0, min(at, len(spans) - SNIPPET_TOKENS))
    end = min(len(spans), begin + SNIPPET_TOKENS)
    marked = {j for a, b, _ in hits for j in range(a, b) if begin <= a and b <= end}
    out, last = "…" if begin else "", spans[begin][0]
    for j in range(begin, end):
        a, b = spans[j]
        out += text[last:a] + (f"[{text[a:b]}]" if j in marked else text[a:b])
        last = b
    return out + ("…" if end < len(spans) else "")


def snippet(text: Column, phrases: list[list[str]], stemmed: bool = False) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_python(t, phrases, stemmed), na_action="ignore")

    return cut(text)
