"""The Porter stemmer, for columns of words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Endings and what they become, by step, longest first.
_STEP2 = (("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"), ("eli", "e"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    """c and v for each letter: y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for end, by in pairs:
        if word.endswith(end):
            return word[: -len(end)] + by if _measure(word[: -len(end)]) > 0 else word
    return word


def fold(word: str) -> str:
    """Latin letters without their marks, as full-text indexes fold them: é is e; letters that are no marked a to z stay."""
    if word.isascii():
        return word
    parts = (unicodedata.normalize("NFD", c) for c in word)
    return "".join(p[0] if p[0].isascii() and len(p) > 1 else unicodedata.normalize("NFC", p) for p in parts)


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word, its letters folded; words of up to two letters or over 64, and others than a to z, stay."""
    word = fold(word)
    if not 3 <= len(word) <= 64 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for end in _STEP4:
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.arrow_udf(ArrayType(StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Stems of arrays of words. Only a batch's distinct words become Python objects."""
    each = words.flatten().dictionary_encode()
    known = pa.array([None if w is None else stem(w) for w in each.dictionary.to_pylist()], pa.string())
    places = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), known.take(each.indices), mask=words.is_null())
