"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) for ASCII words.

Words of under 3 or over 20 letters and words with anything but a to z are left as they are, but that a digit
before a final s counts as a letter without vowels.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Suffixes of steps 2, 3 and 4.
STEP_2 = dict(
    pair.split(":")
    for pair in "ational:ate tional:tion enci:ence anci:ance izer:ize logi:log bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
)
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x and y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(1 << 18)
def stem(word: str) -> str:
    if not 3 <= len(word) <= 20 or not re.fullmatch("[a-z0-9]+", word):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif (cut := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    if (s := _longest(w, STEP_2)) and _measure(w[: -len(s)]) > 0:
        w = w[: -len(s)] + STEP_2[s]
    if (s := _longest(w, STEP_3)) and _measure(w[: -len(s)]) > 0:
        w = w[: -len(s)] + STEP_3[s]
    if (s := _longest(w, STEP_4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(tokens):
    """Column of token arrays to stems, in Arrow batches: a batch's different words are stemmed, and remembered across batches."""
    from pyspark.sql import functions as F

    def stems(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        stemmed_words = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(np.append(np.zeros(1, np.int32), ends)), stemmed_words, mask=lists.is_null())

    # Spark takes the kind of function from these hints, which it can't read where annotations are strings
    stems.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(stems, "array<string>")(tokens)
