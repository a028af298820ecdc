"""The published English stemming algorithm (Porter2), over words and token columns."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The algorithm's letter classes, exceptions and suffix tables.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDS = "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"),
    ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("fulli", "ful"), ("lessli", "less"),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_HAS_VOWEL = re.compile(f"[{VOWELS}]")


def _regions(w: str) -> tuple[int, int]:
    for start in ("gener", "commun", "arsen"):
        if w.startswith(start):
            r1 = len(start)
            break
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def _longest(w: str, suffixes) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """A lower-case word's stem; words of up to two letters stay."""
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    if word in KEPT:
        return word
    w = re.sub(f"(?<=[{VOWELS}])y|^y", "Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    end = _longest(w, ("'s'", "'s", "'"))
    w = w[: len(w) - len(end)]
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _HAS_VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURAL:
        return w
    # Past and progressive forms.
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: len(w) - len(end)] + "ee"
    elif end and _HAS_VOWEL.search(w[: len(w) - len(end)]):
        w = w[: len(w) - len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # Derivational suffixes, from outside to inside.
    end = _longest(w, [s for s, _ in STEP2] + ["ogi", "li"])
    if end and len(w) - len(end) >= r1:
        body = w[: len(w) - len(end)]
        if end == "ogi":
            w = body + "og" if body.endswith("l") else w
        elif end == "li":
            w = body if body[-1:] in LI_ENDS else w
        else:
            w = body + dict(STEP2)[end]
    end = _longest(w, [s for s, _ in STEP3] + ["ative"])
    if end and len(w) - len(end) >= r1:
        body = w[: len(w) - len(end)]
        if end == "ative":
            w = body if len(body) >= r2 else w
        else:
            w = body + dict(STEP3)[end]
    end = _longest(w, (*STEP4, "ion"))
    if end and len(w) - len(end) >= r2:
        body = w[: len(w) - len(end)]
        if end != "ion" or body[-1:] in "st":
            w = body
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stems(batch: pd.Series) -> pd.Series:
    return batch.map(lambda words: None if words is None else [stem(w) for w in words])


def stemmed(tokens: Column) -> Column:
    """A token array with every word stemmed; null stays null."""
    return F.pandas_udf(_stems, "array<string>")(tokens)
