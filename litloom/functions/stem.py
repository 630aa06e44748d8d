"""The second Porter stemmer for English words, after its published description.

Stems are computed once for each distinct word: join a text's words with ``stems`` of the vocabulary.
Words of up to two letters, and words with other letters than a to z and ', stay as they are; NULL
stays NULL.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words with stems of their own, words that end after step 1a, beginnings with a region of their own.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
       "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
DONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
BEGINNINGS = ("gener", "commun", "arsen")
# Endings with what replaces them where they lie in the first region, longest first, and where in the second.
STEP_2 = {"ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate",
          "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, begin: int) -> int:
    m = _REGION.search(word, begin)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str:
    return next((e for e in endings if word.endswith(e)), "")


def stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word):
        return word
    word = word.removeprefix("'")
    if word in OWN:
        return OWN[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)  # these count as consonants
    first = next((len(b) for b in BEGINNINGS if word.startswith(b)), 0) or _after(word, 0)
    second = _after(word, first)
    word = re.sub(r"'(?:s'?)?$", "", word)
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in DONE:
        return word
    # 1b: -ed, -ing and their adverbs
    if end := _ending(word, ("eedly", "eed")):
        word = word[:-len(end)] + "ee" if len(word) - len(end) >= first else word
    elif (end := _ending(word, ("ingly", "edly", "ing", "ed"))) and _VOWEL.search(word[:-len(end)]):
        word = word[:-len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif first >= len(word) and _SHORT.search(word):
            word += "e"
    # 1c: a last y after a consonant
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # 2 and 3: longer endings to shorter ones
    if end := _ending(word, STEP_2):
        at = len(word) - len(end)
        allowed = word[at - 1:at] == "l" if end == "ogi" else word[at - 1:at] in tuple("cdeghkmnrt") if end == "li" else True
        if at >= first and allowed:
            word = word[:at] + STEP_2[end]
    if end := _ending(word, STEP_3):
        at = len(word) - len(end)
        if at >= (second if end == "ative" else first):
            word = word[:at] + STEP_3[end]
    # 4: endings that fall
    if end := _ending(word, STEP_4):
        at = len(word) - len(end)
        if at >= second and (end != "ion" or word[at - 1:at] in ("s", "t")):
            word = word[:at]
    # 5: a last e or one of two l
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or at >= first and not _SHORT.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


def stems(words: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(stem, na_action="ignore")

    return run(words)
