"""Stemmers: Porter, and the English and German ones of the Snowball family.

Written from the published descriptions of the algorithms. Regular words are
cut by rule, so they run in Python; a worker stems each distinct word once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import ship

VOWELS = "aeiou"


def _swap(word: str, ending: str, new: str) -> str:
    return word[: len(word) - len(ending)] + new


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


class Porter:
    """The original algorithm of 1980."""

    STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
             "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize ion".split()

    @staticmethod
    def _kinds(stem: str) -> str:
        """A letter c or v for each letter: y is a vowel after a consonant."""
        out = ""
        for i, x in enumerate(stem):
            out += "v" if x in VOWELS or (x == "y" and i > 0 and out[-1] == "c") else "c"
        return out

    def _measure(self, stem: str) -> int:
        return self._kinds(stem).count("vc")

    def _short(self, stem: str) -> bool:
        return self._kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    def _double(self, stem: str) -> bool:
        return len(stem) > 1 and stem[-1] == stem[-2] and self._kinds(stem)[-1] == "c"

    def __call__(self, word: str) -> str:
        if len(word) <= 2:
            return word
        if word.endswith(("sses", "ies")):
            word = word[:-2]
        elif word.endswith("s") and not word.endswith("ss"):
            word = word[:-1]
        if word.endswith("eed"):
            if self._measure(word[:-3]) > 0:
                word = word[:-1]
        else:
            ending = _longest(word, ("ed", "ing"))
            if ending and "v" in self._kinds(word[: -len(ending)]):
                word = word[: -len(ending)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif self._double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif self._measure(word) == 1 and self._short(word):
                    word += "e"
        if word.endswith("y") and "v" in self._kinds(word[:-1]):
            word = word[:-1] + "i"
        for table in (self.STEP2, self.STEP3):
            ending = _longest(word, table)
            if ending and self._measure(word[: -len(ending)]) > 0:
                word = _swap(word, ending, table[ending])
        ending = _longest(word, self.STEP4)
        if ending:
            stem = word[: -len(ending)]
            if self._measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
                word = stem
        if word.endswith("e"):
            stem = word[:-1]
            if self._measure(stem) > 1 or (self._measure(stem) == 1 and not self._short(stem)):
                word = stem
        if word.endswith("ll") and self._measure(word[:-1]) > 1:
            word = word[:-1]
        return word


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


class English:
    """The English stemmer of the Snowball family."""

    V = "aeiouy"
    DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
    WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    SAME = frozenset("sky news howe atlas cosmos bias andes".split())
    AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
    STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
             "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
    STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
    STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

    def _short_end(self, w: str) -> bool:
        v = self.V
        if len(w) == 2:
            return w[0] in v and w[1] not in v
        return len(w) > 2 and w[-3] not in v and w[-2] in v and w[-1] not in v + "wxY"

    def __call__(self, word: str) -> str:
        v = self.V
        if word in self.WHOLE:
            return self.WHOLE[word]
        if len(word) <= 2 or word in self.SAME:
            return word
        word = word.replace("’", "'").removeprefix("'")
        word = "".join("Y" if x == "y" and (i == 0 or word[i - 1] in v) else x for i, x in enumerate(word))
        prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
        r1 = len(prefix) if prefix else _region(word, v)
        r2 = _region(word, v, r1)
        for ending in ("'s'", "'s", "'"):
            if word.endswith(ending):
                word = word[: -len(ending)]
                break
        if word.endswith("sses"):
            word = word[:-2]
        elif word.endswith(("ied", "ies")):
            word = word[:-2] if len(word) > 4 else word[:-1]
        elif word.endswith("s") and not word.endswith(("us", "ss")) and any(x in v for x in word[:-2]):
            word = word[:-1]
        if word in self.AFTER_1A:
            return word
        ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
        if ending in ("eed", "eedly"):
            if len(word) - len(ending) >= r1:
                word = _swap(word, ending, "ee")
        elif ending and any(x in v for x in word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(self.DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and self._short_end(word):
                word += "e"
        if len(word) > 2 and word[-1] in "yY" and word[-2] not in v:
            word = word[:-1] + "i"
        ending = _longest(word, self.STEP2)
        if ending and len(word) - len(ending) >= r1:
            stem = word[: -len(ending)]
            if (ending != "ogi" or stem.endswith("l")) and (ending != "li" or stem[-1:] in tuple("cdeghkmnrt")):
                word = stem + self.STEP2[ending]
        ending = _longest(word, self.STEP3)
        if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
            word = _swap(word, ending, self.STEP3[ending])
        ending = _longest(word, self.STEP4)
        if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[:-3].endswith(("s", "t"))):
            word = word[: -len(ending)]
        if word.endswith("e"):
            if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not self._short_end(word[:-1])):
                word = word[:-1]
        elif word.endswith("ll") and len(word) - 1 >= r2:
            word = word[:-1]
        return word.replace("Y", "y")


class German:
    """The German stemmer of the Snowball family."""

    V = "aeiouyäöü"

    def __call__(self, word: str) -> str:
        v = self.V
        word = word.replace("ß", "ss")
        word = "".join(x.upper() if x in "uy" and 0 < i < len(word) - 1 and word[i - 1] in v and word[i + 1] in v else x for i, x in enumerate(word))
        r1 = _region(word, v)
        r2 = _region(word, v, r1) if r1 < len(word) else len(word)
        r1 = max(r1, 3)
        ending = _longest(word, ("em", "ern", "er", "e", "en", "es", "s"))
        if ending and len(word) - len(ending) >= r1:
            stem = word[: -len(ending)]
            if ending != "s" or stem[-1:] in tuple("bdfghklmnrt"):
                word = stem
                if ending in ("e", "en", "es") and word.endswith("niss"):
                    word = word[:-1]
        ending = _longest(word, ("en", "er", "est", "st"))
        if ending and len(word) - len(ending) >= r1:
            stem = word[: -len(ending)]
            if ending != "st" or (stem[-1:] in tuple("bdfghklmnt") and len(stem) >= 4):
                word = stem
        ending = _longest(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
        if ending and len(word) - len(ending) >= r2:
            stem = word[: -len(ending)]
            if ending in ("end", "ung"):
                word = stem
                if word.endswith("ig") and len(word) - 2 >= r2 and not word.endswith("eig"):
                    word = word[:-2]
            elif ending in ("ig", "ik", "isch"):
                word = stem if not stem.endswith("e") else word
            elif ending in ("lich", "heit"):
                word = stem
                if word.endswith(("er", "en")) and len(word) - 2 >= r1:
                    word = word[:-2]
            else:
                word = stem
                more = _longest(word, ("lich", "ig"))
                if more and len(word) - len(more) >= r2:
                    word = word[: -len(more)]
        return word.replace("U", "u").replace("Y", "y").replace("ä", "a").replace("ö", "o").replace("ü", "u")


STEMMERS = {"porter": Porter(), "english": English(), "german": German()}


@lru_cache(maxsize=200_000)
def stem_word(kind: str, word: str) -> str:
    return STEMMERS[kind](word)


def stem(words: Column, kind: str, shortest: int = 1) -> Column:
    """Stems of an array of lower-case words; those with fewer letters than ``shortest`` stay as they are."""
    if kind not in STEMMERS:
        raise ValueError(f"no stemmer {kind!r}; there are {', '.join(STEMMERS)}")

    ship()

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(values: pa.Array) -> pa.Array:
        found = values.flatten().dictionary_encode()  # each distinct word of a batch once
        stems = pa.array([w if w is None or len(w) < shortest else stem_word(kind, w) for w in found.dictionary.to_pylist()], found.dictionary.type)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))
        return type(values).from_arrays(pa.array(np.append(0, ends), values.offsets.type), stems.take(found.indices), mask=values.is_null())

    return run(words)
