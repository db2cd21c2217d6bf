"""Words for full-text search: case and diacritics folded, Porter stems; character trigrams."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Letters with marks whose base letter is ASCII, by rule from Unicode's decompositions.
_MARKED = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
_FROM, _TO = "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{M}", ""))


def tokens(text: Column) -> Column:
    """The folded words of a text, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def fold_text(text: str) -> str:
    table = str.maketrans(_FROM, _TO)
    return re.sub(r"[̀-ͯ]", "", text.translate(table)).lower()


def tokens_of(text: str) -> list[str]:
    import regex

    return regex.findall(TOKEN, fold_text(text))


def trigrams(text: Column) -> Column:
    """Distinct lower-case character trigrams; empty below three characters."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))))


def trigrams_of(text: str) -> list[str]:
    t = text.lower()
    return sorted({t[i : i + 3] for i in range(len(t) - 2)})


# The suffix rules of Porter (1980), steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return len(stem) >= 3 and _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str], least: int) -> str:
    for suffix in sorted((s for s in rules if word.endswith(s)), key=len, reverse=True)[:1]:
        stem = word[: -len(suffix)]
        return stem + rules[suffix] if _measure(stem) > least else word
    return word


def porter(word: str) -> str:
    """The Porter stem of a folded word; short words and words with other characters than a-z are left alone."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP2, 0)
    word = _replace(word, STEP3, 0)
    for suffix in sorted((s for s in STEP4 if word.endswith(s)), key=len, reverse=True)[:1]:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def porter_column(words: Column) -> Column:
    """Arrow-batched stems; meant for columns of distinct words."""
    return F.pandas_udf(lambda x: x.map(porter, na_action="ignore"), StringType())(words)


def _stem_all(tokens: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stem(words):
        for w in words:
            if w not in known:
                known[w] = porter(w)
        return [known[w] for w in words]

    return tokens.map(stem, na_action="ignore")


def stems(tokens: Column) -> Column:
    """The stems of arrays of words; each batch stems a word once."""
    return F.pandas_udf(_stem_all, ArrayType(StringType()))(tokens)
