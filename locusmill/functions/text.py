"""Names: normal forms, cores, scores.  What Spark has built in stays in the JVM; the rest is Arrow-batched."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _batched(kind: str, one, *columns: Column) -> Column:
    """An Arrow-batched function of values, called once for equal ones of a batch; null if any is null.  Made at the call, so that workers can
    import this module."""

    def run(*s: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for row in zip(*s):
            if any(v is None for v in row):
                out.append(None)
                continue
            if row not in known:
                known[row] = one(*row)
            out.append(known[row])
        return pd.Series(out, dtype=object)

    if len(columns) == 1:
        return F.pandas_udf(lambda a: run(a), kind)(*columns)
    return F.pandas_udf(lambda a, b: run(a, b), kind)(*columns)


def nfkc(s: Column) -> Column:
    """The compatibility normal form; plain ASCII is its own and stays in the JVM."""
    plain = s.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, s).otherwise(_batched("string", lambda x: unicodedata.normalize("NFKC", x), F.when(~plain, s)))


def trimmed(s: Column) -> Column:
    """NFKC without outer white space."""
    return F.regexp_replace(nfkc(s), r"(?U)^\s+|\s+$", "")


def core_name(s: Column, suffix: str = r"(?:支店|本店|店)$") -> Column:
    """NFKC, lower case, without marks and spaces, and without a branch suffix if two characters remain."""
    bare = F.regexp_replace(F.lower(nfkc(F.coalesce(s, F.lit("")))), r"(?U)[\s\p{Punct}・‐–—〜~「」『』【】（）]+", "")
    cut = F.regexp_replace(bare, suffix, "")
    return F.when(F.length(cut) >= 2, cut).otherwise(bare)


def names_match(a: Column, b: Column) -> Column:
    """Equal, or one contains the other and the shorter has three characters."""
    held = F.when(F.length(a) <= F.length(b), b.contains(a) & (F.length(a) >= 3)).otherwise(a.contains(b) & (F.length(b) >= 3))
    return (a != "") & (b != "") & ((a == b) | held)


def _ratio(a: Column, b: Column) -> Column:
    return _batched("double", lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), a, b)


def _known_score(a: Column, b: Column) -> Column:
    """The score where no ratio is needed, else null."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(names_match(a, b), 0.9)


def name_score(a: Column, b: Column) -> Column:
    """1.0 equal, 0.9 containment, else the longest-matching-blocks ratio (a before b: the ratio is not symmetric), which only names that are
    neither reach Python for."""
    known = _known_score(a, b)
    open_ = known.isNull()
    return F.coalesce(known, _ratio(F.when(open_, a), F.when(open_, b)))


def letters(s: Column) -> Column:
    """map<letter, count> of a name, to be made once a name and not once a pair."""
    each = F.split(s, "")
    return F.map_from_entries(F.transform(F.array_distinct(F.filter(each, lambda c: c != "")), lambda c: F.struct(c, F.size(F.filter(each, lambda x: x == c)))))


def score_bound(a: Column, b: Column, letters_a: Column, letters_b: Column) -> Column:
    """What name_score is at most: matching blocks hold no letter more often than either name, so their length is bounded by the common letters."""
    common = F.aggregate(F.map_entries(letters_a), F.lit(0), lambda n, e: n + F.least(e["value"], F.coalesce(F.try_element_at(letters_b, e["key"]), F.lit(0))))
    return F.coalesce(_known_score(a, b), F.try_divide(2.0 * common, F.length(a) + F.length(b)))


class Substrings:
    """The suffix automaton of a text: after one build, linear in the text, the longest common substring with another is one walk over that."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            cur = self._state({}, self.length[last] + 1, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[cur] = copy
            last = cur

    def _state(self, steps: dict[str, int], length: int, link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def longest(self, other: str) -> int:
        at = held = best = 0
        for c in other:
            while at and c not in self.next[at]:
                at = self.link[at]
                held = self.length[at]
            if c in self.next[at]:
                at, held = self.next[at][c], held + 1
                best = max(best, held)
        return best


def longest_common(a: Column, b: Column) -> Column:
    """The length of the longest common substring; a batch builds one automaton for each name in b and walks all names in a beside it."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        built: dict[str, Substrings] = {}
        out: list[int | None] = []
        for s, t in zip(x, y):
            if s is None or t is None:
                out.append(None)
                continue
            if t not in built:
                built[t] = Substrings(t)
            out.append(built[t].longest(s))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(lambda x, y: run(x, y), "int")(a, b)


# The kana rows in table order and their Latin consonants and vowels.
_ROWS = {"": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ"}
_KANA = {c: consonant + v for consonant, row in _ROWS.items() for c, v in zip(row, "aiueo")}
_KANA |= {"シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "zu", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "o", "ン": "n", "ヴ": "vu"}
_SMALL_Y = {"ャ": "a", "ュ": "u", "ョ": "o"}
_SMALL_V = {"ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o"}


def kana_to_latin(text: str) -> str:
    """Katakana in Latin letters.  A small y contracts with the syllable right before it, a small tsu doubles the first letter of the one right
    after it, small vowels are vowels; all else vanishes."""
    out: list[str] = []
    before = ""
    for c in text:
        syllable = _KANA.get(c) or _SMALL_V.get(c) or ""
        if syllable and before == "ッ":
            out.append(syllable[0])
        if syllable:
            out.append(syllable)
        elif c in _SMALL_Y and (before in _KANA or before in _SMALL_V):
            last = out.pop()
            stem = last[:-1] if last in ("shi", "chi", "ji") else last[:-1] + "y" if len(last) > 1 else last
            out.append(stem + _SMALL_Y[c])
        before = c
    return "".join(out)


def romaji(s: Column) -> Column:
    return _batched("string", lambda x: kana_to_latin(unicodedata.normalize("NFKC", x)), s)


def latin_only(s: Column) -> Column:
    """The Latin letters of a normal form, in lower case."""
    return F.regexp_replace(F.lower(nfkc(s)), "[^a-z]", "")


def match_core(core: Column, places: list[str], generic: list[str]) -> Column:
    """A core without place names, generic words and the trailing shop mark."""
    words = "|".join(re.escape(w) for w in sorted([*places, *generic], key=len, reverse=True))
    return F.regexp_replace(F.regexp_replace(core, words, "") if words else core, "店$", "")


def tier(dist: Column, score: Column, core_a: Column, core_b: Column, lcs: Column, latin_a: Column, latin_b: Column) -> Column:
    """Why two records match, by distance and name: a to e, or null.  latin_a: the Latin letters of core_a; latin_b: the other's kana in them."""
    short = F.when(F.length(core_a) <= F.length(core_b), core_a).otherwise(core_b)
    shorter = F.length(short)
    least = F.when(short.rlike("^[a-z0-9]+$"), 4).otherwise(3)
    near_part = ((shorter >= 2) & (core_a.contains(core_b) | core_b.contains(core_a))) | ((shorter > 0) & (lcs >= least) & (lcs * 2 >= shorter))
    near_latin = (F.length(latin_a) >= 4) & (latin_b != "") & (latin_a.contains(latin_b) | latin_b.contains(latin_a) | (_ratio(latin_a, latin_b) >= 0.8))
    return (
        F.when((dist <= 700) & (score == 1.0) & (F.length(core_a) >= 4), "a")
        .when((dist <= 200) & (score >= 0.9), "b")
        .when((dist <= 80) & (score >= 0.7), "c")
        .when((dist <= 30) & near_part, "d")
        .when((dist <= 30) & near_latin, "e")
    )


def lenient_number(s: Column) -> Column:
    """A number from loose text; marks, blanks and grouped digits are 0."""
    return F.coalesce(F.trim(s).try_cast("double"), F.lit(0.0))


def kanji_number(s: Column) -> Column:
    """0 to 99 in Chinese numerals, or plain digits; anything else is 0."""
    digits = F.translate(s, "〇一二三四五六七八九", "0123456789")
    tens, ones = F.substring_index(digits, "十", 1), F.substring_index(digits, "十", -1)
    value = F.when(tens == "", 1).otherwise(tens.try_cast("int")) * 10 + F.when(ones == "", 0).otherwise(ones.try_cast("int"))
    return F.coalesce(F.when(digits.contains("十"), value).otherwise(digits.try_cast("int")), F.lit(0))


def town_and_chome(s: Column) -> Column:
    """struct<town, chome>: a town name and the number before its chome mark (0 without one)."""
    pattern = r"^(.*?)([〇一二三四五六七八九十0-9]+)丁目$"
    town = F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1)).otherwise(s)
    return F.struct(town.alias("town"), kanji_number(F.regexp_extract(s, pattern, 2)).alias("chome"))


def round_half_even(x: Column, digits: int) -> Column:
    """Rounded as the exact binary value says, halves to even; Spark's round goes by the decimal form, halves away from zero.  A batch is rounded
    at once; only values too near a half for that, or too large, are rounded one by one."""

    def run(v: pd.Series) -> pd.Series:
        import numpy as np

        x = v.to_numpy(float, na_value=np.nan)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = x * 10.0**digits
            out = np.rint(scaled) / 10.0**digits
            odd = ~(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) > 1e-4) | ~(np.abs(scaled) < 1e11)
        for i in np.flatnonzero(odd & np.isfinite(x)):
            out[i] = round(float(x[i]), digits)
        out[np.isinf(x)] = x[np.isinf(x)]
        return pd.Series(out).astype(object).where(v.notna().to_numpy(), None)

    return F.pandas_udf(lambda v: run(v), "double")(x)


def tag_json(tags: Column, keep: list[str]) -> Column:
    """The kept keys of a tag map as JSON."""
    return F.to_json(F.map_filter(tags, lambda k, _: k.isin(*keep)))
