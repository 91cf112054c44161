"""One consistent form for text that looks the same.

A value's *mapped form* drops invisible characters, turns every space into the
ordinary one, replaces compatibility forms and, word by word, letters borrowed
from another script by the letter of the word's own script, and composes the
result. Values with equal mapped forms under an accent-sensitive Unicode
collation are one class; its canonical member is the shortest, of these the
smallest, mapped form, and it is joined back to every value of the class.

Shapes come from two sources: a short list of letters of the three scripts of
these texts (which also decides between several look-alikes), and Unicode's table
of confusable characters, which the collation library that Spark brings along
holds, for all other letters of the Basic Multilingual Plane.

Most text is *clean*: composed Latin and Greek letters, digits and marks that are
their own form and that no other character equals under the collation, without a
word of both scripts. Such a value is its own canonical form, whatever else is in
the table; a regular expression tells it without Python and without a shuffle.

Defined cases: null stays null; the empty text is its own form; words of
different scripts side by side keep their scripts (only mixed words, and whole
words of Cyrillic look-alikes amid another script, change); repeated values
share one class; the length of a text does not matter.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lektra.runtime import cut

# Letters that look alike, one line a shape: Latin, Greek, Cyrillic ("-": none).
LOOKALIKES = """
A Α А
B Β В
C - С
E Ε Е
H Η Н
I Ι І
J Ϳ Ј
K Κ К
M Μ М
N Ν -
O Ο О
P Ρ Р
S - Ѕ
T Τ Т
X Χ Х
Y Υ У
Z Ζ -
a α а
c - с
e ε е
h - һ
i ι і
j ϳ ј
k κ к
m μ м
n η п
o ο о
p ρ р
s ς ѕ
t τ т
u υ ц
v ν ѵ
w ω ѡ
x χ х
y γ у
"""
# Letters with one look-alike only: they stand in for it wherever a word has that script.
LONE = {"ɣ": ("y", "γ", "у"), "ı": ("i", "ι", "і"), "ɑ": ("a", "α", "а"), "ɩ": ("i", "ι", "і"), "г": ("r", "-", "г")}

_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC")


def _tables() -> list[dict[str, str]]:
    """Per target script: letter of another script -> letter of this one."""
    out: list[dict[str, str]] = [{}, {}, {}]
    shapes = [tuple(line.split()) for line in LOOKALIKES.strip().splitlines()]
    for shape in shapes:
        for to, letter in enumerate(shape):
            for frm, other in enumerate(shape):
                if frm != to and letter != "-" and other != "-":
                    out[to].setdefault(other, letter)
    for odd, shape in LONE.items():
        for to, letter in enumerate(shape):
            if letter not in ("-", odd):
                out[to][odd] = letter
    return out


_TO = _tables()
_KNOWN = set().union(*(t.keys() for t in _TO))
_ALWAYS = {"ɣ", "ı", "ɑ", "ɩ"}
_WORD = re.compile("(?:[^\\W\\d_][̀-ͯ]*)+")
# spacing accents and elision marks: their compatibility form is a space with an accent, not what they look like
_KEEP = "¨¯´¸˘˙˚˛˜˝ͺ΄΅᾽᾿῀῁῍῎῏῝῞῟῭΅`´῾‗‾"
_INVISIBLE_MN = "͏ᅟᅠ឴឵ㅤﾠ"


def _script(ch: str) -> int:
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c < 0x1F00 or 0x250 <= c < 0x2B0:
        return 0
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return 1
    if 0x400 <= c < 0x530:
        return 2
    return 3


def _char(ch: str) -> str:
    cat = U.category(ch)
    if cat == "Cf" or ch in _INVISIBLE_MN or 0xFE00 <= ord(ch) <= 0xFE0F or 0x180B <= ord(ch) <= 0x180F:
        return ""
    if cat[0] == "Z" or ch in "\t\v\f\x85":
        return " "
    if ch in _KEEP:
        return ch
    return U.normalize("NFKC", ch) if U.decomposition(ch).startswith("<") else ch


class _Chars(dict):
    """Filled as characters are met."""

    def __missing__(self, key: int) -> str:
        self[key] = value = _char(chr(key))
        return value


_CHARS = _Chars()


def _word_scripts(word: str) -> tuple[list[int], list[int]]:
    """Per script: its letters, and those of them that look like nothing else."""
    n, sure = [0, 0, 0, 0], [0, 0, 0, 0]
    for ch in word:
        if ch >= "̀" and U.category(ch) == "Mn":
            continue
        s = _script(ch)
        n[s] += ch not in _ALWAYS
        sure[s] += ch not in _KNOWN
    return n, sure


def mapped_form(text: str | None, shapes: list[dict[str, str]] | None = None) -> str | None:
    """The form of a text; a form is its own form. ``shapes``: per script, letters of further
    scripts with the letter that looks like them."""
    if text is None or (text.isascii() and text.isprintable()) or (_OWN.fullmatch(text) and not _BOTH.search(text)):
        return text
    seen = set()
    while text not in seen:
        seen.add(text)
        text = _pass(text, shapes)
    return text


def _pass(text: str, shapes: list[dict[str, str]] | None) -> str:
    t = U.normalize("NFD", text.translate(_CHARS))
    record: list[int] | None = None
    out, last = [], 0
    for m in _WORD.finditer(t):
        w = m.group()
        if w.isascii():
            continue
        n, sure = _word_scripts(w)
        present = sum(1 for s in range(3) if n[s])
        odd = any(ch in _ALWAYS for ch in w)
        strange = shapes is not None and n[3] and present
        if present < 2 and not odd and not strange and not (n[2] and not sure[2]):
            continue
        if record is None:
            record, certain = [0, 0, 0, 0], [0, 0, 0, 0]
            for x in _WORD.findall(t):
                a, b = _word_scripts(x)
                record = [p + q for p, q in zip(record, a)]
                certain = [p + q for p, q in zip(certain, b)]
        if present < 2 and n[2] and not odd and not strange:
            # a whole word of Cyrillic look-alikes: its own unless nothing else here is surely Cyrillic
            if certain[2] or not (record[0] or record[1]):
                continue
            to = max((0, 1), key=lambda s: record[s])
        else:
            to = max(range(3), key=lambda s: (sure[s] > 0 and n[s], sure[s], n[s], record[s]))
        table, more = _TO[to], shapes[to] if shapes else {}
        changed = "".join(table.get(ch) or more.get(ch, ch) for ch in w)
        if changed != w:
            out.append(t[last:m.start()])
            out.append(changed)
            last = m.end()
    if out:
        t = "".join([*out, t[last:]])
    return U.normalize("NFC", t)


def _own_form() -> list[str]:
    """Characters without marks that stay as they are in words of one script, Latin or Greek."""
    spans = ((0x20, 0x250), (0x370, 0x400), (0x1F00, 0x2000), (0x2010, 0x2028), (0x2030, 0x205F))
    chars = [chr(c) for a, b in spans for c in range(a, b)]
    return [
        c for c in chars
        if U.category(c)[0] in "LNPS" and _char(c) == c and U.normalize("NFC", c) == c and c not in _ALWAYS and _pass(c, None) == c]


_OWN = re.compile(f"[ {re.escape(''.join(_own_form()))}]*")
_BOTH = re.compile("[{0}][{1}]|[{1}][{0}]".format(
    *("".join(c for c in _own_form() if U.category(c)[0] == "L" and _script(c) == s) for s in (0, 1))))


def _letters(first: int, last: int) -> list[str]:
    return [chr(c) for c in range(first, last) if U.category(chr(c))[0] == "L" and not U.decomposition(chr(c))]


@lru_cache(maxsize=1)
def _skeletons() -> dict[str, str]:
    """Letters of the Basic Multilingual Plane (but for Han and Hangul) -> what Unicode says they look like."""
    jvm = SparkSession.active()._jvm
    chars = [c for a, b in ((0x21, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0xFFFE)) for c in _letters(a, b)]
    looks = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(chars)).split("\n")
    return dict(zip(chars, looks))


def unicode_shapes() -> list[dict[str, str]]:
    """Per script of the three: letters of other scripts with the letter of this script that looks alike. Between
    the common letters of the three the list above decides."""
    looks = _skeletons()
    own = [_letters(0x41, 0x7B), _letters(0x391, 0x3CA), _letters(0x410, 0x450)]
    common = set().union(*own)
    out = []
    for to, letters in enumerate(own):
        by_look: dict[str, str] = {}
        for c in letters:
            by_look.setdefault(looks[c], c)
        out.append({c: by_look[x] for c, x in looks.items() if _script(c) != to and c not in common and x in by_look})
    return out


@lru_cache(maxsize=1)
def _clean_kinds() -> dict[str, str]:
    """Characters that are their own form and whose collation keys are neither empty nor shared -> l, g (letters
    of the two scripts) or a space."""
    jvm = SparkSession.active()._jvm
    collator = jvm.com.ibm.icu.text.Collator.getInstance(jvm.com.ibm.icu.util.ULocale.ROOT)
    keys: dict[str, list[str]] = {}
    for c in _own_form():
        keys.setdefault(bytes(collator.getCollationKey(c).toByteArray()).hex(), []).append(c)
    empty = bytes(collator.getCollationKey("").toByteArray()).hex()
    good = [x[0] for k, x in keys.items() if len(x) == 1 and k != empty]
    return {" ": " "} | {c: "lg"[_script(c)] if U.category(c)[0] == "L" and _script(c) < 2 else " " for c in good}


def is_clean(value: Column) -> Column:
    """Characters become kinds, in which two simple patterns are looked for: another character, or both scripts in a word."""
    kinds = _clean_kinds()
    return ~F.translate(value, "".join(kinds), "".join(kinds.values())).rlike("[^lg ]|lg|gl")


def mapper() -> Callable[[Column], Column]:
    shapes = unicode_shapes()

    @F.pandas_udf(T.StringType())
    def mapped(values: pd.Series) -> pd.Series:
        return values.map(lambda x: mapped_form(x, shapes), na_action="ignore")

    return mapped


def canonical(df: DataFrame, field: str) -> DataFrame:
    """One row per distinct non-null value of ``field``: ``value``, ``canonical``."""
    values = df.select(F.col(f"`{field}`").alias("value")).where("value IS NOT NULL").distinct()
    clean = is_clean(F.col("value"))
    return values.where(clean).select("value", F.col("value").alias("canonical")).unionByName(
        _classes(values.where(~clean), values))


def _classes(odd: DataFrame, values: DataFrame) -> DataFrame:
    """Distinct values that are not clean with the canonical member of their class. A clean value can be a
    member too: it is one of the forms, or one of them without what the collation ignores."""
    forms = cut(odd.select("value", mapper()("value").alias("form")))
    bare = F.regexp_replace("form", "[\\p{Cntrl}\\p{Cf}]", "")
    bare = forms.select(bare.alias("value")).where(bare != F.col("form")).distinct()
    # joined before it is asked which are clean: hardly any are left then
    near = cut(values.join(bare, "value", "left_semi"))
    return values.sparkSession.sql(
        """
        WITH members AS (SELECT form FROM {forms} UNION SELECT value FROM {near}),
        best AS (SELECT form COLLATE UNICODE AS class, min(struct(length(form) AS n, form)).form AS canonical
                 FROM members GROUP BY form COLLATE UNICODE)
        SELECT value, canonical FROM {forms} JOIN best ON form COLLATE UNICODE = class
        """,
        forms=forms, near=near.where(is_clean(F.col("value"))))


def odd_rows(df: DataFrame, field: str, out: str = "canonical") -> DataFrame:
    """The rows whose value is not clean, with the canonical member; all others are their own."""
    df = df.drop(out)
    value = F.col(f"`{field}`")
    odd = cut(df.where(~is_clean(value)))
    classes = _classes(odd.select(value.alias("value")).distinct(), df.select(value.alias("value"))).select(
        F.col("value").alias("__lk_value"), F.col("canonical").alias(out))
    return odd.join(classes, odd[field] == classes["__lk_value"]).drop("__lk_value")


def with_canonical(df: DataFrame, field: str, out: str = "canonical") -> DataFrame:
    """Join the canonical member back to every row (null values keep null). A column of
    that name is replaced. Rows with clean values take no part in a shuffle."""
    value = F.col(f"`{field}`")
    clean = df.drop(out).where(F.coalesce(is_clean(value), F.lit(True))).withColumn(out, value)
    return clean.unionByName(odd_rows(df, field, out))
