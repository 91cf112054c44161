"""Text functions as Column -> Column expressions; all stay in generated JVM code."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

GREEK = "\\u0370-\\u03FF\\u1F00-\\u1FFF"


@cache
def _base_letters() -> tuple[str, str]:
    """Every composed letter below U+0250 and of the Greek blocks with its base letter."""
    frm, to = [], []
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1F00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and unicodedata.combining(d[1]) or len(d) == 1 and d != chr(cp):
            frm.append(chr(cp))
            to.append(d[0])
    return "".join(frm), "".join(to)


def strip_marks(c: Column) -> Column:
    """Canonical decomposition without its combining marks."""
    return F.translate(F.regexp_replace(c, "\\p{M}", ""), *_base_letters())


def fold(c: Column) -> Column:
    """Marks off, lower case, one sigma; punctuation stays."""
    return F.translate(F.lower(strip_marks(c)), "ς", "σ")


def normalize_greek(c: Column) -> Column:
    """``fold``, then Greek letters only (other text becomes the empty string)."""
    return F.regexp_replace(fold(c), f"[^\\p{{L}}&&[{GREEK}]]", "")


def normalize_web(c: Column) -> Column:
    """Marks off and lower case; final sigma and punctuation stay."""
    return F.lower(strip_marks(c))


def normalize_highlight(c: Column) -> Column:
    """Sentence punctuation off, then ``normalize_greek``."""
    return normalize_greek(F.regexp_replace(c, "[,;.·:!?]", ""))


def normalize_search_line(c: Column, greek: bool = True) -> Column:
    """A line for searching: folded, everything but letters to one space."""
    if not greek:
        return F.trim(F.regexp_replace(F.lower(c), "(?U)\\s+", " "))
    return F.trim(F.regexp_replace(fold(c), "[^\\p{L}]+", " "))


def latin_key(c: Column) -> Column:
    return F.lower(c)


def latin_lookup(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[.,;:!?·]", ""))


def language_of(book_id: Column) -> Column:
    """Language by the prefix of an author, work or book id."""
    return F.when(book_id.startswith("tlg"), "greek").when(book_id.startswith("phi"), "latin")


def normalize_word(word: Column, language: Column) -> Column:
    return F.when(language == "greek", normalize_greek(word)).otherwise(latin_key(word))


# --- tokens

def tokens(c: Column) -> Column:
    """Maximal runs without Unicode white space."""
    return F.filter(F.split(c, "(?U)\\s+"), lambda x: x != "")


def click_words(c: Column) -> Column:
    """Runs of letters; an apostrophe only between letters."""
    return F.regexp_extract_all(c, F.lit("\\p{L}+(?:'\\p{L}+)*"), F.lit(0))


def web_words(c: Column) -> Column:
    """Words between punctuation and white space, elision marks at their end off."""
    parts = F.regexp_extract_all(c, F.lit("[^\\s\\u2018\\u2019\\u201C\\u201D.,;:!?\\-\\[\\]()]+"), F.lit(0))
    return F.filter(
        F.transform(parts, lambda x: F.regexp_replace(x, "[\\u02BC']+$", "")), lambda x: x != "")


def dictionary_tokens(c: Column) -> Column:
    """Greek runs (to be linked), Latin runs of two letters and more, else single characters."""
    return F.regexp_extract_all(c, F.lit(f"(?s)[{GREEK}]+|[a-zA-Z]{{2,}}|."), F.lit(0))


def highlight(c: Column, positions: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """Mark the words at the given positions (from 1)."""
    return F.array_join(
        F.transform(F.split(c, "\\s+"), lambda x, i: F.when(
            F.array_contains(positions, i + 1), F.concat(F.lit(before), x, F.lit(after))).otherwise(x)), " ")


def sentences(c: Column, greek: Column) -> Column:
    """Plain prose split at closing marks followed by white space; the mark goes."""
    return F.when(greek, F.split(c, "[.!?·;]\\s+")).otherwise(F.split(c, "[.!?]\\s+"))


def is_editorial_noise(c: Column, least: int = 10, same: bool = True) -> Column:
    """Sentences that are apparatus, not text (``same``: also those that begin with "id.")."""
    out = (
        (F.length(c) <= least) | c.rlike("^[A-Z]:") | c.startswith("em.") | c.startswith("add.")
        | c.contains("Nauck") | c.contains("Mullach")
    )
    return out | c.startswith("id.") if same else out


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


# --- markup

def html_to_text(c: Column) -> Column:
    """Line breaks and paragraphs to newlines, tags off, six entities in this order."""
    for tag in ("<br>", "<br/>", "<BR>", "<BR/>"):
        c = F.replace(c, F.lit(tag), F.lit("\n"))
    for tag in ("</p>", "</P>"):
        c = F.replace(c, F.lit(tag), F.lit("\n\n"))
    c = F.regexp_replace(c, "<[^>]*>", "")
    # Entities.
    for entity, text in (
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ):
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def wiki_section(c: Column, heading: str) -> Column:
    """A second-level section with its heading, up to the next one."""
    return F.regexp_extract(c, f"(?s)=={heading}==.*?(?=\\n==[^=]|\\z)", 0)


def wiki_plain(c: Column) -> Column:
    """Wiki markup to plain text: links, emphasis, templates, brackets."""
    c = F.regexp_replace(c, "\\[\\[([^\\]|]+\\|)?([^\\]]+)\\]\\]", "$2")
    c = F.regexp_replace(c, "'''([^']+)'''", "$1")
    c = F.regexp_replace(c, "''([^']+)''", "$1")
    c = F.regexp_replace(c, "\\{\\{[^}]+\\}\\}", "")
    return F.trim(F.regexp_replace(c, "\\([^)]*\\)", ""))


# Templates "<name> of|grc|LEMMA".
FORM_TEMPLATES = """
plural, genitive, dative, accusative, vocative, nominative plural, genitive plural,
aorist, present, imperfect, future, perfect,
epic form, ionic form, doric form, aeolic form,
alternative form, alternative spelling, obsolete form, archaic form,
present participle, past participle, participle
""".replace("\n", " ").strip().split(", ")
FORM_TEMPLATES = [t.strip() for t in FORM_TEMPLATES]


def template_lemmas(c: Column) -> Column:
    """Lemmas named by form templates, in the order of the patterns."""
    patterns = [
        "\\{\\{inflection of\\|grc\\|([^|{}]+)\\|",
        "\\{\\{form of\\|[^|]+\\|grc\\|([^|{}]+)\\}\\}",
        "\\{\\{grc-form of\\|([^|{}]+)[|}]",
        *(f"\\{{\\{{{t} of\\|grc\\|([^|{{}}]+)\\}}\\}}" for t in FORM_TEMPLATES),
    ]
    return F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns]))


def template_morphology(c: Column) -> Column:
    """Class of a form by the first of these that the text names."""
    out = None
    # Fixed values, in order: a later entry never shows where an earlier one fits.
    for mark, name in (
        ("plural of", "plural"), ("genitive of", "genitive"), ("dative of", "dative"), ("accusative of", "accusative"),
        ("aorist of", "aorist"), ("perfect of", "perfect"), ("participle", "participle"),
    ):
        out = F.when(c.contains(mark), name) if out is None else out.when(c.contains(mark), name)
    tags = F.regexp_extract(c, "\\{\\{inflection of\\|grc\\|[^|]+\\|([^}]+)\\}\\}", 1)
    return out.when(tags != "", F.trim(F.replace(tags, F.lit("|"), F.lit(" "))))


# Morphology tags and their names.
MORPH_TAGS = {
    "pres": "present", "impf": "imperfect", "aor": "aorist", "fut": "future", "perf": "perfect", "plup": "pluperfect",
    "act": "active", "mid": "middle", "pass": "passive", "mp": "middle/passive",
    "ind": "indicative", "subj": "subjunctive", "opt": "optative", "impv": "imperative", "impr": "imperative",
    "inf": "infinitive", "part": "participle",
    "1": "1st person", "2": "2nd person", "3": "3rd person",
    "s": "singular", "sg": "singular", "p": "plural", "pl": "plural", "d": "dual", "du": "dual",
    "nom": "nominative", "gen": "genitive", "dat": "dative", "acc": "accusative", "voc": "vocative",
    "m": "masculine", "masc": "masculine", "f": "feminine", "fem": "feminine", "n": "neuter", "neut": "neuter",
    "with_nu": "(with nu-movable)",
}


def expand_morphology(c: Column) -> Column:
    """Tags split at ``_``, space and ``;``, known ones written out, blanks dropped."""
    names = F.create_map(*[F.lit(x) for kv in MORPH_TAGS.items() for x in kv])
    parts = F.filter(F.split(c, "[_ ;]"), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(names, F.trim(x)), x)), " ")


def display_title(title: Column, title_english: Column) -> Column:
    bad = title_english.isNull() | (F.trim(title_english) == "") | title_english.startswith("tlg") | title_english.startswith("phi")
    return F.when(bad, title).otherwise(title_english)


def beta_key(c: Column) -> Column:
    """Dictionary keys written with ASCII marks."""
    # Mark and what it becomes.
    for mark, sign in ((")", "῾"), ("(", "᾿"), ("/", "\u0301"), ("\\", "\u0300"), ("=", "\u0342"), ("|", "ι")):
        c = F.replace(c, F.lit(mark), F.lit(sign))
    return c
