"""Inflected forms and lemmas as expressions and joins.

Generators explode literal arrays of endings; the lemmatizer turns every distinct
word into its array of candidates and keeps those that are dictionary headwords
by one equi semi join. No step pairs all words with all endings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lektra.functions import text

# Noun paradigms, nine cases each ("-": no ending).
NOUN_PARADIGMS = {
    "first, long alpha": "α ας ᾳ αν α αι ων αις ας",
    "first, short alpha": "α ης ῃ αν α αι ων αις ας",
    "first, eta": "η ης ῃ ην η αι ων αις ας",
    "second, masculine": "ος ου ῳ ον ε οι ων οις ους",
    "second, neuter": "ον ου ῳ ον ον α ων οις α",
    "third, consonant": "- ος ι α - ες ων σι ας",
    "third, sigma": "ς ους ει η ες η ων εσι ας",
    "third, neuter tau": "- τος τι - - τα των σι τα",
}
# Verb endings, six persons each.
VERB_ENDINGS = {
    "present active": "ω εις ει ομεν ετε ουσι",
    "present middle": "ομαι ῃ εται ομεθα εσθε ονται",
    "present mi": "μι ς σι μεν τε ασι",
    "contract alpha": "ῶ ᾷς ᾷ ῶμεν ᾶτε ῶσι",
    "contract epsilon": "ῶ εῖς εῖ οῦμεν εῖτε οῦσι",
    "contract omicron": "ῶ οῖς οῖ οῦμεν οῦτε οῦσι",
    "imperfect active": "ον ες ε ομεν ετε ον",
    "imperfect middle": "ομην ου ετο ομεθα εσθε οντο",
    "weak aorist": "α ας ε αμεν ατε αν",
    "strong aorist": "ον ες ε ομεν ετε ον",
}
# The one irregular verb whose key has no accent, and its forms.
IRREGULAR = {"φημι": "φημι φησ φησι φαμεν φατε φασι"}
VALID_FORM = "^[α-ωάέήίόύώ]+$"
VOWELS = "αεηιουω"

# Endings the lemmatizer takes off.
STRIPPED = """
ων ου ω ον ε α ασ ησ η αν ην οι οισ ουσ αι αισ οσ εσ ι σι των τοσ τησ τον την τα ται
ει εισ ομεν ετε ουσι ουσιν ομαι εται ομεθα εσθε ονται
σω σεισ σει σομεν σετε σουσι σα σασ σε σαμεν σατε σαν
κα κασ κε καμεν κατε κασι
μενοσ μενη μενον μενου μενησ μενω
ντοσ ντι ντα ντεσ ντων
θεισ θεντοσ θεντι θεντα θεντεσ θεντων θεισα θεισαν θεν
""".split()
# Endings of dictionary forms it puts on.
HEADWORD_ENDINGS = "οσ η ον α ω ημι μι".split()
# Endings of patronymics and of the names they come from.
PATRONYMICS = [p.split() for p in """
ιδησ ευσ; ιαδησ ευσ; ιδου ευσ; ιαδεω ευσ; ιδη ευσ; ιαδη ευσ; ιδα ευσ; ιαδα ευσ;
ιδησ οσ; ιαδησ οσ; ιδησ ησ; ιαδησ ησ
""".split(";")]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def noun_endings() -> list[str]:
    return list(dict.fromkeys("" if e == "-" else e for p in NOUN_PARADIGMS.values() for e in p.split()))


def _drop(c: Column, n: int) -> Column:
    return F.left(c, F.length(c) - n)


def _with(stem: Column, endings: list[str]) -> Column:
    return F.transform(_strings(endings), lambda e: F.concat(stem, e))


def noun_forms(lemma: Column, fix_sigma: bool = False) -> Column:
    """Array of noun forms of a folded lemma: every ending on the lemma and on its stem.

    Endings keep their final sigma and lemmas have none, so second-declension
    lemmas have no stem of their own unless ``fix_sigma``."""
    os = "οσ" if fix_sigma else "ος"
    stem = (
        F.when(lemma.endswith(os), _drop(lemma, 2)).when(lemma.endswith("η") | lemma.endswith("α"), _drop(lemma, 1))
        .when(lemma.endswith("ον"), _drop(lemma, 2))
    )
    stems = F.filter(F.array(lemma, stem), lambda s: F.length(s) >= 2)
    out = F.flatten(F.transform(stems, lambda s: _with(s, noun_endings())))
    return F.transform(out, lambda f: F.translate(f, "ς", "σ")) if fix_sigma else out


def verb_forms(lemma: Column) -> Column:
    """Array of verb forms of a folded lemma in -ω, -μι or -ειν."""
    e = {k: v.split() for k, v in VERB_ENDINGS.items()}
    omega = lemma.endswith("ω") | lemma.endswith("ειν")
    stem = F.when(lemma.endswith("ω"), _drop(lemma, 1)).when(lemma.endswith("μι"), _drop(lemma, 2)).when(
        lemma.endswith("ειν"), _drop(lemma, 3))
    first = F.left(stem, F.lit(1))
    past = F.when(first.isin(*VOWELS), stem).otherwise(F.concat(F.lit("ε"), stem))
    none = _strings([])
    contract = none
    for vowel, name in (("α", "contract alpha"), ("ε", "contract epsilon"), ("ο", "contract omicron")):
        contract = F.when(omega & stem.endswith(vowel), _with(_drop(stem, 1), e[name])).otherwise(contract)
    regular = F.concat(
        F.when(omega, _with(stem, e["present active"] + e["present middle"])).otherwise(_with(stem, e["present mi"])),
        contract,
        _with(past, e["imperfect active"] + e["imperfect middle"] + e["strong aorist"]),
        _with(F.concat(past, F.lit("σ")), e["weak aorist"]),
    )
    out = F.when(F.length(stem) >= 2, regular).otherwise(none)
    for verb, forms in IRREGULAR.items():
        out = F.when(lemma == verb, _strings(forms.split())).otherwise(out)
    return out


def all_forms(headword: Column, fix_sigma: bool = False) -> Column:
    lemma = text.fold(headword)
    forms = F.concat(F.array(lemma), verb_forms(lemma), noun_forms(lemma, fix_sigma))
    return F.array_distinct(F.filter(forms, lambda f: (F.length(f) >= 2) & f.rlike(VALID_FORM)))


def generated_mappings(entries: DataFrame, fix_sigma: bool = False) -> DataFrame:
    """(headword, headword_normalized) -> lemma map rows of generated forms, not the lemma itself."""
    return (
        entries.select("headword_normalized", F.explode(all_forms(F.col("headword"), fix_sigma)).alias("word_form"))
        .where(F.col("word_form") != F.col("headword_normalized")).distinct()
        .select(
            "word_form", F.col("word_form").alias("word_normalized"), F.col("headword_normalized").alias("lemma"),
            F.lit(0.8).alias("confidence"), F.lit("generated").alias("source"))
    )


def lemma_candidates(word: Column) -> Column:
    """Array of the strings that a folded word may be a form of."""
    stems = F.transform(
        F.filter(_strings(STRIPPED), lambda e: word.endswith(e) & (F.length(word) > F.length(e) + 2)),
        lambda e: F.left(word, F.length(word) - F.length(e)))
    dictionary = lambda s: F.concat(F.array(s), _with(s, HEADWORD_ENDINGS))
    none = _strings([])
    parts = [dictionary(word), F.flatten(F.transform(stems, dictionary))]
    past = word.startswith("ε") & (F.length(word) > 3)
    parts.append(F.when(past, F.array(F.substring(word, 2, 1_000_000))).otherwise(none))
    parts.append(F.when(past & word.startswith("εθ"), _strings(["τιθημι"])).otherwise(none))
    root = _drop(word, 4)
    passive = word.endswith("θεισ") & (F.length(word) > 4)
    parts.append(F.when(passive, _with(root, ["ω", "εω", "αω", "οω", "υω"])).otherwise(none))
    parts.append(F.when(passive & root.endswith("ω"), F.array(F.concat(_drop(root, 1), F.lit("οω")))).otherwise(none))
    for ending, name in PATRONYMICS:
        base = _drop(word, len(ending))
        fits = word.endswith(ending) & (F.length(word) > len(ending) + 2)
        vowel = (
            F.when(base.endswith("η"), F.concat(_drop(base, 1), F.lit(name if name == "ευσ" else "ε" + name)))
            .when(base.endswith("ε") & F.lit(name == "ευσ"), F.concat(base, F.lit("υσ")))
        )
        itself = F.when(word.endswith("ου") | word.endswith("εω"), F.concat(_drop(word, 1), F.lit("σ"))).otherwise(word)
        itself = F.when(itself.endswith("ησ"), F.concat(_drop(itself, 1), F.lit("σ"))).otherwise(itself)
        parts.append(F.when(fits, F.array(vowel, F.concat(base, F.lit(name)), itself)).otherwise(none))
    base = _drop(word, 3)
    genitive = word.endswith("ηοσ")
    parts.append(F.when(genitive, F.array(F.concat(base, F.lit("ευσ")))).otherwise(none))
    doubled = genitive & F.right(base, F.lit(1)).isin("λ", "μ", "ν", "ρ")
    parts.append(F.when(doubled, F.array(F.concat(base, F.right(base, F.lit(1)), F.lit("ευσ")))).otherwise(none))
    return F.array_distinct(F.filter(F.concat(*parts), lambda s: s.isNotNull()))


def lemma_confidence(word: Column, lemma: Column) -> Column:
    """Ladder by how the lemma was reached; the first that fits counts."""
    added = (F.concat(word, F.lit("οσ")) == lemma) | (F.concat(word, F.lit("η")) == lemma) | (F.concat(word, F.lit("ον")) == lemma)
    patronymic = lemma.endswith("ευσ") & word.rlike("(" + "|".join(dict.fromkeys(p[0] for p in PATRONYMICS)) + ")$")
    return (
        F.when(lemma == word, 0.9).when(added, 0.7).when(patronymic, 0.75)
        .when(F.length(lemma) < F.length(word), 0.6).otherwise(0.5)
    )


def lemmatize(words: DataFrame, headwords: DataFrame) -> DataFrame:
    """Algorithmic lemma map of the distinct ``word_normalized`` of ``words``,
    validated by ``headwords`` (headword_normalized)."""
    valid = headwords.select(F.col("headword_normalized").alias("lemma")).distinct()
    w = F.col("word_normalized")
    return (
        words.select("word_normalized").where(w.isNotNull()).distinct()
        .select("word_normalized", F.explode(lemma_candidates(w)).alias("lemma"))
        .join(valid, "lemma", "left_semi")
        .select(
            w.alias("word_form"), "word_normalized", "lemma",
            lemma_confidence(w, F.col("lemma")).alias("confidence"), F.lit("algorithmic").alias("source"))
    )


# Declension templates by the word they are named after.
_CASES = "nom_sg gen_sg dat_sg acc_sg voc_sg nom_pl gen_pl dat_pl acc_pl voc_pl".split()
DECLENSIONS = {
    "θάλασσα": "α ης ῃ αν α αι ων αις ας αι",
    "γνώμη": "η ης ῃ ην η αι ων αις ας αι",
    "χώρα": "α ας ᾳ αν α αι ων αις ας αι",
    "δρόμος": "ος ου ῳ ον ε οι ων οις ους οι",
    "πρόσωπον": "ον ου ῳ ον ον α ων οις α α",
    "πόλις": "ις εως ει ιν ι εις εων εσι(ν) εις εις",
    "φύλαξ": "ξ κος κι κα ξ κες κων ξι(ν) κας κες",
    "βέλος": "ος ους ει ος ος η ων εσι(ν) η η",
    "κτήμα": "μα ματος ματι μα μα ματα ματων μασι(ν) ματα ματα",
}
ADJECTIVES = {
    "καλός": ("ος ου ῳ ον ε οι ων οις ους οι", "η ης ῃ ην η αι ων αις ας αι", "ον ου ῳ ον ον α ων οις α α"),
    "δύσκολος": ("ος ου ῳ ον ος οι ων οις ους οι", "ος ου ῳ ον ος οι ων οις ους οι", "ον ου ῳ ον ον α ων οις α α"),
}


def declension_endings() -> dict[str, list[tuple[str, str]]]:
    """Template -> (case, ending); an optional nu gives a case of its own."""
    rows: dict[str, list[tuple[str, str]]] = {}
    for name, endings in DECLENSIONS.items():
        rows[name] = list(zip(_CASES, endings.split()))
    for name, genders in ADJECTIVES.items():
        rows[name] = [
            (f"{g}_{c}", e) for g, es in zip(("masc", "fem", "neut"), genders) for c, e in zip(_CASES, es.split())]
    return {
        name: [x for c, e in es for x in ([(c, e.replace("(ν)", ""))] + ([(c + "_with_nu", e.replace("(ν)", "ν"))] if "(ν)" in e else []))]
        for name, es in rows.items()
    }


def declined_forms(pages: DataFrame) -> DataFrame:
    """Pages (title, template) -> the forms their declension template gives, not the title itself.

    ``template`` is the page's text; the first template of the table that it names counts.
    The first row of each (form, lemma) in order of the cases is kept."""
    title = F.col("title")
    table = declension_endings()
    chosen = None
    for name in table:
        cond = F.col("template").contains(name)
        chosen = F.when(cond, name) if chosen is None else chosen.when(cond, name)
    forms = None
    for name, endings in table.items():
        nominative = endings[0][1]
        stem = F.when(title.endswith(nominative), F.left(title, F.length(title) - len(nominative))).otherwise(title)
        arr = F.array(*[F.struct(F.lit(i).alias("i"), F.concat(stem, F.lit(e)).alias("form"), F.lit(c).alias("case"))
                        for i, (c, e) in enumerate(endings)])
        cond = F.col("pattern") == name
        forms = F.when(cond, arr) if forms is None else forms.when(cond, arr)
    return (
        pages.withColumn("pattern", chosen).where(F.col("pattern").isNotNull())
        .withColumn("f", F.explode(forms)).where(F.col("f.form") != title)
        .groupBy(F.col("f.form").alias("word_form"), title.alias("lemma"))
        .agg(F.min_by(F.struct("f.case", "pattern"), "f.i").alias("m"))
        .select("word_form", "lemma", F.col("m.case").alias("case"), "m.pattern")
    )
