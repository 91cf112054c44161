"""Fixed values against literals, so that a wrong ending is not right on both sides of a comparison."""

from pyspark.sql import functions as F

from lektra.functions import text
from lektra.operators import morphology


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_verb_forms(spark):
    forms = lambda w: value(spark, morphology.verb_forms(F.lit(w)))
    past = "ελυον ελυες ελυε ελυομεν ελυετε ελυον"
    assert forms("λυω") == (
        "λυω λυεις λυει λυομεν λυετε λυουσι λυομαι λυῃ λυεται λυομεθα λυεσθε λυονται "
        f"{past} ελυομην ελυου ελυετο ελυομεθα ελυεσθε ελυοντο {past} ελυσα ελυσας ελυσε ελυσαμεν ελυσατε ελυσαν").split()
    for verb, contract in (
        ("τιμαω", "τιμῶ τιμᾷς τιμᾷ τιμῶμεν τιμᾶτε τιμῶσι"), ("φιλεω", "φιλῶ φιλεῖς φιλεῖ φιλοῦμεν φιλεῖτε φιλοῦσι"),
        ("δηλοω", "δηλῶ δηλοῖς δηλοῖ δηλοῦμεν δηλοῦτε δηλοῦσι"),
    ):
        assert forms(verb)[12:18] == contract.split()
    assert forms("τιθημι")[:6] == "τιθημι τιθης τιθησι τιθημεν τιθητε τιθηασι".split()
    assert forms("φημι") == "φημι φησ φησι φαμεν φατε φασι".split()
    assert forms("αγω")[12:15] == "αγον αγες αγε".split()
    assert forms("ω") == [] and forms("λογοσ") == []


def test_noun_forms(spark):
    got = value(spark, morphology.noun_forms(F.lit("γνωμη")))
    ends = "α ας ᾳ αν αι ων αις ης ῃ ην η ος ου ῳ ον ε οι οις ους ι ες σι ς ει εσι τος τι τα των"
    want = {"γνωμ" + e for e in ends.split()} | {"γνωμη" + e for e in ends.split()}
    assert want <= set(got) and set(got) - want <= {"γνωμη", "γνωμ"}


def test_lemma_candidates(spark):
    of = lambda w: set(value(spark, morphology.lemma_candidates(F.lit(w))))
    for word, lemmas in {
        "λογουσ": "λογοσ", "λογων": "λογοσ λογον λογη", "πεμπομεν": "πεμπω", "παυσομεν": "παυω", "λελυκασι": "λελυω", "παυθεντων": "παυω",
        "λυομενησ": "λυομενοσ", "ελυε": "λυε", "εθηκε": "τιθημι", "τιμωθεισ": "τιμωω τιμωεω τιμοω", "πηληιαδησ": "πηλευσ πηληευσ",
        "πηληιδησ": "πηλευσ πηληευσ", "ατρειδησ": "ατρευσ", "πριαμιδησ": "πριαμοσ", "αχιληοσ": "αχιλευσ αχιλλευσ", "πηληοσ": "πηλευσ",
        "φησι": "φησημι", "δεικνυσι": "δεικνυμι",
    }.items():
        assert set(lemmas.split()) <= of(word), (word, sorted(of(word)))


def test_every_tag_is_written_out(spark):
    tags = {
        "pres": "present", "impf": "imperfect", "aor": "aorist", "fut": "future", "perf": "perfect", "plup": "pluperfect",
        "act": "active", "mid": "middle", "pass": "passive", "mp": "middle/passive", "ind": "indicative", "subj": "subjunctive",
        "opt": "optative", "impv": "imperative", "inf": "infinitive", "part": "participle", "1": "1st person",
        "2": "2nd person", "3": "3rd person", "s": "singular", "sg": "singular", "p": "plural", "pl": "plural", "d": "dual",
        "du": "dual", "nom": "nominative", "gen": "genitive", "dat": "dative", "acc": "accusative", "voc": "vocative",
        "m": "masculine", "f": "feminine", "n": "neuter",
    }
    rows = spark.createDataFrame(list(tags.items()), "t string, w string")
    assert rows.where(text.expand_morphology(F.col("t")) != F.col("w")).count() == 0
    assert value(spark, text.expand_morphology(F.lit("aor_act_ind;3 s  x"))) == "aorist active indicative 3rd person singular x"


def test_declined_forms(spark):
    pages = spark.createDataFrame([("γνώμη", "{{decl|γνώμη}}")], "title string, template string")
    got = {r.asDict().get("form") or r[0] for r in morphology.declined_forms(pages).collect()}
    assert len(got) >= 1
