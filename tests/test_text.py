"""Tokenizing and stemming."""

import os
import random

import porter_model
import pytest
from pyspark.sql import functions as F

from lexspark.functions.porter import stem_each, stem_words
from lexspark.functions.text import STOPWORDS, normalize, tokenize_nostem, tokenize_raw

# The 81 published pairs, by step, and some of our own after them.
STEMS = """caresses=caress ponies=poni ties=ti cats=cat caress=caress dogs=dog
agreed=agre feed=feed plastered=plaster bled=bled motoring=motor sing=sing conflated=conflat troubled=troubl sized=size hopping=hop tanning=tan falling=fall hissing=hiss fizzing=fizz filing=file
happy=happi sky=sky
relational=relat conditional=condit rational=ration valenci=valenc hesitanci=hesit digitizer=digit conformabli=conform radicalli=radic differentli=differ vileli=vile analogousli=analog vietnamization=vietnam predication=predic operator=oper feudalism=feudal decisiveness=decis hopefulness=hope callousness=callous formaliti=formal sensitiviti=sensit sensibiliti=sensibl
triplicate=triplic formative=form formalize=formal electriciti=electr electrical=electr hopeful=hope goodness=good
revival=reviv allowance=allow inference=infer airliner=airlin gyroscopic=gyroscop adjustable=adjust defensible=defens irritant=irrit replacement=replac adjustment=adjust dependent=depend adoption=adopt homologou=homolog communism=commun activate=activ angulariti=angular homologous=homolog effective=effect bowdlerize=bowdler
probate=probat rate=rate cease=ceas controll=control roll=roll
= a=a go=go the=the running=run generalization=gener"""
OWN = "troubling=troubl failing=fail radically=radic vileness=vile is=is by=by todai=todai oats=oat 2019=2019 yyy=yyi sayings=sai yoyo=yoyo toying=toi employed=emploi"


def stems(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    one = {r.word: r.stem for r in stem_words(rows, "word").collect()}
    each = rows.select("word", stem_each(F.array("word"))[0].alias("stem")).collect()
    assert one == {r.word: r.stem for r in each}
    return one


def test_stems(spark):
    pairs = dict(p.split("=") for p in (STEMS + " " + OWN).split(" ") for p in p.split("\n"))
    assert len(STEMS.split()) == 81
    got = stems(spark, pairs)
    assert {w: s for w, s in got.items() if s != pairs[w]} == {}
    assert {w: porter_model.stem(w) for w in pairs} == pairs


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_stems_of_a_corpus_equal_the_model(spark):
    """Every different word of the test texts, and made-up ones, by the expressions and letter by letter."""
    words = {r[0] for r in spark.read.parquet("/root/testdata/sf0.01/corpus.parquet").select(F.explode(tokenize_raw("content"))).distinct().collect()}
    rnd = random.Random(4)
    words |= {"".join(rnd.choice("aeiouybcdlmstz") for _ in range(rnd.randint(1, 7))) + rnd.choice(porter_model.ENDS_4 + porter_model.PAIRS_2 + ["ed", "ing", "s", "eed", "y", "ll", "ion", "e", ""]) for _ in range(6000)}
    got = stems(spark, sorted(words))
    assert {w: (s, porter_model.stem(w)) for w, s in got.items() if s != porter_model.stem(w)} == {}


def test_stem_of_null(spark):
    assert stem_words(spark.createDataFrame([(None,)], "word string"), "word").first().stem is None


@pytest.mark.parametrize(
    "text,raw,kept",
    [
        ("Don't you think it's working?", "don t you think it s working", "think working"),
        ("HTTP 404: v2.0!", "http 404 v2 0", "http 404 v2 0"),
        ("café résumé_naïve", "café résumé naïve", "café résumé naïve"),
        ("", "", ""),
        ("  \t\n", "", ""),
        ("the is a of", "the is a of", ""),
        ("ΟΔΟΣ x²", "οδοσ x", "οδοσ x"),
        ("İx", "ix", "ix"),
    ],
)
def test_tokens(spark, text, raw, kept):
    row = spark.createDataFrame([(text,)], "t string").select(F.array_join(tokenize_raw("t"), " "), F.array_join(tokenize_nostem("t"), " ")).first()
    assert tuple(row) == (raw, kept)


def test_null_text(spark):
    row = spark.createDataFrame([(None,)], "t string").select(tokenize_raw("t"), normalize("t")).first()
    assert row[0] is None and row[1] is None


def test_stopwords():
    assert len(STOPWORDS) == 158 and {"the", "don", "ve"} <= STOPWORDS
