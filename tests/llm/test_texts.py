"""Encoding, leakage and reading levels."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import bpe, leakage, readability

needs_ranks = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_RANKS), reason="no tokenizer files")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(bpe.DEFAULT_RANKS), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@needs_ranks
@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60))
def test_encoding_equals_library(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library(text)
    assert b"".join(encoder.table.keys[i] for i in ids).decode() == text


@needs_ranks
def test_encode_table(spark, library):
    texts = ["", None, "<|endoftext|> x", "a" * 30_000, "  \r\n\t é ½", "plain words", "plain words"]
    rows = spark.createDataFrame([(i, t, "z", [1]) for i, t in enumerate(texts)] + [(None, "id is null", "", [])], "doc_id bigint, text string, ids string, tokens array<int>")
    got = bpe.encode_texts(rows).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: r.ids for r in got if r.doc_id is not None} == {i: library(t) if t else [] for i, t in enumerate(texts)}
    assert bpe.encode_texts(rows.limit(0)).count() == 0


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots) == list(range(5000)) and all(table.find(k) == i for i, k in enumerate(keys)) and table.find(b"none") == -1
    assert bpe.PerfectHash([]).find(b"x") == -1


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = leakage.words_of(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words_of(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_leakage(spark, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(8)] + [(100, None), (101, "w0 w1")]
    docs = [(i, " ".join(rnd.choices([*words, "other", "W3,", "w2_w1"], k=rnd.randint(0, 120)))) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "x " * 50_000 + items[0][1] + " y" * 10), (93, items[1][1]), (93, items[1][1])]
    frame = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id bigint, text string, words int, item_id string").repartition(3)
    held = spark.createDataFrame(items, "item_id bigint, text string")
    for bound in (leakage.MAX_ITEM_WORDS, 40):
        got = leakage.leaked_passages(frame, held, 5, max_item_words=bound).collect()
        assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, 5)
    for r in got:
        d, i = leakage.words_of(dict(docs)[r.doc_id]), leakage.words_of(dict(items)[r.item_id])
        a, b = d[r.doc_at : r.doc_at + r.words], i[r.item_at : r.item_at + r.words]
        assert a == b and r.words >= 5
    assert leakage.leaked_passages(frame, held.limit(0), 5).count() == 0
    assert leakage.leaked_passages(frame.limit(0), held, 5).count() == 0
    assert leakage.clean_corpus(frame, leakage.leaked_passages(frame, held, 5)).where("doc_id = 93").count() == (0 if (93, 1) in brute(docs, items, 5) else 2)


EASY = ["The cat sat on the mat.", "We like the big red ball.", "Can you see the dog? It can run.", "My hat is on the bed."]
MIDDLE = ["The new bridge was built because the old road often flooded in spring.", "Visitors usually notice that the harbour becomes busy after the morning market.", "A careful gardener checks the soil before planting the seeds."]
HARD = ["Notwithstanding institutional heterogeneity, the epistemological presuppositions of categorisation remain fundamentally contested.", "The proliferation of methodological abstraction systematically undermines interpretive accountability within comparative inquiry."]
FOREIGN = ["Der alte Turm steht neben dem Hafen und niemand weiß warum.", "Wir haben gestern den Garten geprüft und für gut befunden."]


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        level = i % 4
        pool = (EASY, MIDDLE, HARD, FOREIGN)[level]
        other = rnd.choice((EASY, MIDDLE, HARD)) if level < 3 else FOREIGN
        rows.append((i, " ".join(rnd.choice(pool) for _ in range(14)) + " " + rnd.choice(other), "en" if level < 3 else "de", level))
    return rows


def test_reading_levels(spark):
    rows = texts()
    extra = [(200, None, "en"), (201, "", None), (202, "Too short.", "en"), (203, "def f(x): return x + 1 " * 30, "en"), (204, "12 7 99 " * 60, "und"), (205, " ".join(HARD * 6), "de"), (206, "The cat sat on the mat. " * 3000, None)]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, t, lang, _ in rows] + [(*e, 1) for e in extra], "doc_id bigint, text string, lang string, y int")
    labels = [(i, f"r{r}", ("Basic ", "MIDDLE", "advanced")[k], 0) for i, _, _, k in rows if k < 3 and i < 40 for r in (1, 2)] + [(0, "r9", "advanced", 0), (1, None, None, 0), (1, "r3", "nonsense", 0)]
    labels = spark.createDataFrame(labels, "doc_id bigint, rater string, read_level string, y int")
    items = spark.createDataFrame([(1, None), (2, "some held out words that nobody wrote")], "item_id bigint, text string")
    model = readability.train(docs, labels)
    got = {r.doc_id: r.read_level for r in readability.reading_levels(docs, model, items).collect()}
    assert got == {**{i: readability.LEVELS[k] for i, _, _, k in rows if k < 3}, 205: "advanced", 206: "basic"}
    assert readability.reading_levels(docs.limit(0), model).count() == 0
    nothing = readability.train(docs, labels.limit(0))
    assert readability.reading_levels(docs, nothing).count() >= 0
    assert readability.reading_levels(docs, readability.train(docs.limit(0), labels.limit(0))).count() == 0


def test_passages_of_items_do_not_count():
    rows = texts()
    held = " ".join(HARD * 5)
    model = readability.Model([(t, k) for _, t, _, k in rows if k < 3], [(t, k < 3) for _, t, _, k in rows])
    mixed = " ".join(EASY * 4) + " " + held
    other = readability.Passages([readability._spoken("nothing that is ever said here by anyone at all")])
    assert model.levels([mixed], [other, readability.Passages([readability._spoken(held)])]) == [0]
    assert model.levels([mixed], [other]) == model.levels([mixed]) == [2]


def test_every_block_of_items_is_read(spark):
    items = spark.range(3000).selectExpr("id as item_id", "repeat(concat('word', id, ' '), 9) as text").unionByName(spark.createDataFrame([(None, "x"), (1, None)], "item_id bigint, text string"))
    blocks = list(leakage.item_texts(items, 2000))
    assert len(blocks) > 5 and sum(map(len, blocks)) == 3000 and {i for b in blocks for i, _ in b} == set(range(3000))


def test_cross_fitted_weights():
    rows = texts(n=80)
    model = readability.Model([(t, k) for _, t, _, k in rows if k < 3], [(t, k < 3) for _, t, _, k in rows])
    assert abs(model.weights.sum() - 1) < 1e-9 and model.weights[0] > model.weights[3] and (model.knots[1:] >= model.knots[:-1]).all() and (model.values[1:] >= model.values[:-1]).all()


def test_hits_in_parts(monkeypatch):
    """However the hits are laid out, the result is the same; items of one id are told apart."""
    items = [(1, "a b c d e f".split()), (1, "x a b c d".split()), (2, "c d e f".split())]
    index, texts_ = leakage.ItemIndex(items, 3), ["a b c d e f a b c d", None, "q x a b c", "c d e f"] * 3
    whole = sorted(leakage.search_shard(index, texts_))
    monkeypatch.setattr(leakage, "MAX_HITS", 2)
    assert sorted(leakage.search_shard(index, texts_)) == whole
    assert [r for r in whole if r[0] == 2] == [(2, 1, 4, 1, 0)] and [r for r in whole if r[0] == 0] == [(0, 1, 6, 0, 0), (0, 2, 4, 2, 0)]


def test_isotonic():
    import numpy as np

    x, y = np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 2, 1, 1, 3, 1])
    knots, values = readability.isotonic(x, y, np.ones(6))
    assert list(np.interp(x, knots, values)) == pytest.approx([0, 4 / 3, 4 / 3, 4 / 3, 2, 2])
