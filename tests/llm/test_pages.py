"""Furniture, spam and residue of pages; what each judgement rests on."""

import numpy as np
import pyarrow as pa
import pytest

from lexspark.llm import block_table, blocks, page_judge, pages, residue_lines
from lexspark.llm.page_lines import PageLines, hashes

PROSE = "The old harbour was rebuilt after the storm, and most of the stones came from a quarry in the hills. People who live there say that it has changed a lot since then. It is now a quiet place where you can sit and watch the boats come in."
SPAM = "lamp red lamp buy lamp lamp cheap lamp sale lamp order lamp bulb lamp lamp best lamp top lamp lamp shade lamp online lamp lamp store"
STUFFED = "Our small lamp is the best lamp because lamp fans who buy a small lamp love this cheap lamp. Small lamp in Town: lamp, small lamp and sale lamp for every lamp lover."
WORDS = [a + b for a in "mill barn tower bridge well gate wall dyke lock pier".split() for b in ("", "house", "yard", "side", "way", "land")]
SCHEMA = "doc_id bigint, external_id string, url string, title string, content string, spam string, ext int"


def frame(spark, contents, titles=None, site="s.example"):
    rows = [(i, f"e{i}", f"https://{site}/{i}", (titles or {}).get(i), c, "x", 1) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, SCHEMA)


def lines_of(content, title="", url=""):
    return PageLines(pa.array([content]), pa.array([title]), pa.array([url]))


def test_trees_on_sites_not_seen():
    alone, whole = blocks.classifiers()
    x, y = blocks.training_rows(block_table.pages(40, seed=99))
    for model, cols in ((alone, x.shape[1] - 2), (whole, x.shape[1])):
        got = model.furniture(model.bins(x[:, :cols]))
        assert (got == y).mean() > 0.93


def test_a_form_that_comes_back_is_furniture():
    """The same sentence, once in a site and on all of its pages: only its coming back differs."""
    _, whole = blocks.classifiers()
    lines = lines_of("\n".join([PROSE, PROSE[:100] + ".", "Our guests may ask the town hall for a copy of this list.", "Take note."]), "The old harbour", "https://quay.example/x")
    features = lines.features()
    at = [whole.furniture(whole.bins(np.column_stack([features, blocks.site_features(np.full(4, d), np.full(4, 0.5))])))[2] for d in (1, 100)]
    assert at == [False, True]


def test_notice_of_sixty_words(spark):
    notice = "By going on you agree that we and the firms we work with may keep small files on your machine, read them when you come back, and count what you look at. " * 2
    assert len(notice.split()) > 60
    rows = [(i, f"e{i}", f"https://quay.example/{i}", f"The old {w}", f"{notice.strip()}\n{PROSE.replace('harbour', w)} {w.capitalize()} is one of them.") for i, w in enumerate(WORDS[:12])]
    got = {(r.doc_id, r.line_no) for r in pages.furniture_lines(spark.createDataFrame(rows, "doc_id bigint, external_id string, url string, title string, content string")).collect()}
    assert got == {(i, 1) for i in range(12)}


def test_lines():
    lines = lines_of("One  two three\r\n\n \t\n- Four, http://x.example/a five.\n» Six", "Title of Four")
    assert lines.line_no.tolist() == [1, 4, 5] and lines.n_words.tolist() == [3, 2, 1] and lines.mark.tolist() == [0, 1, 3] and lines.links_at.tolist() == [0, 1, 0]
    forms = PageLines(pa.array(["Anna Bell wrote 12 notes.", "Peter wrote 7 notes.", "PETER WROTE 7 NOTES.", None]), pa.array([None] * 4, pa.string()), pa.array([None] * 4, pa.string()))
    a, b, c = hashes(forms.skeletons())
    assert a == b != c and forms.page.tolist() == [0, 1, 2]
    assert lines_of("").features().shape[0] == 0


def test_spam(spark):
    distinct = "anchor bottle candle drawer engine feather garden hammer island jacket kettle ladder marble needle orange pencil quartz ribbon saddle thimble umbrella violin window yarn zipper basket"
    contents = [PROSE, SPAM, STUFFED, "\n".join(f"http://x.example/{i}" for i in range(9)), "#lamp #lampsale #red #lamp " * 9, PROSE + "\n" + SPAM[:60], None, "", " \n\r\n", SPAM * 200, PROSE * 300, "word", distinct, distinct.replace(" ", "\n"), "\n".join(f"Best lamp : https://x.example/{i}" for i in range(9))]
    got = {r.doc_id for r in pages.spam_pages(frame(spark, contents)).collect()}
    assert got == {1, 2, 3, 4, 9, 12, 13, 14}


def prose_words(text):
    lines = lines_of(text)
    w = lines.words
    return lines.page[w.of], lines.page[w.of], np.where(w.function[w.code], -1, w.code)


def recurrence(text):
    return page_judge.Recurrence(*prose_words(text), 1)


def test_recurrence():
    stuffed, prose, cycle = recurrence(SPAM), recurrence(PROSE), recurrence(" ".join(f"key{i % 20}" for i in range(200)))
    assert stuffed.near[0] > 0.5 and stuffed.rho.mean() > 0.1 and stuffed.stuffed()[0]
    assert prose.near[0] < 0.2 and prose.rho.mean() < 0.02 and not prose.stuffed()[0]
    # a cycle of twenty words: nothing recurs within sixteen places, and every word does at lags 20, 40 and 60
    assert cycle.near[0] == 0 and cycle.rho[3:].min() > 0 and cycle.rho[:3].max() == 0 and cycle.peak[0] == 1 and cycle.cycles()[0]
    brute = [w for w in PROSE.lower().replace(",", "").replace(".", "").split()]
    prose._rhythm(*(np.asarray(x) for x in prose_words(PROSE)), 1)  # it is left out where nothing recurs
    met = sum(a == b and a not in page_judge.FUNCTION for lag in range(1, 5) for a, b in zip(brute, brute[lag:]))
    assert prose.rho[0][0] == pytest.approx(met / sum(len(brute) - lag for lag in range(1, 5)))
    assert page_judge.Recurrence(np.array([], int), np.array([], int), np.array([], int), 0).stuffed().shape == (0,)


def test_residue(spark):
    contents = [
        PROSE, PROSE + "\nDear {{name}}, thank you for your visit.", "500 Internal Server Error. Something went wrong.", "Please enable JavaScript to view this page.", "Your text goes here.",
        PROSE + "\nA 404 answer tells the crawler that the page was not found.", "In a template you write `{{name}}` where the name should stand, and this page tells you why that is so and what it is good for in the long run, with an example.\nrender('{{name}}', page)\n" + PROSE,
        PROSE, None, "", *["The shelf is being dusted at the moment."] * 4, "Welcome back, ~first~, we are glad to see you again.\n" + PROSE, "Welcome back, {{first}}, we are glad to see you again.\n" + PROSE,
        "Verum culpa samet officit nostem elitra dolam vitra. Consat culpa verum nostem dura fugit labres parit anima. Fugit noven culpa dolam repret samet tempra.",
        PROSE + "\nThe shelf is being dusted at the moment.",
        "Sorry to be late with this note.", "Oops, I did it again is a song.", "The old mill does not exist or has been torn down.",
        *[f"{PROSE} And {w} it is that you will find on the hill." for w in WORDS],
    ]
    titles = {7: "Page not found", 5: "What a 404 page should say"}
    got = {r.doc_id for r in pages.residue_pages(frame(spark, contents, titles)).collect()}
    assert got == {1, 2, 3, 4, 7, 10, 11, 12, 13, 14, 15, 16, 17}


@pytest.mark.parametrize("line,want", [("Hello ${user.name}", "slot"), ("The code `${x}` is quoted", None), ("print('{{x}}')", None), ("__title__", "slot"), ("Lorem ipsum dolor", "filler"), ("Activez les scripts pour continuer.", "scripts"), ("HTTP Status 403 – no entry", "failure"), ("A plain line", None), ("", None)])
def test_kinds(line, want):
    assert residue_lines.kind(line) == want


def test_furniture(spark):
    page = ["Home | About | Contact | Blog", "By Ann Smith | 3 May 2020 | 6 min read", PROSE, "- one clean stone for each wall", "", "Share this page: Mail · Print · Copy link", "© 220 Harbour Notes. All rights reserved."]
    contents = ["\n".join(page), SPAM, "500 Internal Server Error. Something went wrong.\n© 220 Harbour Notes. All rights reserved.", None, ""]
    got = {(r.doc_id, r.line_no) for r in pages.furniture_lines(frame(spark, contents)).collect()}
    assert got == {(0, 1), (0, 2), (0, 6), (0, 7)}
    main = {r.doc_id: r.content for r in pages.main_content(frame(spark, contents)).collect()}
    assert main[0] == "\n".join([PROSE, page[3], ""]) and main[3] is None and main[4] == "" and len(main) == 5


def test_counts_of_forms(spark):
    rows = [(f"e{i}", f, 40 + i % 3) for i in range(30) for f in (70, i)] * 2
    df = spark.createDataFrame(rows, "e string, form bigint, odds int").selectExpr("form", "xxhash64(e) as ext", "odds")
    got = {(r.form, r.docs, round(r.odds, 3)) for r in pages.site_counts(df, 4).collect()}
    assert got == {(70, 30, 41.0)} and pages.site_counts(df, 4).count() == 4  # one row for each salt


def test_runs(monkeypatch):
    monkeypatch.setattr(page_judge, "RUN", 3)
    monkeypatch.setattr(page_judge, "RUN_BYTES", 10)
    texts = ["abcd", None, "abcdef", "", "", "", "", "x" * 50, "a", "b"]
    got = [r.column(0).to_pylist() for r in page_judge.runs(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["t"])]), 0)]
    assert sum(got, []) == texts and [len(x) for x in got] == [3, 3, 1, 1, 2]


def test_empty_table(spark):
    none = frame(spark, ["x"]).limit(0)
    assert pages.spam_pages(none).count() == pages.residue_pages(none).count() == pages.furniture_lines(none).count() == pages.main_content(none).count() == 0


def test_nulls_everywhere(spark):
    rows = [(None, None, None, None, None, None, None), (1, None, None, None, PROSE, None, None), (2, "e", "", "", "\r\n", "", 0), (2, "e", "", "", "\r\n", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pages.spam_pages(df).count() == 0 and pages.residue_pages(df).count() == 0 and pages.furniture_lines(df).count() == 0
