"""Template residue that no list names."""

from lexspark.llm import pages, residue_lines
from test_pages import PROSE, SCHEMA, WORDS


def found(spark, rows):
    """doc_ids of residue among ``(site, title, content)``, numbered from 0."""
    df = spark.createDataFrame([(i, f"e{i}", f"https://{site}/{i}", title, content, "x", 1) for i, (site, title, content) in enumerate(rows)], SCHEMA)
    return {r.doc_id for r in pages.residue_pages(df).collect()}


def test_titles_never_filled(spark):
    bad = ("undefined | Tutumi", "Your site title here", "NaN", "Lorem ipsum dolor sit amet", "Tutumi | Page not found", "{{ page.title }}")
    good = ("Null and void: the old lease", "Rope & sail | Tutumi", "The harbour | Tutumi", None, "")
    assert found(spark, [("tutumi.example", t, PROSE) for t in (*bad, *good)]) == set(range(len(bad)))
    assert found(spark, [("s.example", "Lorem ipsum", PROSE + " That is what the words lorem ipsum stood for in the end.")]) == set()


def test_title_that_comes_back_over_sites(spark):
    rows = [(f"site{i}.example", "Quick setup wizard", PROSE) for i in range(3)]
    rows += [(f"site{i}.example", "The old harbour", PROSE) for i in range(3)]
    rows += [("one.example", "Winter offers", PROSE)] * 3
    assert found(spark, rows) == {0, 1, 2}


def test_slots_induced_from_filled_records(spark):
    lines = ["Dear Anna, thank you for your visit.", "Dear Peter, thank you for your visit.", "Dear undefined, thank you for your visit.", "Dear , thank you for your visit.", "Dear Your Name, thank you for your visit.", "Dear first_name, thank you for your visit.", "The value is undefined, as the book says of it."]
    assert found(spark, [("s.example", None, PROSE + "\n" + line) for line in lines]) == {2, 3, 4, 5}


def test_notation_that_no_list_holds(spark):
    lines = [f"Your order from ¤{w}¤ is on its way to you." for w in ("shop", "city")] + ["The sign ¤ stands for any coin."]
    assert residue_lines.kind(lines[0]) is None
    assert found(spark, [(f"s{i}.example", None, PROSE + "\n" + line) for i, line in enumerate(lines)]) == {0, 1}


def test_slot_in_a_long_paragraph(spark):
    assert found(spark, [("s.example", None, f"{PROSE} The work was paid for by {{{{company}}}} and its friends."), ("s.example", None, PROSE)]) == {0}


def test_notice_over_sites_and_on_a_page_with_text(spark):
    """A clause that stands alone on pages of several sites is a notice, whatever it is joined to and wherever else it stands."""
    clause = "the lantern keeper has left the room"
    rows = [(f"s{i}.example", None, f"{w}, {clause}.") for i, w in enumerate(("Hush", "Well", "Alas"))] + [("t.example", None, f"{PROSE}\nHush, {clause}.")]
    rows += [(f"u{i}.example", None, f"{PROSE}\nThe {w} lies by the sea and is open to all who come to see it.") for i, w in enumerate(WORDS)]
    assert found(spark, rows) == {0, 1, 2, 3}
