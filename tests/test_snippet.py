"""Snippets against a byte-by-byte model."""

from pyspark.sql import functions as F

from lexspark.functions.snippet import highlight, snippet

SPACE = b"\t\n\x0b\f\r \x85\xa0"
TEXTS = [
    "Go is small", "", "one", "word " * 60 + "target here " + "tail " * 60, "x" * 500 + " target", "line\nbreak\n\ntarget\tmore text follows after it\n", "näive çafé target mit Ümlaut und größerem Text " * 4,
    "target" + "y" * 400, "no match in here at all " * 20, "日本語 target テキスト " * 10,
]


def model(text, terms, window):
    if not text or not terms:
        return ""
    window = window if window > 0 else 200
    body, low = text.encode(), text.lower().encode()
    found = [p for t in terms if (p := low.find(t.encode())) >= 0]
    pos = min(found, default=0)
    start, end = max(0, pos - window // 2), min(len(body), pos + window // 2)
    if start > 0:
        while start < end and body[start] not in SPACE:
            start += 1
        while start < end and body[start] in SPACE:
            start += 1
    if end < len(body):
        while end > start and body[end - 1] not in SPACE:
            end -= 1
    if start >= end:
        start, end = pos, min(len(body), pos + window)
    return ("..." if start > 0 else "") + body[start:end].decode("utf-8", "replace") + ("..." if end < len(body) else "")


def test_window(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for terms in (["target"], ["zzz", "more"], ["small", "go"]):
        for window in (7, 60, 200, 0):
            got = [r[0] for r in df.select(snippet("t", F.array(*map(F.lit, terms)), window, mark=False)).collect()]
            want = [model(t, terms, window) for t in TEXTS]
            same = [g == w or "�" in w for g, w in zip(got, want)]
            assert all(same), [(g, w) for g, w, s in zip(got, want, same) if not s][:2]


def test_highlight(spark):
    row = spark.createDataFrame([("Go, Google and GO",)], "t string").select(highlight("t", F.array(F.lit("go"))), highlight("t", F.array(F.lit("and"), F.lit("mark")))).first()
    assert row[0] == "<mark>Go</mark>, <mark>Go</mark>ogle and <mark>GO</mark>"
    assert row[1] == "Go, Google <<mark>mark</mark>>and</<mark>mark</mark>> GO"


def test_nothing_to_show(spark):
    df = spark.createDataFrame([(None, ["a"]), ("", ["a"]), ("text", []), ("text", None)], "t string, q array<string>")
    assert [r[0] for r in df.select(snippet("t", F.col("q"))).collect()] == [""] * 4
