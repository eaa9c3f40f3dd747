"""Snippets and highlighting as Column expressions, exact to the byte.

A text is viewed with one character per byte, so that places and lengths are those of its UTF-8 form; what is
cut out is turned back and repaired where a cut went through a character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import normalize

#: Bytes that count as white space.
W = "\\t\\n\\x0B\\f\\r \\x85\\xA0"


def _bytes(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def highlight(text: Column | str, terms: Column) -> Column:
    """Every occurrence of every term, whatever its case, within ``<mark>``; one term after another.

    Terms are letters and digits only, as tokenizing gives them. Null terms or text give null.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.aggregate(F.filter(terms, lambda t: t != ""), text, lambda a, t: F.regexp_replace(a, F.concat(F.lit("(?iu)("), t, F.lit(")")), F.lit("<mark>$1</mark>")))


def snippet(content: Column | str, terms: Column, window: int = 200, mark: bool = True) -> Column:
    """The part of ``content`` around the earliest place of any term, cut at white space, terms highlighted.

    Empty or null content, or no terms, give the empty string; without a match the text begins at its start.
    """
    content = F.col(content) if isinstance(content, str) else content
    if window <= 0:
        window = 200
    half = window // 2
    body, low = _bytes(content), _bytes(normalize(content))
    places = F.filter(F.transform(terms, lambda t: F.instr(low, _bytes(normalize(t))).cast("int")), lambda p: p > 0)
    v0 = F.struct(body.alias("b"), F.octet_length(content).alias("n"), (F.coalesce(F.array_min(places), F.lit(1)) - 1).alias("pos"))

    def let(value: Column, then) -> Column:
        """Names a value for one use after another, so that it is computed once."""
        return F.transform(F.array(value), then)[0]

    def window_of(v: Column) -> Column:
        begin = F.greatest(v["pos"] - half, F.lit(0))
        return F.struct(v["b"].alias("b"), v["n"].alias("n"), v["pos"].alias("pos"), begin.alias("s"), F.least(v["pos"] + half, v["n"]).alias("e"))

    def left(v: Column) -> Column:
        cut = F.substring(v["b"], v["s"] + 1, v["e"] - v["s"])
        kept = F.when(v["s"] > 0, F.regexp_replace(cut, f"\\A[^{W}]*[{W}]*", "")).otherwise(cut)
        return F.struct(v["b"].alias("b"), v["n"].alias("n"), v["pos"].alias("pos"), v["e"].alias("e"), kept.alias("x"), (v["e"] - F.length(kept)).alias("s"))

    def right(v: Column) -> Column:
        kept = F.when(v["e"] < v["n"], F.regexp_replace(v["x"], f"[^{W}]*\\z", "")).otherwise(v["x"])
        return F.struct(v["b"].alias("b"), v["n"].alias("n"), v["pos"].alias("pos"), v["s"].alias("s"), kept.alias("x"), (v["s"] + F.length(kept)).alias("e"))

    def whole(v: Column) -> Column:
        gone = F.length(v["x"]) == 0
        s = F.when(gone, v["pos"]).otherwise(v["s"])
        e = F.when(gone, F.least(v["pos"] + window, v["n"])).otherwise(v["e"])
        x = F.when(gone, F.substring(v["b"], v["pos"] + 1, F.lit(window))).otherwise(v["x"])
        text = F.make_valid_utf8(F.encode(x, "ISO-8859-1").cast("string"))
        shown = highlight(text, terms) if mark else text
        return F.concat(F.when(s > 0, "...").otherwise(""), shown, F.when(e < v["n"], "...").otherwise(""))

    made = let(v0, lambda v: let(window_of(v), lambda w: let(left(w), lambda x: let(right(x), whole))))
    return F.when(content.isNull() | (content == "") | terms.isNull() | (F.size(terms) == 0), F.lit("")).otherwise(made)
