"""Normalising, tokenising and stopwords as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stopwords, 158 words, in natural order.
STOPWORDS = frozenset(
    """
    a about above after again against all also although am an and any are as at be because been before being
    below between both but by can could couldn d did didn do does doesn doing don down during each either every
    few for from further had hadn has hasn have haven having he her here hers herself him himself his how i if
    in into is isn it its itself just ll m may me might more most must mustn my myself needn neither no nor not
    now of off on once only or other our ours ourselves out over own re s same shall she should shouldn so some
    such t than that the their theirs them themselves then there these they this those through to too under
    until up ve very was wasn we were weren what when where which while who whom why will with won would wouldn
    yet you your yours yourself yourselves
    """.split()
)


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def normalize(text: Column | str) -> Column:
    """Lowercased letter by letter: a capital sigma is always ``σ``, a dotted capital I plain ``i``."""
    return F.lower(F.translate(_col(text), "Σİ", "σi"))


def tokenize_raw(text: Column | str) -> Column:
    """Lowercased runs of letters and decimal digits, in their order. Null text gives null."""
    return F.filter(F.split(normalize(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def is_stopword(word: Column | str) -> Column:
    return _col(word).isin(*sorted(STOPWORDS))


def tokenize_nostem(text: Column | str) -> Column:
    """Raw tokens without stopwords."""
    return F.filter(tokenize_raw(text), lambda w: ~is_stopword(w))
