"""BM25 and TF-IDF as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BM25Params:
    """Saturation ``k1`` and length normalisation ``b``."""

    k1: float = 1.2
    b: float = 0.75


def _d(x: Column | str | float | int) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def bm25_idf(n: Column | str | int, df: Column | str | int) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1); 0 where N or df is 0."""
    n, df = _d(n), _d(df)
    return F.when((df == 0) | (n == 0), F.lit(0.0)).otherwise(F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0)))


def bm25_weight(tf: Column | str | int, idf: Column, doc_len: Column | str | int, avgdl: Column | str | float, params: BM25Params = BM25Params()) -> Column:
    """idf x saturated frequency, for an idf already known; 0 where tf or the average length is 0."""
    tf, dl, avg = _d(tf), _d(doc_len), _d(avgdl)
    k1, b = F.lit(float(params.k1)), F.lit(float(params.b))
    norm = F.lit(1.0) - b + b * (dl / F.when(avg != 0, avg))
    return F.when((tf == 0) | (avg == 0), F.lit(0.0)).otherwise(idf * ((tf * (k1 + F.lit(1.0))) / (tf + k1 * norm)))


def bm25_score(tf, df, doc_len, avgdl, n, params: BM25Params = BM25Params()) -> Column:
    """The BM25 score of one term in one document; 0 where tf, df, N or the average length is 0."""
    return F.when((_d(df) == 0) | (_d(n) == 0), F.lit(0.0)).otherwise(bm25_weight(tf, bm25_idf(n, df), doc_len, avgdl, params))


def tfidf_idf(n, df) -> Column:
    """log10(N / df); 0 where df is 0 or not below N."""
    n, df = _d(n), _d(df)
    return F.when((df == 0) | (df >= n), F.lit(0.0)).otherwise(F.log10(n / F.when(df != 0, df)))


def tfidf_score(tf, df, doc_len, n) -> Column:
    """(tf / length) x log10(N / df); 0 where length, df or N is 0."""
    dl = _d(doc_len)
    return F.when((dl == 0) | (_d(df) == 0) | (_d(n) == 0), F.lit(0.0)).otherwise((_d(tf) / F.when(dl != 0, dl)) * tfidf_idf(n, df))
