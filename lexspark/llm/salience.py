"""Problem 5: how telling a term is for its record.

``distinctive_terms`` weighs postings by (tf / length) x log10(N / df). ``graph_of_words`` replaces the
frequency by the number of different neighbours a term has within a window of its record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.skew import salt, salts, totals
from lexspark.llm.termstats import clean_postings


def _top(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("term").asc()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def distinctive_terms(postings: DataFrame, n: Column, k: int = 3) -> DataFrame:
    """``doc_id, term, score, rank``: up to ``k`` terms of each page with the highest score above 0.

    Score = (tf / length) x log10(N / df), rounded to 9 decimals; on equal scores the smaller term first.
    length is the sum of the page's tf. Null terms and pages do not count; a pair whose tf is never known
    has no score but counts in df; a page whose length is 0 has no terms.

    One shuffle cleans the postings by (term, salt); the document frequencies are joined back in that same
    partitioning, so a term held by a third of all pages stays spread; a second one goes by page.
    """
    rows = clean_postings(postings)
    part = rows.groupBy("term", "salt").agg(F.count("*").alias("c"), F.sum("tf").alias("cf"))
    df = totals(part, ["term"], df="c", cf="cf")
    idf = F.when(F.col("cf") > 0, F.log10(n / F.col("df")))  # a term without any known tf weighs nothing
    known = rows.where("tf is not null").join(df.select("term", "salt", idf.alias("idf")), ["term", "salt"])
    page = Window.partitionBy("doc_id")
    scored = known.withColumn("length", F.sum("tf").over(page)).where("length > 0 and idf > 0 and tf > 0")
    nano = F.floor(F.col("tf") / F.col("length") * F.col("idf") * 1e9 + 0.5)
    return _top(scored.select("doc_id", "term", nano.alias("score")).where("score > 0"), k).select("doc_id", "term", (F.col("score") / 1e9).alias("score"), "rank")


def graph_of_words(docs: DataFrame, key: str, tokens: Column, n: Column, window: int = 4, k: int = 3) -> DataFrame:
    """``doc_id, term, degree, score, rank`` by graph-of-words weighting.

    Within each record every token is joined by an edge to the ``window`` - 1 tokens after it; ``degree`` is the
    number of different other terms it shares an edge with. Score = degree / (different terms of the record)
    x log10(N / df), rounded to 9 decimals; tokens hold no tab. Records without tokens give no rows; the edges of a record are
    built within its row and never leave it undeduplicated.
    """
    tab = F.lit("\t")

    def edges(w: Column) -> Column:
        """An edge is one string, both ways; of strings array_distinct is a hash set, of structs it compares all pairs."""

        def of(t: Column, i: Column) -> Column:  # i counts from 0
            near = F.slice(w, F.greatest(i + 2 - window, F.lit(1)), F.least(i + 1, F.lit(window)) + window - 1)
            return F.transform(F.filter(near, lambda v: v != t), lambda v: F.concat(t, tab, v))

        return F.struct(F.size(F.array_distinct(w)).alias("terms"), F.array_distinct(F.flatten(F.transform(w, of))).alias("edges"))

    # the tokens are bound to a lambda's variable: a column would be inlined and worked out again at every use
    made = F.transform(F.array(tokens), edges)[0]
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.explode(F.array(made)).alias("m"))
    pairs = rows.select("doc_id", F.col("m.terms").alias("terms"), F.explode("m.edges").alias("e"))
    degree = pairs.groupBy("doc_id", F.substring_index("e", "\t", 1).alias("term")).agg(F.count("*").alias("degree"), F.first("terms").alias("terms"))
    spread = degree.withColumn("salt", salt(salts(docs), "doc_id"))
    df = totals(spread.groupBy("term", "salt").agg(F.count("*").alias("c")), ["term"], df="c")
    scored = spread.join(df, ["term", "salt"]).where(F.col("df") < n)
    nano = F.floor(F.col("degree") / F.col("terms") * F.log10(n / F.col("df")) * 1e9 + 0.5)
    return _top(scored.select("doc_id", "term", "degree", nano.alias("score")).where("score > 0"), k).withColumn("score", F.col("score") / 1e9)
