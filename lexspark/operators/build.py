"""Building the inverted index: tokens, postings, dictionary, document table, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.porter import stem_words
from lexspark.functions.text import tokenize_nostem


def token_counts(corpus: DataFrame) -> DataFrame:
    """``doc_id, token, n``: unstemmed tokens without stopwords, counted per document."""
    tokens = corpus.select("doc_id", F.explode(tokenize_nostem("content")).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def stem_vocabulary(tokens: DataFrame) -> DataFrame:
    """``token, term`` of the different tokens: stemming is paid once per word, not once per occurrence."""
    return stem_words(tokens.select("token").distinct(), "token", "term")


def term_frequencies(corpus: DataFrame) -> DataFrame:
    """``doc_id, term, tf``. The vocabulary joins by token; adaptive execution broadcasts it while it is small
    and splits the tokens that most documents hold when it is not."""
    counts = token_counts(corpus)
    terms = counts.join(stem_vocabulary(counts), "token")
    return terms.groupBy("doc_id", "term").agg(F.sum("n").alias("tf"))


def document_table(corpus: DataFrame) -> DataFrame:
    """``doc_id, external_id, url, title, length``; length counts tokens after stopwords, 0 for an empty text."""
    length = F.coalesce(F.size(tokenize_nostem("content")), F.lit(0))
    length = F.when(F.col("content").isNull(), F.lit(0)).otherwise(length)
    return corpus.select("doc_id", "external_id", "url", "title", length.alias("length"))


def postings(corpus: DataFrame) -> DataFrame:
    """``term, doc_id, tf, doc_len``: the document's length travels along, so scoring needs no second join.

    The length is the sum of the document's frequencies, which equals its number of tokens.
    """
    from pyspark.sql import Window

    tf = term_frequencies(corpus)
    return tf.select("term", "doc_id", "tf", F.sum("tf").over(Window.partitionBy("doc_id")).alias("doc_len"))


def dictionary(post: DataFrame) -> DataFrame:
    """``term, df``."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(doc_table: DataFrame) -> DataFrame:
    """One row ``doc_count, total_length, avgdl``; avgdl is 0 without documents."""
    stats = doc_table.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_length"))
    avg = F.when(F.col("doc_count") > 0, F.col("total_length").cast("double") / F.col("doc_count").cast("double")).otherwise(0.0)
    return stats.withColumn("avgdl", avg)


def index_stats(terms: DataFrame, doc_table: DataFrame) -> DataFrame:
    """One row ``term_count, doc_count, total_postings`` out of ``term, df``."""
    terms = terms.agg(F.count("*").alias("term_count"), F.coalesce(F.sum("df"), F.lit(0)).alias("total_postings"))
    return terms.select("term_count", doc_table.agg(F.count("*").alias("c")).scalar().alias("doc_count"), "total_postings")
