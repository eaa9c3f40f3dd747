"""The queries of the training-data problems and, where SQL can tell the result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.text import STOPWORDS, tokenize_nostem
from lexspark.llm import bpe, leakage, pages, readability, salience, site_lines, termstats, topn
from lexspark.sources.scan import spread


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df) if name in ("corpus", "documents") else df  # work of many seconds a MB follows


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.spam_pages(_t(spark, d, "corpus"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.furniture_lines(_t(spark, d, "corpus"))


def p2_main_content(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned body of every page: its size and a hash of it."""
    rows = pages.main_content(_t(spark, d, "corpus"))
    return rows.select("doc_id", F.length("content").alias("chars"), F.md5(F.col("content").cast("binary")).alias("md5"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(_t(spark, d, "corpus"))


def p3_excess(spark: SparkSession, d: str) -> DataFrame:
    """How far each repeated line goes beyond what other sites lead one to expect."""
    rows = site_lines.excess_lines(_t(spark, d, "corpus")).where("repeated")
    return rows.select("docs", "outside", F.round("llr", 6).alias("llr"), "significant")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "search_results").withColumn("query", F.lower(F.trim("query"))).where("query <> ''")
    return topn.top_n_per_group(rows, "query", "score", "doc_id", 10).select("query", "doc_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    n = termstats.page_count(_t(spark, d, "doc_table"))
    return salience.distinctive_terms(_t(spark, d, "postings"), n).select("doc_id", "term")


def p5_graph_of_words(spark: SparkSession, d: str) -> DataFrame:
    pages_ = _t(spark, d, "corpus")
    n = termstats.page_count(pages_)
    rows = salience.graph_of_words(pages_, "doc_id", tokenize_nostem("content"), n)
    micro = F.floor((F.round(F.col("score") * 1e9) + 500) / 1000)  # in whole numbers, so that halves go up everywhere
    return rows.select("doc_id", "term", "degree", (micro / 1e6).alias("score"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    n = termstats.page_count(_t(spark, d, "doc_table"))
    return termstats.mark_terms(termstats.term_statistics(_t(spark, d, "postings")), n)


def p6_text_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Every n-gram of up to three words of the pages that at least two pages hold."""
    rows = termstats.text_ngrams(_t(spark, d, "corpus"), "doc_id", tokenize_nostem("content"), 3)
    return rows.where("records > 1")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.residue_pages(_t(spark, d, "corpus"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(_t(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return readability.reading_levels(docs, readability.train(docs, _t(spark, d, "reading_labels")), _t(spark, d, "eval_items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_main_content, p3_found, p3_excess, p4_found, p5_found, p5_graph_of_words, p6_found, p6_text_ngrams, p7_found, p8_ids, p9_found, p10_found)
}

_PAIRS = """pairs AS (SELECT lower(trim(term)) AS term, doc_id, max(tf) AS tf FROM postings
  WHERE term IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT count(DISTINCT doc_id) AS n FROM doc_table),
df AS (SELECT term, count(*) AS df FROM pairs GROUP BY term)"""

_STOP = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_TOK = f"""raw AS (SELECT doc_id, regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{Nd}}]+') AS a FROM corpus),
tok AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos
  FROM (SELECT doc_id, unnest(a) AS t, unnest(range(len(a))) AS pos FROM raw) WHERE t <> '' AND t NOT IN ({_STOP}))"""

SQL: dict[str, str] = {
    "p5_graph_of_words": f"""WITH {_TOK}, n AS (SELECT count(DISTINCT doc_id) AS n FROM corpus),
  e AS (SELECT DISTINCT a.doc_id, a.t AS term, b.t AS other FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) BETWEEN 1 AND 3 AND a.t <> b.t),
  g AS (SELECT doc_id, term, count(*) AS degree FROM e GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM g GROUP BY 1),
  m AS (SELECT doc_id, count(DISTINCT t) AS terms FROM tok GROUP BY 1),
  s AS (SELECT doc_id, term, degree, floor(degree / terms * log10(n / df) * 1e9 + 0.5) AS nano FROM g JOIN df USING (term) JOIN m USING (doc_id), n)
SELECT doc_id, term, degree, floor((nano + 500) / 1000) / 1e6 AS score FROM s WHERE nano > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY nano DESC, term) <= 3""",
    "p6_text_ngrams": f"""WITH {_TOK},
  w AS (SELECT doc_id, t AS t1, lead(t, 1) OVER p AS t2, lead(t, 2) OVER p AS t3 FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
  g AS (SELECT doc_id, t1, CAST(NULL AS VARCHAR) AS t2, CAST(NULL AS VARCHAR) AS t3 FROM w
    UNION ALL SELECT doc_id, t1, t2, NULL FROM w WHERE t2 IS NOT NULL UNION ALL SELECT doc_id, t1, t2, t3 FROM w WHERE t3 IS NOT NULL)
SELECT t1, t2, t3, count(*) AS total, count(DISTINCT doc_id) AS records FROM g GROUP BY 1, 2, 3 HAVING count(DISTINCT doc_id) > 1""",
    "p3_found": """WITH p AS (SELECT doc_id, external_id, regexp_replace(regexp_replace(regexp_extract(lower(trim(url)),
    '^(?:[a-z][a-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', ''), 'x^', '') AS site, string_split(content, chr(10)) AS ls
    FROM corpus WHERE url IS NOT NULL AND content IS NOT NULL),
  l AS (SELECT doc_id, external_id, site, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM p WHERE site <> ''),
  k AS (SELECT doc_id, external_id, site, CAST(line_no AS INTEGER) AS line_no,
    trim(regexp_replace(regexp_replace(lower(line), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS norm FROM l),
  c AS (SELECT site, norm FROM k WHERE norm <> '' GROUP BY 1, 2 HAVING count(DISTINCT external_id) >= 5)
SELECT doc_id, line_no FROM k JOIN c USING (site, norm)""",
    "p3_excess": """WITH p AS (SELECT coalesce(external_id, 'doc:' || doc_id) AS e, nullif(regexp_replace(regexp_extract(lower(trim(url)),
    '^(?:[a-z][a-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', ''), '') AS site, content FROM corpus WHERE url IS NOT NULL),
  sizes AS (SELECT site, count(DISTINCT e) AS n FROM p WHERE site IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS total FROM sizes),
  l AS (SELECT e, site, unnest(string_split(content, chr(10))) AS line FROM p WHERE site IS NOT NULL AND content IS NOT NULL),
  k AS (SELECT e, site, trim(regexp_replace(regexp_replace(lower(line), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS norm FROM l),
  c AS (SELECT site, norm, count(DISTINCT e) AS docs FROM k WHERE norm <> '' GROUP BY 1, 2),
  b AS (SELECT site, CAST(docs AS DOUBLE) AS a, CAST(sum(docs) OVER (PARTITION BY norm) AS DOUBLE) - docs AS b, CAST(n AS DOUBLE) AS n1, CAST(total AS DOUBLE) - n AS n2 FROM c JOIN sizes USING (site), t),
  r AS (SELECT *, (a + b) / (n1 + n2) AS r FROM b),
  g AS (SELECT *, greatest(0e0, 2 * (a * ln(a / (n1 * r)) + CASE WHEN n1 - a > 0 AND 1 - r > 0 THEN (n1 - a) * ln((n1 - a) / (n1 * (1 - r))) ELSE 0 END
    + CASE WHEN b > 0 AND n2 * r > 0 THEN b * ln(b / (n2 * r)) ELSE 0 END + CASE WHEN n2 - b > 0 AND 1 - r > 0 THEN (n2 - b) * ln((n2 - b) / (n2 * (1 - r))) ELSE 0 END)) AS g2 FROM r),
  x AS (SELECT *, CASE WHEN a * greatest(n2, 1e0) > b * n1 THEN g2 ELSE -g2 END AS llr FROM g),
  y AS (SELECT *, sqrt(greatest(llr, 0e0) / 2) AS z FROM x),
  v AS (SELECT *, CASE WHEN llr > 0 AND a > 1 THEN CAST(greatest(0, least(3000, floor((z * z + ln(greatest(z, 0.3e0) * 3.5449077018110318e0)) / 2.302585092994046e0 * 50))) AS INTEGER) ELSE 0 END AS bin FROM y),
  h AS (SELECT bin, count(*) AS k FROM v GROUP BY 1), u AS (SELECT bin, sum(k) OVER (ORDER BY bin DESC) AS rank, sum(k) OVER () AS m FROM h),
  cut AS (SELECT coalesce(min(bin), 1000000) AS cut FROM u WHERE pow(10e0, -bin / 50e0) <= 0.05e0 * rank / m)
SELECT CAST(a AS BIGINT) AS docs, CAST(b AS BIGINT) AS outside, round(llr, 6) AS llr, llr > 0 AND a > 1 AND bin >= cut AS significant FROM v, cut WHERE a >= 5""",
    "p4_found": """WITH r AS (SELECT lower(trim(query)) AS query, doc_id, max(score) AS score FROM search_results
    WHERE query IS NOT NULL AND trim(query) <> '' AND doc_id IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY 1, 2)
SELECT query, doc_id FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 10""",
    "p5_found": f"""WITH {_PAIRS},
  s AS (SELECT doc_id, term, tf, sum(tf) OVER (PARTITION BY doc_id) AS length FROM pairs WHERE tf IS NOT NULL),
  w AS (SELECT doc_id, term, round(tf / length * log10(n / df), 9) AS score FROM s JOIN df USING (term), n WHERE length > 0)
SELECT doc_id, term FROM w WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 3""",
    "p6_found": f"""WITH {_PAIRS}
SELECT term, CASE WHEN df <= 2 THEN 'rare' ELSE 'common' END AS mark FROM df, n WHERE df <= 2 OR df > 0.3 * n""",
    "p9_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS a FROM documents WHERE text IS NOT NULL),
  i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS a FROM eval_items WHERE text IS NOT NULL),
  dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(a) - 10), lambda k: array_to_string(a[k:k+11], ' '))) AS g FROM d WHERE len(a) >= 12),
  ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(a) - 10), lambda k: array_to_string(a[k:k+11], ' '))) AS g FROM i WHERE len(a) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
