"""Problems 1, 2 and 7 on whole page tables, built on one judgement per page.

Where several results are drawn from the judgements they are checkpointed first, into the folder the cluster shares, so
that no page is read twice and lost executors cost no more than their own tasks. What is counted over the table are
hashes of line forms: 8 bytes for a line, never its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm import blocks
from lexspark.llm.page_judge import judge_pages, runs, spam_flags
from lexspark.llm.page_lines import PageLines
from lexspark.llm.skew import checked, salt, salts, totals
from lexspark.session import checkpoint_dir

#: A notice has to come back on so many pages that hold little else, and on them more than elsewhere by this share of its pages
#: and this log-likelihood ratio against the share of such pages in the table (p about 0.001).
MIN_NOTICES, ON_SHORT, MIN_LLR = 3, 0.4, 10.83
#: So many different values in a slot show that it is one.
MIN_VALUES = 2
#: A title's head is a default if pages that tell nothing of it have it on so many sites, and hardly any other does.
MIN_SITES, ELSEWHERE = 3, 0.1


def spam_pages(pages: DataFrame) -> DataFrame:
    """``doc_id`` of pages whose own text is for the most part repeated keywords, lists of links or tags.

    Furniture is set aside by the block classifier. Words are stuffed where the page's terms recur within a few places
    (recurrence gaps) and go on meeting themselves from lag to lag (autocorrelation over lag windows); runs of many
    different content words without function words, entries that are hardly more than a link, and heaps of tags count
    alike. A page comes out if such words outnumber those in sentences and are at least ``page_judge.MIN_SPAM_WORDS``.
    Pages without content do not come out; rows given twice come out twice.
    """
    return spam_flags(pages).where("spam").select("doc_id")


def judged(pages: DataFrame, bins: bool = False) -> DataFrame:
    """The judgements, checkpointed, each row with a number of its own (``row``)."""
    checkpoint_dir(pages.sparkSession)
    return judge_pages(pages, bins).checkpoint().withColumn("row", F.monotonically_increasing_id())  # what is checkpointed keeps its order


def _llr(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood ratio of ``k`` out of ``n`` against the share ``p``."""

    def term(x: Column, e: Column) -> Column:
        return F.when((x > 0) & (e > 0), x * F.log(x / e)).otherwise(0.0)

    return 2 * (term(k, n * p) + term(n - k, n * (1 - p)))


def slot_pages(rows: DataFrame) -> DataFrame:
    """``doc_id`` of pages with a line whose aligned records (lines of one form) show it to be a template with an open slot.

    A form is such a template if its slot holds different values in different records - names and numbers where it was
    filled, variables, defaults or blanks where it was not; the records left unfilled come out.
    """
    opened = rows.where("exists(held, h -> h = 1)").select("doc_id", F.explode(F.arrays_zip("forms", "held")).alias("t")).where("t.held = 1").select("doc_id", "t.forms").distinct()
    # only records of forms that some page left open are looked at; equal values of a form are put together before they travel
    lines = rows.where("size(forms) > 0").select(F.explode(F.arrays_zip("forms", "values")).alias("t")).select("t.forms", "t.values")
    values = lines.join(checked(opened.select("forms").distinct()), "forms", "left_semi").distinct()
    slots = values.groupBy("forms").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_VALUES)
    return opened.join(slots, "forms", "left_semi").select("doc_id")


def notice_pages(rows: DataFrame) -> DataFrame:
    """``doc_id`` of pages with a clause that comes back on pages that hold nothing else.

    Furniture comes back on all pages of a site, a text's sentences on none; what comes back on pages without a text,
    over sites or within one, stands in place of it: an error, a notice, words of a layout.
    """
    base = rows.where("not spam and size(keys) > 0").agg(F.coalesce(F.avg(F.col("short").cast("double")), F.lit(0.0)).alias("p")).scalar()
    wanted = checked(rows.where("short").select(F.explode("keys").alias("key")).distinct())
    clauses = rows.where("size(keys) > 0").select("doc_id", "ext", "short", F.explode("keys").alias("key"))
    once = clauses.join(wanted, "key", "left_semi").groupBy("key", "ext").agg(F.max("short").alias("short"))
    counts = once.groupBy("key").agg(F.sum(F.col("short").cast("double")).alias("k"), F.count("*").cast("double").alias("n"))
    found = counts.where((F.col("k") >= MIN_NOTICES) & (F.col("k") >= ON_SHORT * F.col("n")))
    found = found.where(_llr(F.col("k"), F.col("n"), F.greatest(base, F.lit(1e-6))) >= MIN_LLR).select("key")
    return clauses.join(checked(found), "key", "left_semi").select("doc_id")


def default_title_pages(rows: DataFrame) -> DataFrame:
    """``doc_id`` of pages whose title comes back over several sites, on pages that tell nothing of it."""
    # distinct (head, site) first: a default may be the title of very many pages
    titles = rows.where("head <> 0").groupBy("head", "site").agg(F.max("apart").alias("apart"))
    heads = titles.groupBy("head").agg(F.sum(F.col("apart").cast("int")).alias("on_apart"), F.count("*").alias("all"))
    defaults = heads.where((F.col("on_apart") >= MIN_SITES) & (F.col("all") - F.col("on_apart") <= ELSEWHERE * F.col("on_apart"))).select("head")
    return rows.where("apart").select("doc_id", "head").join(defaults, "head", "left_semi").select("doc_id")


def residue_of(rows: DataFrame) -> DataFrame:
    """``doc_id`` (distinct) of pages with template residue, out of judgements.

    Aligned records lead in by three ways: a slot left open in a template (``slot_pages``), a notice that comes back in
    place of content (``notice_pages``), a title that comes back over sites (``default_title_pages``). A page by itself
    does if it shows a slot in the notation of a template language, nothing but filler, or the words of an error
    standard or of a browser without scripts and little else.
    """
    alone = rows.where("residue").select("doc_id")
    return alone.unionByName(slot_pages(rows)).unionByName(notice_pages(rows)).unionByName(default_title_pages(rows)).distinct()


def residue_pages(pages: DataFrame) -> DataFrame:
    """``doc_id`` of pages with unfilled templates, filler, failures or script notices; see ``residue_of``.

    Null titles and contents show nothing. A doc_id comes out once.
    """
    return residue_of(judged(pages))


def site_counts(lines: DataFrame, n: int) -> DataFrame:
    """``form, salt, docs, odds`` of the forms (of a site) that stand on two pages or more, for each salt that occurs: the number
    of pages and the mean of their odds. ``lines`` is ``form, ext, odds``."""
    once = lines.groupBy("form", "ext").agg(F.avg("odds").cast("float").alias("o"))
    partial = once.groupBy("form", salt(n, "ext").alias("salt")).agg(F.count("*").alias("c"), F.sum("o").alias("o"))
    return totals(partial, ["form"], docs="c", odds="o").where("docs > 1").withColumn("odds", F.col("odds") / F.col("docs"))


def furniture_of(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """``doc_id, line_no`` of the furniture of the pages ``kept``, where ``rows`` are the judgements (with bins) of the whole table.

    Each line's features are completed by the number of pages of its site with the same form and by how the form looks on
    them, and the committee that knows both decides. A form that a whole site shares is spread over salts told by the page;
    what goes back to a page are the numbers of its lines that are not the only ones of their form.
    """
    n = salts(rows)
    kind = dict(rows.dtypes)["doc_id"]
    counts = site_counts(rows.select("ext", F.explode(F.arrays_zip("of_site", "odds")).alias("t")).select("ext", F.col("t.of_site").alias("form"), "t.odds"), n)
    lines = kept.select("row", "ext", F.posexplode("of_site").alias("at", "form")).select("row", "at", "form", salt(n, "ext").alias("salt"))
    shared = lines.join(counts, ["form", "salt"]).groupBy("row").agg(F.collect_list(F.struct("at", F.col("docs").cast("int").alias("docs"), F.col("odds").cast("float").alias("odds"))).alias("shared"))
    models = rows.sparkSession.sparkContext.broadcast(blocks.classifiers()[1])  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = models.value
        for batch in batches:
            if not batch.num_rows:
                continue
            no, blobs, alone, shared = (batch.column(k) for k in range(1, 5))
            counts = pc.fill_null(pc.list_value_length(no), 0).to_numpy()
            begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
            size = int(counts.sum())
            if not size:
                continue
            packed = np.frombuffer(b"".join(blobs.to_pylist()), dtype=np.uint8).reshape(size, -1)
            docs, odds = np.ones(size), alone.flatten().to_numpy().astype(float)  # of a form that stands on this page only
            met = shared.flatten()
            at = begins[pc.list_parent_indices(shared).to_numpy()] + met.field("at").to_numpy()
            docs[at], odds[at] = met.field("docs").to_numpy(), met.field("odds").to_numpy()
            found = model.furniture(np.column_stack([packed, model.bins(blocks.site_features(docs, odds / 100), packed.shape[1])]))
            of = np.repeat(np.arange(batch.num_rows), counts)[found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), no.flatten().filter(pa.array(found))], names=["doc_id", "line_no"])

    told = kept.where("size(no) > 0").select("row", "doc_id", "no", "bins", "odds").join(shared, "row", "left").select("doc_id", "no", "bins", "odds", "shared")
    return told.mapInArrow(run, f"doc_id {kind}, line_no int")


def furniture_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, line_no`` of the lines that are furniture, on pages that are neither spam nor residue.

    ``line_no`` counts the pieces of content between LFs from 1. Pages with null or blank content give no rows, a row given
    twice gives its lines twice; a page without url is one of a site of such pages, one without external id counts as
    its own. Further columns of ``pages``, whatever their names, are not read.
    """
    rows = judged(pages, bins=True)
    return furniture_of(rows, rows.where("not spam").join(checked(residue_of(rows)), "doc_id", "left_anti"))


def main_content(pages: DataFrame) -> DataFrame:
    """``doc_id, content``: each page's own lines in their order, told by the page alone; null content stays null.

    The lines are cut within the pass that judges them, so no text is shuffled; one row per row of ``pages``.
    """
    kind = dict(pages.dtypes)["doc_id"]
    models = pages.sparkSession.sparkContext.broadcast(blocks.classifiers()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = models.value
        for batch in runs(batches, 1):
            lines = PageLines(batch.column(1), batch.column(2), batch.column(3))
            gone = alone.furniture(alone.bins(lines.features()))
            out = batch.column(1).to_pylist()
            for page in np.unique(lines.page[gone]).tolist():
                cut = set(lines.line_no[lines.first[page] : lines.first[page] + lines.count[page]][gone[lines.first[page] : lines.first[page] + lines.count[page]]].tolist())
                out[page] = "\n".join(x for i, x in enumerate(out[page].split("\n"), 1) if i not in cut)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "content"])

    return pages.select("doc_id", "content", "title", "url").mapInArrow(run, f"doc_id {kind}, content string")
