"""One pass over pages: their blocks (problem 2), keyword spam (1) and what may be template residue (7).

Everything here is told by the page alone, a whole Arrow batch at a time (``page_lines``). The committees of trees have a
fixed size and are broadcast; no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import blocks, residue_lines
from lexspark.llm.page_lines import PageLines, Words, hashes, is_in
from lexspark.llm.site_lines import site_of

#: A term that comes back within so many places recurs.
NEAR = 16
#: Lag windows of the autocorrelation, from and to; it is taken within each of them.
WINDOWS = ((1, 4), (5, 8), (9, 16), (17, 32), (33, 64))
#: Of the terms of stuffed text so many recur nearby, and so many places hold the same term one lag on, on average over the windows.
MIN_NEAR, MIN_RHO = 0.4, 0.065
#: In a list nearly all recur within the longest lag, and so many places hold the same term at one single lag: a cycle.
MIN_FAR, MIN_PEAK = 0.8, 0.3
#: Share of function words below which words are a list, and above which they are sentences.
LIST_FUNCTION, SENTENCE_FUNCTION = 0.1, 0.15
MIN_LIST = 12
#: So many different content words in a row, without a function word, are a list whether or not any comes back.
MIN_DISTINCT = 24
#: A text of at least so many words in sentences is a text, whatever stands beside it.
REAL_WORDS = 40
MIN_SPAM_WORDS = 15
#: So many are enough where nothing else stands on the page.
MIN_BARE_SPAM = 3
#: So many words beside its slots make two lines records of one template, where no known notation tells so.
MIN_FIXED = 3


class Recurrence:
    """Recurrence gaps and autocorrelation of the words of a batch, by segment.

    ``text`` and ``segment`` tell of every word the text it stands in and the segment it counts for; ``code`` is the term,
    negative for a word that is none (a function word, a number). Texts and segments are numbered in reading order.
    """

    def __init__(self, text: np.ndarray, segment: np.ndarray, code: np.ndarray, segments: int):
        content = code >= 0
        self.terms = np.bincount(segment[content], minlength=segments)
        self.near, self.far, self.peak = np.zeros(segments), np.zeros(segments), np.zeros(segments)
        self.rho = np.zeros((len(WINDOWS), segments))
        at = np.flatnonzero(content)
        if len(at):
            self._gaps(text, segment, code, at, segments)
            # without recurrence nearby the rhythm decides nothing: only texts that hold some are gone through
            some = np.isin(text, np.unique(text[(self.near[segment] >= MIN_NEAR) | (self.far[segment] >= MIN_FAR)]))
            self._rhythm(text[some], segment[some], code[some], segments)

    def _gaps(self, text: np.ndarray, segment: np.ndarray, code: np.ndarray, at: np.ndarray, segments: int) -> None:
        order = at[np.lexsort((at, code[at], text[at]))]
        same = (text[order[1:]] == text[order[:-1]]) & (code[order[1:]] == code[order[:-1]])
        gap = np.diff(order)
        for name, reach in (("near", NEAR), ("far", WINDOWS[-1][1])):
            close = same & (gap <= reach)
            recurs = np.zeros(len(code), dtype=bool)
            recurs[order[1:][close]] = True
            recurs[order[:-1][close]] = True
            setattr(self, name, np.bincount(segment[recurs], minlength=segments) / np.maximum(self.terms, 1))

    def _rhythm(self, text: np.ndarray, segment: np.ndarray, code: np.ndarray, segments: int) -> None:
        for w, (lo, hi) in enumerate(WINDOWS):
            met, pairs = np.zeros(segments), np.zeros(segments)
            for lag in range(lo, min(hi, len(code) - 1) + 1):
                both = text[lag:] == text[:-lag]
                equal = both & (code[lag:] == code[:-lag]) & (code[lag:] >= 0)
                m, p = np.bincount(segment[:-lag][equal], minlength=segments), np.bincount(segment[:-lag][both], minlength=segments)
                self.peak = np.maximum(self.peak, np.where(p >= MIN_LIST, m / np.maximum(p, 1), 0))
                met += m
                pairs += p
            self.rho[w] = met / np.maximum(pairs, 1)

    def stuffed(self) -> np.ndarray:
        """Segments whose terms recur nearby and go on doing so from lag to lag; prose reaches half of either at most."""
        return (self.near >= MIN_NEAR) & (self.rho.mean(0) >= MIN_RHO)

    def cycles(self) -> np.ndarray:
        """Segments whose terms come back in step."""
        return (self.far >= MIN_FAR) & (self.peak >= MIN_PEAK)


def own_lines(lines: PageLines, furniture: np.ndarray) -> np.ndarray:
    """What is judged as the page's own: all but furniture, and what looks like a menu but is a heap of links, tags or words."""
    plain = (lines.function < LIST_FUNCTION) & (lines.n_words > 0)
    heap = plain & (lines.n_words >= MIN_LIST) & (lines.capitals < 0.6)
    # lines of few words in lower case, one after another: no menu is written so
    entry = plain & (lines.capitals < 0.3)
    if lines.n:
        run = np.cumsum(np.concatenate([[True], (entry[1:] != entry[:-1]) | (lines.page[1:] != lines.page[:-1])])) - 1
        heap |= entry & (np.bincount(run, weights=lines.n_words)[run] >= MIN_DISTINCT)
    links = (lines.links_at > 0) & (lines.n_words <= 5)
    return ~furniture | heap | links | (lines.count_of("#") >= 3)


def spam_words(lines: PageLines, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, Recurrence, np.ndarray]:
    """Of each page: words of its own text that are keywords, links or tags; words in sentences. And what that rests on."""
    n, w = lines.n_words, lines.words
    hashes_ = lines.count_of(r"#[\p{L}\p{N}_]+")
    link = own & (lines.links_at > 0) & (n <= 5)
    tag = own & ~link & (2 * hashes_ >= np.maximum(n, 1)) & (hashes_ > 0)
    text = own & ~link & ~tag & (n > 0) & lines.is_first
    # neighbouring lines without function words are one segment: a list may have one entry a line or all in one
    bare = text & (lines.function < LIST_FUNCTION)
    new = np.ones(lines.n, dtype=bool)
    at = np.flatnonzero(text)
    if len(at) > 1:
        new[at[1:]] = ~(bare[at[1:]] & bare[at[:-1]] & (lines.page[at[1:]] == lines.page[at[:-1]]))
    segment = np.cumsum(new & text) - 1
    segments = int(segment[-1]) + 1 if lines.n else 0
    page_of = np.zeros(segments, dtype=np.int64)
    page_of[segment[text]] = lines.page[text]
    inside = text[w.of] if len(w.of) else np.zeros(0, dtype=bool)
    of = w.of[inside]
    kind = w.code[inside]
    code = np.where(w.function[kind] | w.number[kind], -1, kind) if len(kind) else kind
    r = Recurrence(lines.page[of], segment[of], code, segments)
    total = lambda x: np.bincount(segment[text], weights=x[text], minlength=segments)
    words, function = total(n.astype(float)), total(lines.n_function)
    share = function / np.maximum(words, 1)
    sentences = total(((lines.ends == 1) & (n >= 8) & (lines.links == 0)).astype(float) * n)
    counted = total(((lines.mark > 0) & lines.has(r"^\S+\s+\d|^\d")).astype(float) * n)
    stuffed = (r.stuffed() | r.cycles() & (share < LIST_FUNCTION)) & (words >= MIN_LIST)
    # many distinct content words, no function word: a list of keywords, unless it is set in sentences (filler) or counts pieces
    listed = (share < LIST_FUNCTION) & (words >= MIN_DISTINCT) & (2 * sentences < words) & (2 * counted < words)
    spam = np.bincount(page_of, weights=words * (stuffed | listed), minlength=lines.pages).astype(float)
    spam += np.bincount(lines.page, weights=np.where(link, n + 2, 0) + np.where(tag, n, 0), minlength=lines.pages)
    real = np.bincount(page_of, weights=words * (~stuffed & (share >= SENTENCE_FUNCTION) & (words >= 6)), minlength=lines.pages)
    return spam, real, r, page_of


def filler_words(lines: PageLines, own: np.ndarray) -> np.ndarray:
    """Of each page, words in sentences that hold no function word of any language: set only to fill the page."""
    blank = own & (lines.n_words >= 8) & (lines.n_function == 0) & (lines.ends == 1) & (lines.links == 0) & lines.has(r"^\p{Lu}[^,;#|/:~+>•·]*$")
    return np.bincount(lines.page[blank], weights=lines.n_words[blank], minlength=lines.pages)


class Forms:
    """What aligns the lines of different records: their forms, with slots, names and numbers masked."""

    def __init__(self, lines: PageLines):
        signed = np.flatnonzero(lines.has(residue_lines.SIGN) & (lines.links_at == 0))
        self.held = np.zeros(lines.n, dtype=np.int8)
        held: list[str] = []
        if len(signed):
            masked, kinds, held = zip(*map(residue_lines.mask, lines.text.take(pa.array(signed)).to_pylist()))
            self.held[signed] = kinds
            put = np.zeros(lines.n, dtype=bool)
            put[signed] = True
            text = pc.replace_with_mask(lines.text, pa.array(put), pa.array(masked, pa.string()))
        else:
            text = lines.text
        form = lines.skeletons(text)
        self.form = hashes(form)
        varies = _flag(form, residue_lines.MASK)
        self.held[(self.held == residue_lines.FIXED) & varies] = residue_lines.FILLED
        # a value is what a slot holds, or the whole line where only names and numbers vary
        self.value = hashes(lines.text)
        if len(signed):
            self.value[signed] = np.where(np.array([bool(h) for h in held]), hashes(pa.array(held, pa.string())), self.value[signed])
        fixed = np.asarray(pc.match_substring_regex(form, r"\p{L}+" + r"\P{L}+\p{L}+" * (MIN_FIXED - 1)))
        # of so few fixed words no template can be told, unless a notation shows it
        self.held[(self.held <= residue_lines.UNFILLED) & ~fixed] = residue_lines.FIXED
        self.key = self._keys(lines, form)

    @staticmethod
    def _keys(lines: PageLines, form: pa.Array) -> np.ndarray:
        """The hash of each line's longest clause, which notices put together from parts share; 0 for quotations and code."""
        if not lines.n:
            return np.array([], dtype=np.int64)
        clauses = pc.split_pattern_regex(form, r"[.!?:;,()]\s|\s[–-]\s|[.!?:;)]$|\s\(")
        flat, of = clauses.flatten(), np.asarray(pc.list_parent_indices(clauses))
        flat = pc.utf8_trim(flat, characters=residue_lines.MASK + " .,!?:;()–-*•»")
        size = np.asarray(pc.utf8_length(flat))
        longest = np.lexsort((-size, of))
        longest = longest[np.searchsorted(of[longest], np.arange(lines.n))]
        best = flat.take(pa.array(longest))
        # without two words it is no clause: the line itself stands for it
        whole = pc.invert(pc.match_substring_regex(best, r"\p{L}\P{L}+\p{L}"))
        key = hashes(pc.if_else(whole, pc.utf8_lower(lines.text), best))
        key[key == 0] = 1
        key[_flag_any(lines.text, residue_lines.QUOTES.replace("'", "")) | lines.has(r"^\s*(?:render|print|echo|return|run|def|for|if|let|var|const)\b|[;{]$")] = 0
        return key


def _flag(texts: pa.Array, part: str) -> np.ndarray:
    return np.asarray(pc.match_substring(texts, part)).astype(bool)


def _flag_any(texts: pa.Array, signs: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(texts, "[" + signs + "]")).astype(bool)


def titles(lines: PageLines, titles_: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each page: whether its title shows residue; the hash of the title's head, 0 without one; whether the page tells nothing of it.

    The page tells of its title if more than half of the head's words of weight stand in a line or in the path.
    """
    heads = [residue_lines.title_head(t, set(x)) if t else "" for t, x in zip(titles_, lines.labels)]
    kinds = [residue_lines.title_kind(t, h) for t, h in zip(titles_, heads)]
    w, v = lines.words, len(lines.words.vocabulary) + 1
    head = Words(pa.array(heads, pa.string()))
    path = Words(pc.replace_substring_regex(lines.urls, r"^[^/]*//[^/]*", ""))
    width = len(path.vocabulary) + 1
    in_path = path.codes_of(head.vocabulary)[head.code] if len(head.code) else head.code
    here = is_in(head.of * width + in_path, path.of * width + path.code) & (in_path >= 0)
    code = w.codes_of(head.vocabulary)[head.code] if len(head.code) else head.code
    asked, of_word = head.of * v + code, lines.page[w.of] * v + w.code
    met = is_in(of_word, asked[code >= 0])  # of all words the few that a title asks for
    told = is_in(asked, of_word[met]) & (code >= 0)
    weight = ~head.function[head.code] if len(head.code) else np.zeros(0, dtype=bool)
    bare = np.bincount(head.of[weight], minlength=lines.pages) == 0  # function words only: all of them count
    weight |= bare[head.of]
    size = np.bincount(head.of[weight], minlength=lines.pages)
    apart = 2 * np.bincount(head.of[weight & (here | told)], minlength=lines.pages) <= size
    said = met & lines.long[w.of]  # a page about such words has them in its sentences
    spoken = is_in(asked, of_word[said]) & (code >= 0)
    whole = np.bincount(head.of[spoken], minlength=lines.pages) == np.bincount(head.of, minlength=lines.pages)
    shows = np.array([k is not None and not (doubtful and whole[i]) for i, (k, doubtful) in enumerate(kinds)], dtype=bool)
    return shows, np.where(size > 0, hashes(pc.utf8_lower(pa.array(heads, pa.string()))), 0), apart & (size > 0)


class Judge:
    """Reads one run of pages after another."""

    def __init__(self, alone: blocks.Committee, whole: blocks.Committee | None = None):
        self.alone, self.whole = alone, whole

    def spam(self, contents: pa.Array, titles_: pa.Array, urls: pa.Array) -> np.ndarray:
        lines = PageLines(contents, titles_, urls)
        own = own_lines(lines, self.alone.furniture(self.alone.bins(lines.features())))
        spam, real, *_ = spam_words(lines, own)
        return _is_spam(spam, real)

    def pages(self, contents: pa.Array, titles_: pa.Array, urls: pa.Array, sites: np.ndarray) -> dict[str, pa.Array]:
        lines = PageLines(contents, titles_, urls)
        features = lines.features()
        odds = self.alone.odds(self.alone.bins(features))
        own = own_lines(lines, odds >= self.alone.bar)
        spam, real, *_ = spam_words(lines, own)
        is_spam = _is_spam(spam, real)
        short = (real < REAL_WORDS) & ~is_spam
        forms = Forms(lines)
        per_page = lambda x: np.bincount(lines.page[x], minlength=lines.pages) > 0
        shows, head, apart = titles(lines, lines.titles.to_pylist())
        blank = filler_words(lines, own)
        written = np.bincount(lines.page[own], weights=lines.n_words[own], minlength=lines.pages)
        filler = short & (blank >= 8) & (2 * blank > written)
        doubted = np.flatnonzero(short[lines.page] & (lines.links_at == 0))
        stated = np.zeros(lines.n, dtype=bool)
        stated[doubted] = [residue_lines.kind(x) is not None for x in lines.text.take(pa.array(doubted)).to_pylist()]

        def listed(column: np.ndarray, keep: np.ndarray) -> pa.ListArray:
            ends = np.cumsum(np.bincount(lines.page[keep], minlength=lines.pages))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(column[keep]))

        varies = forms.held >= residue_lines.FILLED
        out = {
            "spam": pa.array(is_spam),
            "residue": pa.array(shows | per_page(forms.held == residue_lines.KNOWN) | filler | per_page(stated)),
            "short": pa.array(short),
            "head": pa.array(head),
            "apart": pa.array(apart),
            "keys": listed(forms.key, lines.is_first & (forms.key != 0) & ~is_spam[lines.page]),
            "forms": listed(forms.form, varies),
            "held": listed(np.where(forms.held >= residue_lines.UNFILLED, 1, 0).astype(np.int8), varies),
            "values": listed(forms.value, varies),
        }
        if self.whole is not None:
            everything = np.ones(lines.n, dtype=bool)
            out["no"] = listed(lines.line_no, everything)
            # one number for a form in a site
            out["of_site"] = listed(forms.form ^ (sites[lines.page] * np.int64(-7046029254386353131)), everything)
            out["odds"] = listed(np.rint(100 * odds).astype(np.int8), everything)
            width = features.shape[1]
            begins = np.concatenate([[0], np.cumsum(lines.count)]).astype(np.int32) * width
            bins = self.whole.bins(features)
            out["bins"] = pa.Array.from_buffers(pa.binary(), lines.pages, [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(bins.tobytes())])
        else:
            out |= {"no": pa.nulls(lines.pages, pa.list_(pa.int32())), "of_site": pa.nulls(lines.pages, pa.list_(pa.int64())), "odds": pa.nulls(lines.pages, pa.list_(pa.int8())), "bins": pa.nulls(lines.pages, pa.binary())}
        return out


def _is_spam(spam: np.ndarray, real: np.ndarray) -> np.ndarray:
    return (spam >= np.where(real > 0, MIN_SPAM_WORDS, MIN_BARE_SPAM)) & (spam > real)


#: Pages judged at once: few enough to stay small, enough to pay for what each run costs.
RUN, RUN_BYTES = 1500, 1 << 25
JUDGED = "spam boolean, residue boolean, short boolean, head bigint, apart boolean, keys array<bigint>, forms array<bigint>, held array<tinyint>, values array<bigint>, no array<int>, of_site array<bigint>, odds array<tinyint>, bins binary"


def runs(batches: Iterator[pa.RecordBatch], content: int) -> Iterator[pa.RecordBatch]:
    """The pages in runs of at most ``RUN``, and of ``RUN_BYTES`` of text unless a single page has more. ``content`` is the number of its column."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(content)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = min(at + RUN, max(at + 1, int(np.searchsorted(size, before + RUN_BYTES, "right"))))
            yield batch.slice(at, end - at)
            at = end


def _source(pages: DataFrame) -> DataFrame:
    """Pages with their external id and site as hashes; a page without external id is one of its own."""
    ext = F.xxhash64(F.coalesce(F.col("external_id").cast("string"), F.concat(F.lit("doc:"), F.col("doc_id"))))
    return pages.select("doc_id", ext.alias("ext"), F.xxhash64(F.coalesce(site_of("url"), F.lit(""))).alias("site"), "content", "title", "url")


def judge_pages(pages: DataFrame, bins: bool = False) -> DataFrame:
    """``doc_id, ext, site`` and ``JUDGED``, one row per row of ``pages``: what the page alone tells. Null content is a page without lines.

    ``keys`` are the clauses of the page; ``forms, held, values`` its lines with something that varies, whether that is an
    open slot, and what stands there. With ``bins`` each line has its number, its form within the site, its odds (in
    hundredths) and its features, one byte each. ``pages`` needs doc_id, external_id, url, title and content; further columns are not read.
    """
    kind = dict(pages.dtypes)["doc_id"]
    models = pages.sparkSession.sparkContext.broadcast(blocks.classifiers())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, whole = models.value
        judge = Judge(alone, whole if bins else None)
        for batch in runs(batches, 3):
            got = judge.pages(batch.column(3), batch.column(4), batch.column(5), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *got.values()], names=["doc_id", "ext", "site", *got])

    return _source(pages).mapInArrow(run, f"doc_id {kind}, ext bigint, site bigint, {JUDGED}")


def spam_flags(pages: DataFrame) -> DataFrame:
    """``doc_id, spam``, one row per row of ``pages``."""
    kind = dict(pages.dtypes)["doc_id"]
    models = pages.sparkSession.sparkContext.broadcast(blocks.classifiers()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(models.value)
        for batch in runs(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judge.spam(batch.column(1), batch.column(2), batch.column(3)))], names=["doc_id", "spam"])

    return pages.select("doc_id", "content", "title", "url").mapInArrow(run, f"doc_id {kind}, spam boolean")
