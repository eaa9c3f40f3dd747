"""The lines of a batch of pages as flat arrays: blocks, their words, and what stands around them.

Everything is computed for a whole Arrow batch at once: lines and words are flat arrays with the number of the page or
line they belong to, so a batch costs a few dozen vector operations and no Python step per word. A line is a block.
Nothing here depends on a list of phrases: what is counted are words, function words, capitals, numbers, separators,
places, and words shared with other lines, the title, the path or the host.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.core import algorithms

from lexspark.functions.text import STOPWORDS

#: Words without which sentences can hardly be built, English and some other languages.
FUNCTION = (STOPWORDS - {"me", "more", "most", "off", "own", "up", "s", "t", "d", "m", "re", "ve", "ll", "below", "above", "against"}) | {
    *"der die das den dem ein eine und ist nicht mit von zu im auf für sich auch es wir sie als wie aber bei nach".split(),
    *"le la les un une des et est dans que qui pour pas sur avec ce il elle nous vous au du de en par plus".split(),
    *"el los las una y es no con por para su se que lo al del como pero más".split(),
    *"in ad cum non est et sed ut qui quae hoc".split(),
}
URL = r"https?://\S+|www\.\S+"
SEPARATOR = r"\s[|·•/>»~+]\s|\t|\s{3,}|[|·•»~]"
#: White space that is no ASCII: one blank, so that what follows is told alike with and without it.
SPACES = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A sentence of prose has so many words at least.
LONG = 12

FEATURES = (
    "words", "links", "ends", "mark", "capitals", "digits", "function", "colon", "quoted", "words before", "words after", "links before", "links after", "function before", "function after", "mark before", "mark after",
    "from top", "from end", "text above", "text below", "within text", "run of short", "shared name", "named", "is title", "site name", "same before", "alike around", "mail or year", "page links", "first words",
)


def host_labels(url: str | None) -> list[str]:
    """The labels of the host that may name the site."""
    if not url:
        return []
    host = re.sub(r"^[a-z][a-z0-9+.\-]*://", "", url.strip().lower()).split("/")[0].split(":")[0]
    return [p for p in host.split(".")[:-1] if len(p) > 3]


def _np(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _one(x) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def is_in(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among ``values``, by a hash table of these."""
    return algorithms.isin(x, values) if len(x) else np.zeros(0, dtype=bool)


class Words:
    """The words of a text array: ``of`` the text each belongs to, ``code`` of its lowercase form, flags per word."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(texts, r"[^\p{L}\p{N}]+")
        flat, of = lists.flatten(), _np(pc.list_parent_indices(lists))
        keep = pc.greater(pc.binary_length(flat), 0)
        self.of = of[_np(keep)]
        coded = flat.filter(keep).dictionary_encode()
        forms = coded.dictionary
        low = pc.utf8_lower(forms).dictionary_encode()
        self.vocabulary: pa.Array = low.dictionary
        raw = _np(coded.indices)
        self.code = _np(low.indices)[raw].astype(np.int64) if len(raw) else np.array([], dtype=np.int64)
        self.capital = _np(pc.match_substring_regex(forms, r"^\p{Lu}"))[raw] if len(raw) else np.array([], dtype=bool)
        self.number = _np(pc.match_substring_regex(self.vocabulary, r"^\p{N}+$"))
        self.function = _np(pc.is_in(self.vocabulary, value_set=pa.array(sorted(FUNCTION))))
        self.size = _np(pc.utf8_length(self.vocabulary))
        self.lists = lists

    def codes_of(self, words: pa.Array) -> np.ndarray:
        """The codes of lowercase words, -1 for one that does not occur."""
        got = pc.index_in(words, value_set=self.vocabulary)
        return _np(pc.fill_null(got, -1)).astype(np.int64)


class PageLines:
    """All lines of a batch that are not blank. ``line_no`` counts the pieces between LFs from 1, blank ones included."""

    def __init__(self, contents: pa.Array, titles: pa.Array, urls: pa.Array):
        contents = pc.fill_null(_one(contents), "")
        self.pages = len(contents)
        lists = pc.split_pattern(contents, "\n")
        page = _np(pc.list_parent_indices(lists))
        begin = np.zeros(self.pages + 1, dtype=np.int64)
        np.cumsum(np.bincount(page, minlength=self.pages), out=begin[1:])
        no = np.arange(len(page)) - begin[page] + 1
        text = pc.utf8_trim_whitespace(pc.replace_substring_regex(lists.flatten(), SPACES, " "))
        keep = pc.greater(pc.binary_length(text), 0)
        mask = _np(keep)
        self.text, self.page, self.line_no = text.filter(keep), page[mask], no[mask].astype(np.int32)
        self.titles, self.urls = pc.fill_null(_one(titles), ""), pc.fill_null(_one(urls), "")
        self.labels = [host_labels(u) for u in self.urls.to_pylist()]
        n = self.n = len(self.page)
        self.first = np.searchsorted(self.page, np.arange(self.pages))  # of each page, its first line
        self.count = np.bincount(self.page, minlength=self.pages) if n else np.zeros(self.pages, dtype=np.int64)
        # lines that a page repeats word for word are told by the first of them
        self.low = pc.utf8_lower(self.text)
        seen = _np(self.low.dictionary_encode().indices).astype(np.int64) if n else np.array([], dtype=np.int64)
        pairs = self.page.astype(np.int64) * (seen.max(initial=0) + 1) + seen
        self.is_first = ~pd.Series(pairs).duplicated().to_numpy()
        back = pd.factorize(pairs)[0]
        self.times = np.bincount(back)[back] if n else np.array([], dtype=np.int64)
        self._lexical()

    def count_of(self, pattern: str) -> np.ndarray:
        return _np(pc.count_substring_regex(self.text, pattern)).astype(np.int64)

    def has(self, pattern: str) -> np.ndarray:
        return _np(pc.match_substring_regex(self.text, pattern)).astype(bool)

    def _lexical(self) -> None:
        n = self.n
        self.links_at = self.count_of(URL)
        body = pc.replace_substring_regex(self.text, URL, " ") if self.links_at.any() else self.text
        # "1. " and the like are marks, not words
        self.mark = np.where(self.has(r"^[-*•–]\s"), 1, np.where(self.has(r"^\d{1,2}[.)]\s"), 2, np.where(self.has(r"^[»>]\s"), 3, 0)))
        body = pc.replace_substring_regex(body, r"^(?:[-*•–»>]|\d{1,2}[.)])\s+", "")
        self.body = body
        w = self.words = Words(body)
        sums = lambda x: np.bincount(w.of, weights=x, minlength=n) if n else np.array([])
        self.n_words = np.bincount(w.of, minlength=n) if n else np.array([], dtype=np.int64)
        per = np.maximum(self.n_words, 1)
        self.n_function = sums(w.function[w.code])
        self.function = self.n_function / per
        self.capitals = sums(w.capital) / per
        self.numbers = sums(w.number[w.code])
        glue = _np(pc.count_substring_regex(body, SEPARATOR)) + self.links_at
        self.links = glue / np.maximum(glue + self.n_words, 1)
        self.ends = np.where(self.has(r"[.!?…]$"), 1, np.where(self.has(r"[\"”»)]$"), 2, 0))
        self.long = (self.n_words >= LONG) & (self.ends > 0) & (self.links < 0.2) & (self.function >= 0.12)

    def _around(self, x: np.ndarray, step: int, none: float) -> np.ndarray:
        """The value of the line ``step`` places on (or back) within the page."""
        out = np.full(self.n, none, dtype=float)
        if step > 0:
            same = self.page[step:] == self.page[:-step]
            out[:-step][same] = x[step:][same]
        else:
            k = -step
            same = self.page[k:] == self.page[:-k]
            out[k:][same] = x[:-k][same]
        return out

    def _before(self, x: np.ndarray) -> np.ndarray:
        """Sum of ``x`` over the lines of the page before each line."""
        total = np.cumsum(x) - x
        return total - total[self.first[self.page]]

    def _names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each line: in how many lines of its page its commonest name stands; whether a word of weight stands in title or path; share of the title's words."""
        w, n = self.words, self.n
        v = max(len(w.vocabulary), 1)
        name = w.capital & (w.size[w.code] > 3) & ~w.function[w.code] if n else np.array([], dtype=bool)
        shared, named, title = np.zeros(n), np.zeros(n), np.zeros(n)
        if name.any():
            pairs = pd.unique(w.of[name] * v + w.code[name])  # a name counts once a line
            of, code = pairs // v, pairs % v
            back, keys = pd.factorize(self.page[of] * v + code)
            times = np.bincount(back)[back]
            # the lines' words stand in their order, so the names of a line stand together
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            shared[of[starts]] = np.maximum.reduceat(times, starts)
        if n:
            path = pc.replace_substring_regex(self.urls, r"^[^/]*//[^/]*", "")
            only, head = Words(self.titles), Words(pc.binary_join_element_wise(self.titles, path, " "))
            of_word = self.page[w.of] * v + w.code
            heads = [(x, w.codes_of(x.vocabulary)[x.code]) for x in (head, only)]
            told, of_title = (x.of[c >= 0] * v + c[c >= 0] for x, c in heads)
            hit = np.flatnonzero(is_in(of_word, pd.unique(told)))  # few words: the title's are among them
            kind = w.code[hit]
            weight = (w.size[kind] > 3) & ~w.function[kind]
            named[w.of[hit[weight]]] = 1
            hit = hit[is_in(of_word[hit], pd.unique(of_title))]
            size = np.bincount(only.of, minlength=self.pages)[self.page]
            title = np.bincount(w.of[hit], minlength=n) / np.maximum(np.maximum(size, self.n_words), 1)
        return shared, named, title

    def _site_name(self) -> np.ndarray:
        squeezed = pc.replace_substring(self.low, " ", "").to_pylist()
        out = np.zeros(self.n)
        at = 0
        for names, k in zip(self.labels, self.count.tolist()):
            for name in names:
                for i in range(at, at + k):
                    if name in squeezed[i]:
                        out[i] = 1
            at += k
        return out

    def features(self) -> np.ndarray:
        """One row per line, columns as in ``FEATURES``."""
        n = self.n
        if not n:
            return np.zeros((0, len(FEATURES)))
        words = np.minimum(self.n_words, 60).astype(float)
        shared, named, title = self._names()
        place = np.arange(n) - self.first[self.page]
        above = self._before(self.long.astype(float))
        total = np.bincount(self.page, weights=self.long, minlength=self.pages)[self.page]
        below = total - above - self.long
        # lines since the last long one, or since the top
        at = np.arange(n)
        last = np.maximum.accumulate(np.where(self.long, at, -1))
        run = np.where(self.long, 0, at - np.maximum(last, self.first[self.page] - 1))
        short = (self.n_words <= 4).astype(float)
        page_links = np.bincount(self.page, weights=self.links_at > 0, minlength=self.pages)[self.page] / np.maximum(self.count[self.page], 1)
        text = self.text
        columns = [
            words, self.links, self.ends, self.mark, self.capitals, self.numbers / (self.n_words + 1), self.function, self.has(r":$"), self.has("^[\"“„«]"),
            self._around(words, -1, -1), self._around(words, 1, -1), self._around(self.links, -1, -1), self._around(self.links, 1, -1), self._around(self.function, -1, -1), self._around(self.function, 1, -1), self._around(self.mark, -1, -1), self._around(self.mark, 1, -1),
            np.minimum(place, 40), np.minimum(self.count[self.page] - 1 - place, 40), np.minimum(above, 9), np.minimum(below, 9), (above > 0) & (below > 0), np.minimum(run, 20), np.minimum(shared, 5), named, title, self._site_name(),
            np.minimum(self.times, 3), self._around(short, -1, 0) + self._around(short, 1, 0) + self._around(short, -2, 0) + self._around(short, 2, 0),
            _np(pc.match_substring_regex(text, r"\b(?:1[89]|2[01])\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\S@\S|©")), page_links, np.bincount(self.words.of, weights=self.words.capital, minlength=n) >= self.n_words,
        ]
        return np.column_stack([np.asarray(c, dtype=float) for c in columns])

    def skeletons(self, text: pa.Array | None = None) -> pa.Array:
        """Each line (or ``text`` in its place) with what varies between records masked: names, numbers and links; lowercased, white space run together."""
        shouts = self.has(r"\p{Lu}.*\p{Lu}") & ~self.has(r"\p{Ll}")
        text = self.text if text is None else text
        if shouts.any():  # a line all in capitals holds no names that could be told
            text = pc.if_else(pa.array(shouts), pc.utf8_lower(text), text)
        text = pc.replace_substring_regex(text, URL + r"|\p{Lu}[\p{L}\p{N}'’]*|\p{N}+(?:[.,:]\p{N}+)*", "\x01")
        text = pc.replace_substring_regex(text, r"\x01(?:[\s\x01]*\x01)+", "\x01")
        return pc.replace_substring_regex(pc.utf8_lower(text), r"\s{2,}|[\t\r\f\v]", " ")


def hashes(texts: pa.Array) -> np.ndarray:
    """64 bits of each text, the same in every process."""
    if not len(texts):
        return np.array([], dtype=np.int64)
    return pd.util.hash_array(_np(texts).astype(object), categorize=False).view(np.int64)
