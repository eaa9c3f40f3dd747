"""Problem 10: the reading level of English documents, by surprisal under graded n-gram models.

One interpolated trigram model is trained for each level on a bounded sample of labelled documents; its weights are
estimated on documents held out. The surprisal of every sentence under the three models tells how likely it is of each
level, hence where it stands between the lowest (0) and the highest (2). The distribution of these values over a whole
document - the values at its quantiles, by words - is mapped to graded difficulty by isotonic regression, fitted on
labelled documents that were held out of the models (cross-fitting).

What is trained: the models (at most ``max_labelled`` labelled documents, chosen by a hash of their id), and
the English vocabulary (at most ``max_language`` documents, chosen so, told apart by their ``lang``). Their
size is bounded by these parameters; they are broadcast, and all documents are scored. Evaluation items are read in blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.leakage import item_texts

LEVELS = ("basic", "middle", "advanced")
MIN_WORDS = 40
MAX_LABELLED, MAX_LANGUAGE = 2000, 1500
#: Interpolation of trigram, bigram, unigram and uniform estimates before it is estimated, and rounds of its estimation.
WEIGHTS = (0.45, 0.3, 0.2, 0.05)
ROUNDS = 8
#: Parts of the labelled sample that are held out in turn.
FOLDS = 4
#: Quantiles of a document's distribution that are read; their mean is mapped to a level. The middle one is the level of most of the text.
QUANTILES = (0.5,)
#: So many words in a row out of an evaluation item are a passage of it.
PASSAGE_WORDS = 8
#: Share of a document's words that must be English.
ENGLISH_SHARE = 0.5

TOKEN = re.compile(r"[^\W_]+|[.!?](?=\s)|\n")
WORD = re.compile(r"[^\W_]+")
BREAKS = (".", "!", "?", "\n")


def plain(text: str) -> str:
    """Lowercased, accents taken off."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The monotone step function nearest to ``y`` over ``x``: pool adjacent violators. Knots and values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for i in order:
        blocks.append([float(y[i]), float(w[i]), float(x[i]), float(x[i])])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, v, _, last = blocks.pop()
            b = blocks[-1]
            b[0] = (b[0] * b[1] + m * v) / (b[1] + v)
            b[1] += v
            b[3] = last
    knots = [k for b in blocks for k in (b[2], b[3])]
    return np.array(knots), np.array([b[0] for b in blocks for _ in range(2)])


class Passages:
    """The runs of PASSAGE_WORDS words of a block of evaluation items, as hashes over a numbering of its words."""

    def __init__(self, items: list[list[str]]):
        self.code: dict[str, int] = {}
        rolled = [_roll(np.array([self.code.setdefault(w, len(self.code) + 1) for w in words], dtype=np.uint64)) for words in items]
        self.known = np.unique(np.concatenate(rolled)) if rolled else np.array([], dtype=np.uint64)

    def covered(self, words: list[str], text: np.ndarray) -> np.ndarray:
        """Which of the words lie within such a run, of one text."""
        n = len(words)
        if not len(self.known) or n < PASSAGE_WORDS:
            return np.zeros(n, dtype=bool)
        get = self.code.get
        rolled = _roll(np.array([get(w, 0) for w in words], dtype=np.uint64))
        hit = np.searchsorted(self.known, rolled)
        hit[hit == len(self.known)] = 0
        hits = np.flatnonzero((self.known[hit] == rolled) & (text[: len(rolled)] == text[PASSAGE_WORDS - 1 :]))
        change = np.zeros(n + 1)
        np.add.at(change, hits, 1)
        np.add.at(change, hits + PASSAGE_WORDS, -1)
        return np.cumsum(change)[:n] > 0


def _roll(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of PASSAGE_WORDS codes."""
    n = len(codes) - PASSAGE_WORDS + 1
    if n <= 0:
        return np.array([], dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(PASSAGE_WORDS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


class Model:
    """Graded n-gram models and the English vocabulary, over one numbering of words.

    Codes: -1 a sentence break, 0 an unknown word, 1..V a word of the models.
    """

    def __init__(self, labelled: list[tuple[str, int]], language: list[tuple[str, bool]]):
        seen: Counter = Counter()
        for text, _ in labelled:
            seen.update(set(WORD.findall(plain(text))))
        words = [w for w, k in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if k >= 2 and not w.isdigit()]
        self.code = {w: i + 1 for i, w in enumerate(words)}
        self.size = len(self.code) + 1
        self.english = self._english(language, words)
        self.code.update(dict.fromkeys(BREAKS, -1))
        self.is_english = np.zeros(len(self.code) + 2, dtype=bool)
        for w, i in self.code.items():
            if i > 0 and w in self.english:
                self.is_english[i] = True
        self._fit(labelled)

    def _english(self, language: list[tuple[str, bool]], extra: list[str]) -> set[str]:
        """Words that English documents use at a much higher rate than the others; these words get codes as well."""
        counts = (Counter(), Counter())
        for text, english in language:
            counts[english].update(set(WORD.findall(plain(text))))
        n = [max(1, sum(1 for _, e in language if e == k)) for k in (False, True)]
        out = {w for w, k in counts[True].items() if not w.isdigit() and k / n[1] > 2 * counts[False][w] / n[0] and (k >= 2 or w in self.code)}
        if not out:  # no language known: the words of the labelled documents
            out = set(extra)
        for w in sorted(out):
            self.code.setdefault(w, len(self.code) + 1)
        return out

    def tokens(self, texts: list[str], passages: Sequence[Passages] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts, each closed by a break; the text each belongs to; whether it lies within a passage of an item."""
        get = self.code.get
        parts: list[int] = []
        words: list[str] = []
        lengths = []
        for t in texts:
            found = TOKEN.findall(plain(t))
            codes = [get(w, 0) for w in found]
            parts += codes
            parts.append(-1)
            if passages:
                words += [w for w, c in zip(found, codes) if c >= 0]
            lengths.append(len(codes) + 1)
        codes, text = np.array(parts, dtype=np.int64), np.repeat(np.arange(len(texts)), lengths)
        leaked = np.zeros(len(codes), dtype=bool)
        at = np.flatnonzero(codes >= 0)
        for p in passages:
            leaked[at] |= p.covered(words, text[at])
        return codes, text, leaked

    def _grams(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of words; their unigram, bigram and trigram keys. A break is a context like a word."""
        w = np.where(codes < 0, self.size, np.where(codes < self.size, codes, 0))
        prev = np.concatenate([[self.size], w[:-1]])
        prev2 = np.concatenate([[self.size, self.size], w[:-2]]) if len(w) > 1 else np.full(len(w), self.size)
        prev2 = np.where(prev == self.size, self.size, prev2)
        at = np.flatnonzero(codes >= 0)
        base = self.size + 1
        return at, w[at], prev[at] * base + w[at], (prev2[at] * base + prev[at]) * base + w[at]

    def _train(self, codes: np.ndarray, level: np.ndarray) -> None:
        """Relative frequencies of each level (columns), for every n-gram of any level (rows)."""
        at, uni, bi, tri = self._grams(codes)
        lev = level[at]
        base, k = self.size + 1, len(LEVELS)
        count = np.zeros((self.size, k))
        np.add.at(count, (uni, lev), 1)
        self.uni = count / np.maximum(1, count.sum(0))
        self.tables = []
        for keys in (bi, tri):
            known, row = np.unique(keys, return_inverse=True)
            count = np.zeros((len(known) + 1, k))
            np.add.at(count, (row, lev), 1)
            contexts, of = np.unique(known // base, return_inverse=True)
            total = np.zeros((len(contexts), k))
            np.add.at(total, of, count[:-1])
            count[:-1] /= np.maximum(1, total[of])
            self.tables.append((known, count))

    def _parts(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions of words; their estimates by trigram, bigram, unigram and at random."""
        at, uni, bi, tri = self._grams(codes)
        parts = []
        for keys, (known, values) in zip((bi, tri), self.tables):
            if not len(known):
                parts.append(np.zeros((len(at), len(LEVELS))))
                continue
            row = np.searchsorted(known, keys)
            row[row == len(known)] = 0
            parts.append(values[np.where(known[row] == keys, row, len(known))])
        return at, [parts[1], parts[0], self.uni[uni], np.full((len(at), len(LEVELS)), 1 / self.size)]

    def _log_likelihood(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, parts = self._parts(codes)
        return at, np.log(sum(w * p for w, p in zip(self.weights, parts)))

    def _estimate(self, codes: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The weights that make held-out text likeliest under its own level, by expectation maximization."""
        at, parts = self._parts(codes)
        own = np.array([p[np.arange(len(at)), level[at]] for p in parts])
        weights = np.array(WEIGHTS)
        for _ in range(ROUNDS if len(at) else 0):
            share = own * weights[:, None]
            weights = (share / share.sum(0)).mean(1)
        return np.maximum(weights, 1e-4) / np.maximum(weights, 1e-4).sum()

    def sentences(self, codes: np.ndarray, text: np.ndarray, leaked: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of every sentence: its text, place between the levels, words, words out of passages, English words."""
        at, ll = self._log_likelihood(codes)
        sentence = np.cumsum(codes < 0)[at]
        starts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(at) else np.array([], dtype=int)
        if not len(starts):
            return {k: np.array([]) for k in ("text", "x", "words", "leaked", "english", "level")}
        words = np.diff(np.append(starts, len(at)))
        sums = np.add.reduceat(ll, starts, axis=0)
        p = np.exp(sums - sums.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        leaked = np.add.reduceat((leaked[at] if leaked is not None else np.zeros(len(at))).astype(np.int64), starts)
        english = np.add.reduceat(self.is_english[codes[at]].astype(np.int64), starts)
        return {"text": text[at][starts], "x": p @ np.arange(len(LEVELS)), "words": words, "leaked": leaked, "english": english, "level": p.argmax(1), "start": at[starts]}

    def _learn(self, codes: np.ndarray, text: np.ndarray, labels: np.ndarray) -> None:
        """The models of texts with labels. A text has sentences of other levels too: each joins the model that fits it best."""
        self._train(codes, labels[text])
        sentence = np.cumsum(codes < 0)
        for _ in range(3):
            s = self.sentences(codes, text)
            if not len(s["text"]):
                break
            of = np.zeros(sentence.max() + 1, dtype=np.int64)
            of[sentence[s["start"]]] = s["level"]
            self._train(codes, of[sentence])

    def _fit(self, labelled: list[tuple[str, int]]) -> None:
        self.weights = np.array(WEIGHTS)
        codes, text, _ = self.tokens([t for t, _ in labelled])
        labels = np.array([y for _, y in labelled], dtype=np.int64)
        self.knots, self.values = np.array([0.0, 2.0]), np.array([0.0, 2.0])
        folds = np.arange(len(labelled)) % FOLDS
        if len(labelled) >= 2 * FOLDS and len(set(labels)) > 1:
            x, seen, weights = [], [], []
            for k in range(FOLDS):  # each part is judged by models that have not seen it
                held = folds[text] == k
                self.weights = np.array(WEIGHTS)
                self._learn(codes[~held], text[~held], labels)
                weights.append(self._estimate(codes[held], labels[text]))
                self.weights = weights[-1]
                place, known = self.places(self.sentences(codes[held], text[held]), len(labelled))
                x.append(place[known])
                seen.append(np.flatnonzero(known))
            x, seen = np.concatenate(x), np.concatenate(seen)
            if len(x):
                self.knots, self.values = isotonic(x, labels[seen].astype(float), np.ones(len(x)))
            self.weights = np.mean(weights, axis=0)
        self._learn(codes, text, labels)

    @staticmethod
    def places(s: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each of ``n`` texts stands between the levels, by its own sentences; and which have words at all."""
        place, known = np.ones(n), np.zeros(n, dtype=bool)
        if len(s["text"]):
            own = np.where(s["english"] >= ENGLISH_SHARE * s["words"] / 2, s["words"] - s["leaked"], 0)
            for weight in (s["words"], own):  # sentences of items and of other languages count only where there is nothing else
                use = weight > 0
                q = _quantiles(s["text"][use].astype(int), s["x"][use], weight[use], n)
                has = np.bincount(s["text"][use].astype(int), minlength=n) > 0
                place[has], known[has] = q[has], True
        return place, known

    def levels(self, texts: list[str], passages: Sequence[Passages] = ()) -> list[int | None]:
        """The level of each text, None where it is not English or has no words. Passages of items do not count."""
        s = self.sentences(*self.tokens(texts, passages))
        n = len(texts)
        out: list[int | None] = [None] * n
        if not len(s["text"]):
            return out
        at = s["text"].astype(int)
        words, english = np.bincount(at, s["words"], n), np.bincount(at, s["english"], n)
        place, _ = self.places(s, n)
        graded = np.clip(np.rint(np.interp(place, self.knots, self.values)), 0, len(LEVELS) - 1).astype(int)
        for i in np.flatnonzero((words > 0) & (english >= ENGLISH_SHARE * words)):
            out[i] = int(graded[i])
        return out


def _quantiles(of: np.ndarray, x: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Of each text the mean of ``x`` at ``QUANTILES`` of its words."""
    order = np.lexsort((x, of))
    of, x, w = of[order], x[order], w[order].astype(float)
    total = np.bincount(of, w, n)
    below = np.cumsum(w) - w
    first = np.searchsorted(of, np.arange(n))
    below -= np.concatenate([below, [0.0]])[np.minimum(first, len(below))][of] if len(of) else 0
    out = np.zeros(n)
    for q in QUANTILES:
        goal = q * total[of]
        hit = (below < goal) & (below + w >= goal)
        out[of[hit]] += x[hit]
    return out / len(QUANTILES)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_language: int = MAX_LANGUAGE) -> Model:
    """The models, from bounded samples.

    Labels are trimmed and lowercased, unknown ones left out, rows given twice count once; a document has the
    level most raters gave it, and none where they are split evenly.
    """
    spark = docs.sparkSession
    level = F.lower(F.trim("read_level"))
    votes = labels.select("doc_id", "rater", level.alias("level")).where(F.col("level").isin(*LEVELS) & F.col("doc_id").isNotNull()).distinct()
    votes = votes.groupBy("doc_id").pivot("level", list(LEVELS)).agg(F.count(F.lit(1))).na.fill(0)
    top = F.greatest(*LEVELS)
    sole = sum((F.col(k) == top).cast("int") for k in LEVELS) == 1
    picked = votes.where(sole).select("doc_id", F.coalesce(*[F.when(F.col(k) == top, i) for i, k in enumerate(LEVELS)]).alias("y"))
    picked = [(r[0], r[1], None) for r in picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()]
    spoken = docs.where("doc_id is not null and lang is not null").select("doc_id", F.lower(F.trim("lang")).alias("l"))
    spoken = spoken.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(max_language).collect()
    picked += [(r[0], None, r[1][:2] == "en") for r in spoken]
    if not picked:
        return Model([], [])
    ids = F.broadcast(spark.createDataFrame(picked, "doc_id bigint, y int, english boolean"))  # at most max_labelled + max_language rows
    rows = docs.where("text is not null").select("doc_id", "text").join(ids, "doc_id").orderBy("doc_id").collect()
    labelled = [(r["text"], r["y"]) for r in rows if r["y"] is not None]
    return Model(labelled, [(r["text"], r["english"]) for r in rows if r["english"] is not None])


def reading_levels(docs: DataFrame, model: Model, items: DataFrame | None = None, min_words: int = MIN_WORDS, batch: int = 1000) -> DataFrame:
    """``doc_id, read_level`` of the English documents of at least ``min_words`` words.

    Null, empty and short texts, and texts that are not English (other languages, code, numbers, symbols),
    give no row, whatever ``lang`` says. A row of ``docs`` gives at most one row. Passages of ``items`` do not count; all
    items are read, in blocks of bounded size, each of them broadcast.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    blocks = [context.broadcast(Passages([_spoken(t) for _, t in block])) for block in item_texts(items)] if items is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, passages = shared.value, [b.value for b in blocks]
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1)
            at, level = [], []
            for lo in range(0, rows.num_rows, batch):
                some = texts.slice(lo, batch).to_pylist()
                fit = [i for i, t in enumerate(some) if t and len(t) >= 2 * min_words - 1 and len(WORD.findall(t)) >= min_words]
                for i, k in zip(fit, model.levels([some[i] for i in fit], passages)):
                    if k is not None:
                        at.append(lo + i)
                        level.append(LEVELS[k])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(level, pa.string())], names=["doc_id", "read_level"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, read_level string")


def _spoken(text: str) -> list[str]:
    return WORD.findall(plain(text))
