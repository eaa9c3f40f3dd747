"""Problem 2: flat text blocks, told apart by decision trees.

A page is a row of blocks, its lines (``page_lines``). Each block has its word count, link density, share of function words
and the like, those of its neighbours, its place, and - where the whole table has been counted - on how many pages of its
site its form comes back, and how much like furniture it looks on all of them. The trees are grown on a small labelled table of shapes (``block_table``), which holds no phrases:
no word of any site is learned. They have a fixed size and are broadcast.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from lexspark.llm import block_table
from lexspark.llm.page_lines import FEATURES, PageLines, hashes

#: Trees of a committee, each grown on its own resample of the rows and this share of the features; their mean decides.
#: Where the whole table has been counted, a text line lost costs more than a furniture line kept: the mean has to be higher.
TREES, SHARE, BAR, WHOLE_BAR = 12, 0.6, 0.5, 0.55
#: Parts of the labelled sites that are held out in turn, and trees for each, to tell how their lines look to trees that have not seen them.
FOLDS, FOLD_TREES = 3, 6
DEPTH, LEAST, BINS = 14, 8, 32
#: log2 of the pages of the site that show a line's form; more than 2^8 tell no more.
MAX_DOCS_LOG2 = 8


class Tree:
    """A CART tree with Gini splits over features in bins."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, features: np.ndarray, depth: int = DEPTH, least: int = LEAST):
        self.feature: list[int] = []
        self.limit: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self.of = features
        self.width = int(bins.max(initial=0)) + 1
        self._grow(bins[:, features].astype(np.int64) + np.arange(len(features)) * self.width, y, depth, least)
        self.nodes = [np.array(x) for x in (self.feature, self.limit, self.left, self.right, self.value)]
        del self.feature, self.limit, self.left, self.right, self.value

    def _grow(self, flat: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at, n, p = len(self.value), len(y), float(y.mean()) if len(y) else 0.0
        for column, v in ((self.feature, -1), (self.limit, 0), (self.left, -1), (self.right, -1), (self.value, p)):
            column.append(v)
        if not depth or n < 2 * least or p in (0.0, 1.0):
            return at
        shape = (len(self.of), self.width)
        size = shape[0] * shape[1]
        total = np.bincount(flat.ravel(), minlength=size).reshape(shape)
        hits = np.bincount(flat[y > 0].ravel(), minlength=size).reshape(shape)
        n_left, k_left = np.cumsum(total, 1)[:, :-1], np.cumsum(hits, 1)[:, :-1]
        n_right, k_right = n - n_left, hits.sum(1, keepdims=True) - k_left
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = k_left * (n_left - k_left) / n_left + k_right * (n_right - k_right) / n_right
        cost = np.where((n_left >= least) & (n_right >= least), cost, np.inf)
        j, b = divmod(int(np.argmin(cost)), shape[1] - 1)
        if cost[j, b] < p * (1 - p) * n - 1e-9:
            go = flat[:, j] - j * self.width <= b
            self.feature[at], self.limit[at] = int(self.of[j]), b
            self.left[at] = self._grow(flat[go], y[go], depth - 1, least)
            self.right[at] = self._grow(flat[~go], y[~go], depth - 1, least)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        feature, limit, left, right, value = self.nodes
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            node = at[rows]
            at[rows] = np.where(bins[rows, feature[node]] <= limit[node], left[node], right[node])
        return value[at]


class Committee:
    """Tells furniture (1) from text (0) by the mean of its trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, bar: float = BAR, seed: int = 1):
        self.bar = bar
        self.edges = []
        for column in x.T:
            v = np.unique(column)
            if len(v) > BINS:
                v = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)))
            self.edges.append((v[1:] + v[:-1]) / 2)
        bins, rng = self.bins(x), np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            features = np.sort(rng.permutation(x.shape[1])[: int(SHARE * x.shape[1])])
            self.trees.append(Tree(bins[rows], y[rows], features))

    def bins(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """The features from number ``first`` on as one byte each; a committee's trees need nothing else."""
        out = np.empty(x.shape, dtype=np.uint8)
        for j, column in enumerate(x.T):
            out[:, j] = np.searchsorted(self.edges[first + j], column, "left")
        return out

    def odds(self, bins: np.ndarray) -> np.ndarray:
        """The mean of the trees, from 0 (text) to 1."""
        return sum(t.predict(bins) for t in self.trees) / len(self.trees) if len(bins) else np.zeros(0)

    def furniture(self, bins: np.ndarray) -> np.ndarray:
        return self.odds(bins) >= self.bar


def site_features(docs: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The number of pages of the site with a line's form, and the mean odds of the form on them, as the trees read them."""
    return np.column_stack([np.minimum(np.log2(np.maximum(docs, 1)), MAX_DOCS_LOG2), odds])


def training_rows(table: list[block_table.Page]) -> tuple[np.ndarray, np.ndarray]:
    """Features (``FEATURES``, then ``site_features``) and labels of the lines of the labelled table."""
    texts = pa.array(["\n".join(t for t, _ in lines) for *_, lines in table], pa.string())
    lines = PageLines(texts, pa.array([p[2] for p in table], pa.string()), pa.array([p[0] for p in table], pa.string()))
    labels = np.array([y for *_, rows in table for _, y in rows])
    site = np.array([int(p[1].partition("p")[0][1:]) for p in table])[lines.page]
    form = np.unique(hashes(lines.skeletons()), return_inverse=True)[1]
    width = form.max(initial=0) + 1
    features = lines.features()
    odds = np.zeros(lines.n)
    for k in range(FOLDS):
        held = site % FOLDS == k
        if held.any() and not held.all():
            model = Committee(features[~held], labels[~held], FOLD_TREES)
            odds[held] = model.odds(model.bins(features[held]))
    # a form counts once a page
    form, of_line = np.unique(site * width + form, return_inverse=True)
    once, of_page = np.unique(of_line * len(table) + lines.page, return_inverse=True)
    mean = np.bincount(of_page, weights=odds) / np.maximum(np.bincount(of_page), 1)
    docs = np.bincount(once // len(table), minlength=len(form))
    mean = np.bincount(once // len(table), weights=mean, minlength=len(form)) / np.maximum(docs, 1)
    return np.column_stack([features, site_features(docs[of_line], mean[of_line])]), labels


@lru_cache(maxsize=1)
def classifiers() -> tuple[Committee, Committee]:
    """The committee for a page on its own, and the one that knows how often a line's form comes back in its site and how it looks there."""
    x, y = training_rows(block_table.pages())
    return Committee(x[:, : len(FEATURES)], y), Committee(x, y, bar=WHOLE_BAR)
