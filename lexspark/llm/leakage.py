"""Problem 9: passages of held-out items inside training texts, by suffix arrays.

Every batch of training texts is one shard: its words become numbers, and the suffixes are sorted by their
first ``min_words`` words. A suffix that holds a word no item has within that span cannot begin a match, so
only the others are kept: the array is sparse, and still exact. Every suffix of every item is looked up in
it by binary search; neighbouring hits on one diagonal join into the longest verbatim match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Item words sent along with the function at once; larger test sets are searched in blocks of this size.
MAX_ITEM_WORDS = 2_000_000
#: Pairs of equal suffixes laid out at once.
MAX_HITS = 2_000_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters or digits, lowercased; all else separates."""
    return WORD.findall(text.lower()) if text else []


def _keys(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` codes from each start as fixed-width byte strings that sort like the codes."""
    grid = codes[starts[:, None] + np.arange(n)].astype(">u4")
    return np.ascontiguousarray(grid).view(f"S{4 * n}").ravel()


def item_texts(items: DataFrame, max_words: int = MAX_ITEM_WORDS) -> Iterator[list[tuple[int, str]]]:
    """``item_id, text`` of all items, in blocks of about ``max_words`` words, told by a hash; the driver holds one block at a time."""
    rows = items.select("item_id", "text").where("item_id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = 1 + int(size) // (5 * max_words)  # a word and what parts it from the next take five letters or more
    block = F.pmod(F.xxhash64("item_id"), F.lit(count))  # rows of one id stay together
    for b in range(count):
        yield [(r["item_id"], r["text"]) for r in rows.where(block == b).collect()]


class ItemIndex:
    """All suffixes of the items that reach over ``n`` words. Items given twice are searched twice."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int):
        self.n, self.vocabulary = n, {}
        codes: list[int] = []
        owner: list[int] = []
        begin: list[int] = []
        for item, words in items:
            if len(words) < n:
                continue
            begin += [len(codes)] * (len(words) + 1)
            codes += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0]
            owner += [item] * (len(words) + 1)
        self.codes, self.owner, self.begin = (np.array(x, dtype=np.int64) for x in (codes, owner, begin))
        self.starts = _whole(self.codes, n)
        self.keys = _keys(self.codes, self.starts, n) if len(self.starts) else np.array([], dtype="S4")


def _whole(codes: np.ndarray, n: int) -> np.ndarray:
    """The positions from which ``n`` words follow that are all known."""
    if len(codes) < n:
        return np.array([], dtype=np.int64)
    gaps = np.concatenate([[0], np.cumsum(codes == 0)])
    return np.flatnonzero(gaps[n:] == gaps[:-n])


def search_shard(index: ItemIndex, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """``text number, item, longest match in words, its place in the text, its place in the item's words``."""
    get, n = index.vocabulary.get, index.n
    parts: list[int] = []
    lengths = []
    for t in texts:
        codes = [get(w, 0) for w in words_of(t)]
        parts += codes
        parts.append(0)
        lengths.append(len(codes) + 1)
    codes = np.array(parts, dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    starts = _whole(codes, n)
    if not len(starts) or not len(index.starts):
        return
    keys = _keys(codes, starts, n)
    order = np.argsort(keys, kind="stable")
    array, suffixes = keys[order], starts[order]  # the shard's suffix array
    # equal suffixes of items are looked up once
    different, back = np.unique(index.keys, return_inverse=True)
    lo, hi = np.searchsorted(array, different, "left"), np.searchsorted(array, different, "right")
    items = np.argsort(back, kind="stable")
    items_lo = np.searchsorted(back[items], np.arange(len(different)))
    items_n = np.bincount(back, minlength=len(different))
    # hits are laid out for some texts at a time: of each text's suffixes it is known how many item suffixes they meet
    met = np.flatnonzero(hi > lo)
    if not len(met):
        return
    of_key = np.repeat(met, (hi - lo)[met])
    at_text = suffixes[np.repeat(lo[met], (hi - lo)[met]) + _steps((hi - lo)[met])]
    text = np.searchsorted(begins, at_text, "right") - 1
    order = np.argsort(text, kind="stable")
    of_key, at_text, text = of_key[order], at_text[order], text[order]
    size = np.bincount(text, weights=items_n[of_key], minlength=len(texts))
    part = (np.cumsum(size) / MAX_HITS).astype(np.int64)[text]
    for p in np.unique(part):
        here = part == p
        k = items_n[of_key[here]]
        pair_text = np.repeat(at_text[here], k)
        pair_item = index.starts[items[np.repeat(items_lo[of_key[here]], k) + _steps(k)]]
        yield from _longest(index, begins, pair_item, pair_text)


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _longest(index: ItemIndex, begins: np.ndarray, at_item: np.ndarray, at_text: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    # one diagonal, one step after another: the same verbatim match
    order = np.lexsort((at_text, at_text - at_item))
    at_item, at_text = at_item[order], at_text[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(at_text) != 1) | (np.diff(at_item) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(order))) + index.n - 1
    text = np.searchsorted(begins, at_text[first], "right") - 1
    item = index.owner[at_item[first]]
    item_at, text_at = at_item[first] - index.begin[at_item[first]], at_text[first] - begins[text]
    best = np.lexsort((item_at, text_at, -length, item, text))
    text_b, item_b = text[best], item[best]
    keep = np.ones(len(best), dtype=bool)
    keep[1:] = (text_b[1:] != text_b[:-1]) | (item_b[1:] != item_b[:-1])
    for i in best[keep]:
        yield int(text[i]), int(item[i]), int(length[i]), int(text_at[i]), int(item_at[i])


def leaked_passages(docs: DataFrame, items: DataFrame, n: int = MIN_WORDS, key: str = "doc_id", text: str = "text", max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """``doc_id, item_id, words, doc_at, item_at``: documents that share at least ``n`` words in a row with an item.

    ``words`` is the longest match of the pair, ``doc_at`` and ``item_at`` its first word, from 0. A row of
    ``docs`` gives at most one row per item; null and short texts on either side give none. The items are held
    out, few by nature; they are indexed in blocks of about ``max_item_words`` words, each index is broadcast, so
    what is sent along stays bounded, and each block costs one more pass over ``docs``. The texts are not shuffled.
    """
    kind = dict(docs.dtypes)[key]
    context = docs.sparkSession.sparkContext

    def searched(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = list(search_shard(index, batch.column(1).to_pylist()))
                if found:
                    at, *rest = zip(*found)
                    columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(rest[0], pa.int64()), *(pa.array(x, pa.int32()) for x in rest[1:])]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "item_id", "words", "doc_at", "item_at"])

        return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, item_id bigint, words int, doc_at int, item_at int")

    out = None
    for block in item_texts(items, max_item_words):
        found = searched(context.broadcast(ItemIndex([(i, words_of(t)) for i, t in block], n)))
        out = found if out is None else out.unionByName(found)
    return out


def clean_corpus(docs: DataFrame, leaked: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the documents named in ``leaked``."""
    return docs.join(leaked.select(key).distinct(), key, "left_anti")
