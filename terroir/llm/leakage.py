"""Evaluation items inside a corpus (problem 9).

Windows of twelve words of the items and of the documents are embedded by CGK random walks, which
turn edit distance into Hamming distance; repeated sampling of embedding positions gives keys, and
windows that share a key are verified exactly. The number of walks is chosen so that altered item
windows are found with the target recall; unaltered ones are always found.

The items are a stated query set: they are sent to the executors in blocks of bounded size, and
each batch of documents is read and split into words once and looked up in one block after the
other, so the method doesn't depend on how many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terroir.llm.words import words
from terroir.session import Shared

WINDOW, ALTERED = 12, 1
STEPS, SAMPLED, SAMPLES = 24, 4, 2
#: Windows of one block of items (about 30 MB of keys at 32 walks): the bound of what is broadcast.
BLOCK_WINDOWS = 40_000
#: Walks that may be made; a recall that they don't reach is an error.
MAX_WALKS = 64
#: Altered windows of each kind on which the recall is measured.
TRIALS = 6_000
#: Blocks that a worker keeps in memory; of more, one at a time.
KEPT_BLOCKS = 4


class Walks:
    """Random bits and sampled positions, the same wherever they are made from the same seed."""

    def __init__(self, n_words: int, walks: int, seed: int) -> None:
        self.walks, self.seed, self.pad = walks, seed, n_words + 1
        self.bits = [np.random.default_rng([seed, r, 0]).integers(0, 2, (STEPS, n_words + 2), dtype=np.int8) for r in range(walks)]
        # one position from each quarter of the walk, so that samples cover different words
        self.at = [np.random.default_rng([seed, r, 1]).integers(0, STEPS // SAMPLED, (SAMPLES, SAMPLED)) + np.arange(SAMPLED) * (STEPS // SAMPLED) for r in range(walks)]
        self.mix = [np.random.default_rng([seed, r, 2]).integers(1, 2**62, (SAMPLES, SAMPLED), dtype=np.uint64) | np.uint64(1) for r in range(walks)]

    def keys(self, flat: np.ndarray, starts: np.ndarray, r: int) -> np.ndarray:
        """(SAMPLES, windows) keys of walk r over the windows flat[s:s+WINDOW]."""
        emitted = np.empty((STEPS, len(starts)), dtype=np.int32)
        here = np.zeros(len(starts), dtype=np.int64)
        bits = self.bits[r]
        for t in range(STEPS):
            symbol = np.where(here < WINDOW, flat[np.minimum(starts + here, len(flat) - 1)], self.pad)
            emitted[t] = symbol
            here += bits[t, symbol]
        out = np.zeros((SAMPLES, len(starts)), dtype=np.uint64)
        for j in range(SAMPLES):
            h = np.full(len(starts), r * SAMPLES + j + 1, dtype=np.uint64)
            for p, m in zip(self.at[r][j], self.mix[r][j]):
                h = (h ^ emitted[p].astype(np.uint64)) * m
                h ^= h >> np.uint64(29)
            out[j] = h
        return out


class ItemBlock:
    """The windows of a block of items, their sorted keys and the vocabulary."""

    def __init__(self, items: list[tuple[object, list[str]]], recall: float, seed: int) -> None:
        items = [(i, w) for i, w in items if len(w) >= WINDOW]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.flat = np.array([self.vocabulary[w] for _, ws in items for w in ws], dtype=np.int32)
        self.starts = np.concatenate([[0], np.cumsum([len(ws) for _, ws in items])]).astype(np.int64)
        own = [np.arange(a, b - WINDOW + 1) for a, b in zip(self.starts, self.starts[1:])]
        self.windows = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
        self.item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.ids = [i for i, _ in items]
        self.walks = Walks(len(self.vocabulary), self._enough(recall, seed), seed)
        self.tables = []
        for r in range(self.walks.walks if len(self.windows) else 0):
            for k in self.walks.keys(self.flat, self.windows, r):
                order = np.argsort(k, kind="stable")
                self.tables.append((k[order], order.astype(np.int32)))

    def _enough(self, recall: float, seed: int) -> int:
        """Walks until that share of windows with one altered word, at any place, is found: both where
        the new word is unknown and where it is a word of the items."""
        if not len(self.windows):
            return 1
        rng = np.random.default_rng(seed)
        n = TRIALS
        pick = self.windows[rng.integers(0, len(self.windows), n)]
        whole = self.flat[pick[:, None] + np.arange(WINDOW)]
        altered = np.concatenate([whole, whole])
        where = np.arange(2 * n), np.arange(2 * n) % WINDOW
        other = rng.integers(0, max(len(self.vocabulary), 1), n)
        other = np.where(other == whole[np.arange(n), where[1][n:]], len(self.vocabulary), other)
        altered[where] = np.concatenate([np.full(n, len(self.vocabulary)), other])
        at, found = np.arange(2 * n) * WINDOW, np.zeros(2 * n, dtype=bool)
        trial, both = Walks(len(self.vocabulary), MAX_WALKS, seed), np.concatenate([whole, whole])
        for r in range(MAX_WALKS):
            found |= (trial.keys(both.ravel(), at, r) == trial.keys(altered.ravel(), at, r)).any(axis=0)
            if min(found[:n].mean(), found[n:].mean()) >= recall:
                return r + 1
        raise ValueError(f"{MAX_WALKS} walks don't reach a recall of {recall}")

    def matches(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) indices of exactly verified matches among windows flat[s:s+WINDOW]."""
        for r in range(self.walks.walks):
            keys = self.walks.keys(flat, starts, r)
            for j in range(SAMPLES):
                known, order = self.tables[r * SAMPLES + j]
                low, high = np.searchsorted(known, keys[j], "left"), np.searchsorted(known, keys[j], "right")
                hit = np.flatnonzero(high > low)
                ends = np.cumsum(high[hit] - low[hit])
                for a, b in _slices(ends, 2_000_000):
                    part = hit[a:b]
                    n = high[part] - low[part]
                    mine = np.repeat(part, n)
                    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    theirs = order[np.repeat(low[part], n) + offset]
                    yield self._verified(flat, starts, mine, theirs)

    def _verified(self, flat: np.ndarray, starts: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bad = np.zeros(len(mine), dtype=np.int8)
        for k in range(WINDOW):
            bad += flat[starts[mine] + k] != self.flat[self.windows[theirs] + k]
            keep = bad <= ALTERED
            if not keep.all():
                mine, theirs, bad = mine[keep], theirs[keep], bad[keep]
        return mine, self.item[theirs]


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of hits whose pairs together are about `most` at most."""
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield a, b
        a = b


def _find(split: list[list[str]], block: ItemBlock) -> list[set[int]]:
    """For each text (its words) the block's items that it holds."""
    known, unknown = block.vocabulary.get, len(block.vocabulary)
    found: list[set[int]] = [set() for _ in split]
    flat = np.fromiter((known(w, unknown) for ws in split for w in ws), dtype=np.int32)
    if len(flat) < WINDOW or not block.tables:
        return found
    size = np.array([len(ws) for ws in split])
    text_of = np.repeat(np.arange(len(split)), size)
    inside = np.concatenate([[0], np.cumsum(flat < unknown)])
    start = np.arange(len(flat) - WINDOW + 1)
    # a window with one altered word still has eleven words of the items
    fit = (text_of[start] == text_of[start + WINDOW - 1]) & (inside[start + WINDOW] - inside[start] >= WINDOW - ALTERED)
    start = start[fit]
    for a in range(0, len(start), 100_000):
        part = start[a : a + 100_000]
        for mine, item in block.matches(flat, part):
            for t, i in set(zip(text_of[part[mine]].tolist(), item.tolist())):
                found[t].add(i)
    return found


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, list[str]]]]:
    """Blocks of items by number of windows; rows come to the driver one partition at a time."""
    block, size = [], 0
    for r in items.select(item_id, text).where(F.col(text).isNotNull()).distinct().orderBy(item_id, text).toLocalIterator():
        w = words(r[1])
        # an item longer than a block is cut into parts that overlap by a window less a word
        for a in range(0, max(1, len(w) - WINDOW + 1), BLOCK_WINDOWS):
            part = w[a : a + BLOCK_WINDOWS + WINDOW - 1]
            n = max(0, len(part) - WINDOW + 1)
            if block and size + n > BLOCK_WINDOWS:
                yield block
                block, size = [], 0
            block.append((r[0], part))
            size += n
    if block:
        yield block


def leaked(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", recall: float = 0.999, seed: int = 20_240_611) -> DataFrame:
    """doc_id, item_id: the document holds twelve consecutive words of the item, at most one altered.

    Each pair once. Null and empty texts hold nothing; items of fewer than twelve words can't be
    held; items of equal text are all reported; extra columns are ignored.
    """
    spark = documents.sparkSession
    id_type, item_type = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    blocks = [Shared(spark, ItemBlock(block, recall, seed), keep=False) for block in item_blocks(items, item_id, text)]
    if not blocks:
        return spark.createDataFrame([], f"`{doc_id}` {id_type}, `{item_id}` {item_type}")

    def find(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            split = [words(t) if isinstance(t, str) else [] for t in pdf["t"]]
            at, ids = [], []
            for shared in blocks:
                block = shared.value
                found = _find(split, block)
                at += [k for k, own in enumerate(found) for _ in own]
                ids += [block.ids[i] for own in found for i in sorted(own)]
                if len(blocks) > KEPT_BLOCKS:
                    shared.drop()
            yield pd.DataFrame({doc_id: pdf["d"].iloc[at].reset_index(drop=True), item_id: pd.Series(ids, dtype=object)})

    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.length("t") > 0)
    return rows.mapInPandas(find, f"`{doc_id}` {id_type}, `{item_id}` {item_type}").distinct()


def leaked_items(pairs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Every item with the number of documents that hold it (0 if it didn't leak)."""
    counts = pairs.groupBy(item_id).agg(F.countDistinct(doc_id).alias("n_documents"))
    return items.select(item_id).distinct().join(counts, item_id, "left").fillna(0, ["n_documents"])
