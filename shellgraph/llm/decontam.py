"""Benchmark decontamination: BM25 over an inverted index of the test items, block-max WAND.

Every passage of every document is a query against the index. A passage's terms have upper bounds
of what they can add to any item's score, and to any item's of a block; only items whose bounds
reach the threshold are scored. A hit counts as a leak when the item's question and answer both
overlap the passage.

Scores are divided by the score of the item against itself, so that one threshold fits items of any
length. Words are runs of letters and digits, in lower case. An item's answer is its last third
of words (at least one), its question the rest; overlap is the share of word pairs found in the
passage. A passage is a window of twice the item's length class (a power of two), at least ``least`` words: a long item
in the test set doesn't widen the passages that short ones are looked for in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end, word hashes, words per row, first word per row), for some rows at a time."""
    data, off = C.text_buffer(pc.utf8_lower(col.cast(pa.large_string())))
    for i, j in C.chunks(off):
        yield i, j, *C.word_hashes(data, off[i : j + 1], _SEP)


@dataclass(frozen=True)
class Rules:
    """threshold: share of the item's own score; question, answer: least share of word pairs;
    k1, b: of BM25; least: words of the shortest passages; block: items in a block of the index; part: items that are
    looked for at once; max_items: bound on the test set."""

    threshold: float = 0.5
    question: float = 0.6
    answer: float = 0.6
    k1: float = 1.2
    b: float = 0.75
    least: int = 64
    block: int = 16
    part: int = 8192
    max_items: int = 1_000_000


class Index:
    """The test items by words: terms, and parts by length class. Items of the same words are one; ``ids`` has the ids of
    each."""

    def __init__(self, ids: list[int], texts: pa.Array, rules: Rules):
        self.rules = rules
        words: list[np.ndarray] = []
        for i, j, h, counts, first in _words(texts):
            words += [h[a : a + n] for a, n in zip(first[: j - i], counts, strict=True)]
        same: dict[bytes, int] = {}
        of = np.array([same.setdefault(w.tobytes(), len(same)) for w in words], np.int64)
        copies = np.bincount(of, minlength=len(same))
        self.ids = [np.zeros(0, np.int64)] * len(same)
        for k, rows in enumerate(np.split(np.argsort(of, kind="stable"), np.cumsum(copies)[:-1]) if len(same) else []):
            self.ids[k] = np.array(ids, np.int64)[rows]
        words = [np.frombuffer(w, C.U64) for w in same]
        length = np.array([len(w) for w in words], float)
        n_items = len(of)
        item = np.repeat(np.arange(len(words)), length.astype(int))
        self.terms, term = np.unique(np.concatenate(words) if words else np.zeros(0, C.U64), return_inverse=True)
        pair, tf = np.unique(term * max(1, len(words)) + item, return_counts=True)
        post_term, post_item = pair // max(1, len(words)), pair % max(1, len(words))
        df = np.bincount(post_term, weights=copies[post_item], minlength=len(self.terms))
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        mean = np.average(length, weights=copies) if n_items else 1
        norm = rules.k1 * (1 - rules.b + rules.b * length / max(mean, 1e-9))
        score = idf[post_term] * tf * (rules.k1 + 1) / (tf + norm[post_item])
        own = np.bincount(post_item, weights=score, minlength=len(words))
        score /= own[post_item]
        size = np.maximum(rules.least // 2, 2 ** np.ceil(np.log2(np.maximum(length, 1)))).astype(np.int64)
        self.parts: list[Part] = []
        for width in np.unique(size).tolist():
            members = np.flatnonzero(size == width)
            for k in range(0, len(members), rules.part):
                some = members[k : k + rules.part]
                at = np.flatnonzero(np.isin(post_item, some))
                self.parts.append(Part(rules, some, [words[i] for i in some], 2 * width, len(self.terms), df, post_term[at], np.searchsorted(some, post_item[at]), score[at]))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words of no item."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def leaks(self, h: np.ndarray, counts: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, int, float, float]]:
        """Of some rows' words: (row, item) -> (score, first word of the passage, question and
        answer overlap) for the passage with the highest score."""
        found: dict[tuple[int, int], tuple[float, int, float, float]] = {}
        if len(h) and len(self.terms):
            term = self.lookup(h)
            for part in self.parts:
                found |= part.leaks(h, term, counts, first)
        return found


class Part:
    """Postings of items of one length class in item order, with upper bounds by term and by term and block.

    members: their numbers in the index; post_term, post_item, score: postings by term, items by place in ``members``."""

    def __init__(self, rules: Rules, members: np.ndarray, words: list[np.ndarray], window: int, n_terms: int, df: np.ndarray, post_term: np.ndarray, post_item: np.ndarray, score: np.ndarray):
        self.rules, self.members, self.window, self.n_terms = rules, members, window, n_terms
        self.post_term, self.post_item, self.score = post_term, post_item, score
        n_items = len(members)
        self.start = np.searchsorted(post_term, np.arange(n_terms + 1))
        self.bound = np.zeros(n_terms)
        np.maximum.at(self.bound, post_term, score)
        block = post_term * (n_items // rules.block + 1) + post_item // rules.block
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        self.block_max = np.repeat(np.maximum.reduceat(score, at), np.diff(np.append(at, len(block))))
        self.block_end = np.repeat(np.append(at[1:], len(block)), np.diff(np.append(at, len(block))))
        self._essential(n_items, df)
        pairs = [w[:-1] * C.U64(3) + C.mix(w[1:]) for w in words]
        cuts = [max(1, len(w) - max(1, len(w) // 3)) for w in words]
        self.question = [np.unique(p[: max(0, c - 1)]) for p, c in zip(pairs, cuts, strict=True)]
        self.answer = [np.unique(p[max(0, c - 1) :]) for p, c in zip(pairs, cuts, strict=True)]

    def _essential(self, n_items: int, df: np.ndarray) -> None:
        """Of each item the rarest terms that make up all but half a threshold of its score. A
        passage reaches the threshold only with at least ``need`` from them."""
        o = np.lexsort((self.post_term, df[self.post_term], self.post_item))
        share = self.score[o]
        begin = np.searchsorted(self.post_item[o], np.arange(n_items))
        run = np.cumsum(share) - share
        before = run - run[begin][self.post_item[o]] if len(o) else run
        keep = before < 1 - self.rules.threshold / 2
        rest = np.bincount(self.post_item[o][~keep], weights=share[~keep], minlength=n_items)
        self.need = self.rules.threshold - rest - 1e-9
        kept = np.sort(o[keep])  # postings stay in term order
        self.ess_item, self.ess_score = self.post_item[kept], self.score[kept]
        self.ess_start = np.searchsorted(self.post_term[kept], np.arange(self.n_terms + 1))

    def hopeful(self, term: np.ndarray, counts: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, first word, end) of the passages of some rows in which an item's essential terms
        reach its need; repeated words count again, so none that matters is left out.

        Passages are windows of twice the class's longest items, half a window apart from each other, so that
        every item lies whole in one of them."""
        step = self.window // 2
        row = np.repeat(np.arange(len(counts)), counts)
        half = (np.arange(len(term)) - first[row]) // step  # the half window a word is in
        slots = counts // step + 2
        base = np.cumsum(slots) - slots
        at = np.flatnonzero(term >= 0)
        t = term[at]
        n = self.ess_start[t + 1] - self.ess_start[t]
        where = np.repeat(base[row[at]] + half[at], n)
        post = np.repeat(self.ess_start[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, score = self.ess_item[post], self.ess_score[post]
        n_items = len(self.need)
        # window k of a row holds its halves k and k + 1
        key = np.concatenate((where, where - 1)) * n_items + np.tile(item, 2)
        key, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, weights=np.tile(score, 2))
        slot = np.unique(key[total >= self.need[key % n_items]] // n_items)
        out = []
        for s in slot.tolist():
            r = int(np.searchsorted(base, max(s, 0), "right")) - 1
            k = max(s - int(base[r]), 0)
            a = int(first[r]) + k * step
            out.append((r, a, min(a + self.window, int(first[r] + counts[r]))))
        return sorted(set(out))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score for the distinct ``terms`` reaches the threshold."""
        goal, out = self.rules.threshold - 1e-9, []
        pos, end = self.start[terms].copy(), self.start[terms + 1]
        bound = self.bound[terms]
        live = pos < end
        while True:
            pos, end, bound = pos[live], end[live], bound[live]
            if bound.sum() < goal:
                return out
            at = self.post_item[pos]
            order = np.argsort(at, kind="stable")
            pivot = int(np.searchsorted(np.cumsum(bound[order]), goal))
            if pivot >= len(order):
                return out
            item = at[order[pivot]]
            # no item before the pivot can reach the goal: move on to its block
            for k in range(len(pos)):
                while pos[k] < end[k] and self.post_item[pos[k]] // self.rules.block < item // self.rules.block:
                    pos[k] = self.block_end[pos[k]]
            some = np.flatnonzero(pos < end)
            same = some[self.post_item[pos[some]] // self.rules.block == item // self.rules.block]
            if self.block_max[pos[same]].sum() < goal:
                last = (item // self.rules.block + 1) * self.rules.block  # nothing in this block can reach it
                for k in same:
                    while pos[k] < end[k] and self.post_item[pos[k]] < last:
                        pos[k] = self.block_end[pos[k]]
            else:
                score = 0.0
                for k in np.flatnonzero(pos < end):
                    while pos[k] < end[k] and self.post_item[pos[k]] < item:
                        pos[k] += 1
                    if pos[k] < end[k] and self.post_item[pos[k]] == item:
                        score += self.score[pos[k]]
                        pos[k] += 1
                if score >= goal:
                    out.append((int(item), float(score)))
            live = pos < end

    def overlap(self, item: int, pairs: np.ndarray) -> tuple[float, float]:
        share = lambda own: float(np.isin(own, pairs).mean()) if len(own) else 1.0
        return share(self.question[item]), share(self.answer[item])

    def leaks(self, h: np.ndarray, term: np.ndarray, counts: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, int, float, float]]:
        found: dict[tuple[int, int], tuple[float, int, float, float]] = {}
        for r, a, b in self.hopeful(term, counts, first):
            t = term[a:b]
            hits = self.search(np.unique(t[t >= 0]))
            pairs = h[a : b - 1] * C.U64(3) + C.mix(h[a + 1 : b]) if hits else None
            for item, score in hits:
                q, w = self.overlap(item, pairs)
                key = r, int(self.members[item])
                if q >= self.rules.question and w >= self.rules.answer and score > found.get(key, (0.0,))[0]:
                    found[key] = (score, a - int(first[r]), q, w)
        return found


def build_index(benchmark: DataFrame, rules: Rules = Rules()) -> Index:
    """The index of ``benchmark(item_id, text)``. Items without words and of null id are left out.
    The test set is small and known; more than ``max_items`` is an error rather than a broadcast
    without bound."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text rlike '[\\\\p{L}\\\\p{N}]'")
    table = rows.limit(rules.max_items + 1).sort("item_id", "text").toArrow()
    if len(table) > rules.max_items:
        raise ValueError(f"more than {rules.max_items} test items")
    return Index(table["item_id"].to_pylist(), table["text"].combine_chunks(), rules)


HITS = "doc_id long, item_id long, score double, passage_start long, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each document of ``docs(doc_id, text)`` and each test item it leaks, for the best
    passage. Documents without leaks have no row; null and empty texts leak nothing; repeated rows
    give repeated rows; without items there are no leaks. Documents are independent: no shuffle."""
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(build_index(benchmark, rules))  # max_items items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            rows = []
            for i, j, h, counts, first in _words(batch.column("text")):
                for (r, item), hit in index.leaks(h, counts, first).items():
                    rows += [(ids[i + r].as_py(), k, *hit) for k in index.ids[item].tolist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, HITS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` without the documents that leak an item, columns unchanged."""
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(build_index(benchmark, rules))  # max_items items
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i, j, h, counts, first in _words(batch.column("text")):
                keep = np.ones(j - i, bool)
                for r, _ in index.leaks(h, counts, first):
                    keep[r] = False
                yield batch.slice(i, j - i).select(names).filter(pa.array(keep))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
