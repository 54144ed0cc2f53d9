"""Language identification by interpolated Kneser-Ney character models.

For every language the counts of character 4-grams over all labelled texts give an interpolated
Kneser-Ney model. Its n-grams are kept as sorted arrays of 64-bit keys with log probabilities and
back-off weights for each language. A text gets the language of the lowest cross-entropy per
character; a text whose cross-entropy is out of that language's range is rejected.

Characters are letters and marks, folded to lower case; a run of anything else is one space, and
so is what lies before a text's start.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

ORDER = 4
SPACE = 32
AT_ONCE = 1 << 17  # n-grams looked up at once
_MASK = [C.U64((1 << 16 * n) - 1) for n in range(ORDER + 1)]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(symbol, is a letter) of every code point; astral symbols fold into the private area."""
    symbol, letter = np.full(0x110000, SPACE, np.uint16), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            low = chr(cp).lower()
            low = ord(low) if len(low) == 1 else cp
            symbol[cp] = low if low < 0x10000 else 0xE000 + low % 6400
            letter[cp] = kind == "L"
    return symbol, letter


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram ending at each character, its row, whether a row has a letter) for some rows."""
    rows = len(off) - 1
    raw = data[off[0] : off[-1]]
    try:
        text = raw.tobytes().decode("utf-8")
        heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        ends = heads[off - off[0]]
    except UnicodeDecodeError:
        parts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off, off[1:], strict=False)]
        text, ends = "".join(parts), np.cumsum([0, *map(len, parts)])
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol, letter = _tables()
    x, row = symbol[cp], np.repeat(np.arange(rows), np.diff(ends))
    has = np.zeros(rows, bool)
    has[row[letter[cp]]] = True
    if not len(x):
        return np.zeros(0, C.U64), row, has
    new = np.ones(len(x), bool)
    new[1:] = row[1:] != row[:-1]
    keep = (x != SPACE) | new
    keep[1:] |= x[:-1] != SPACE
    x, row, new = x[keep], row[keep], new[keep]
    at = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    gram = x.astype(C.U64)
    for back in range(1, ORDER):
        c = np.full(len(x), SPACE, np.uint16)
        c[back:] = x[:-back]
        c[at < back] = SPACE
        gram |= c.astype(C.U64) << C.U64(16 * back)
    return gram, row, has


def _runs(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts, or the sums of their weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        o = np.argsort(keys, kind="stable")
        keys, weights = keys[o], weights[o]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys))) if weights is None else np.add.reduceat(weights, at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        return _runs(np.concatenate([k for k, _ in held[lang]]), np.concatenate([n for _, n in held[lang]]))

    def rows(lang: str) -> pa.RecordBatch:
        k, n = merged(lang)
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "gram": C.signed(k), "n": pa.array(n.astype(np.int64))})

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        data, off = C.text_buffer(batch.column("text"))
        for i, j in C.chunks(off):
            gram, row, _ = _grams(data, off[i : j + 1])
            names, code = np.unique(langs[i:j], return_inverse=True)
            code = code.astype(np.uint16)[row]
            order = np.argsort(code, kind="stable")  # the languages' n-grams one after the other
            for lang, part in zip(names, np.split(gram[order], np.cumsum(np.bincount(code, minlength=len(names)))[:-1]), strict=True):
                held.setdefault(lang, []).append(_runs(part))
                if sum(len(k) for k, _ in held[lang]) > 1_000_000:
                    held[lang] = [merged(lang)]
                    if len(held[lang][0][0]) > 500_000:  # bounded memory: sums are completed by the aggregation
                        yield rows(lang)
                        held[lang] = []
    for lang in held:
        if held[lang]:
            yield rows(lang)


@dataclass
class Level:
    """n-grams of one order: sorted keys, log probabilities by language, and of the contexts one
    shorter the sorted keys and log back-off weights."""

    keys: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_w: np.ndarray
    bits: int = 0
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def __post_init__(self):
        """A table of slots by hash, to find most keys without a binary search."""
        self.bits = max(10, int(len(self.keys)).bit_length() + 2)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * C.U64(0x9E3779B97F4A7C15)) >> C.U64(64 - self.bits)

    def find(self, g: np.ndarray) -> np.ndarray:
        """Index of each n-gram, -1 where absent."""
        if not len(self.keys):
            return np.full(len(g), -1, np.int32)
        at = self.slots[self._slot(g)]
        miss = np.flatnonzero(self.keys[at] != g)
        other = np.minimum(np.searchsorted(self.keys, g[miss]), len(self.keys) - 1).astype(np.int32)
        at[miss] = np.where(self.keys[other] == g[miss], other, -1)
        return at


@dataclass
class Model:
    langs: list[str]
    shards: list[tuple[int, int, Broadcast[list[Level]]]]  # levels of order 1 to ORDER for a range of a 4-gram's third symbol
    log_unknown: np.ndarray
    mean: np.ndarray
    spread: np.ndarray  # by language: variance of the cross-entropy, and its part that falls with length
    tau: float = 8.0
    reject: float = 8.0

    @property
    def chunk(self) -> int:
        """Bytes of text to judge at once: shards are read one after the other for each chunk."""
        return C.CHUNK_BYTES if len(self.shards) < 2 else C.ARROW_BYTES

    def log_p(self, levels: list[Level], gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural log probabilities of the last character of each n-gram, by language."""
        if not order:
            return np.broadcast_to(self.log_unknown, (len(gram), len(self.langs)))
        level = levels[order - 1]
        g = gram & _MASK[order]
        at = level.find(g)
        out = level.log_p[at] if len(level.keys) else np.zeros((len(g), len(self.langs)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            rest = self.log_p(levels, gram[miss], order - 1).copy()
            if order > 1:
                ctx = g[miss] >> C.U64(16)
                c = np.minimum(np.searchsorted(level.contexts, ctx), max(0, len(level.contexts) - 1))
                known = level.contexts[c] == ctx if len(level.contexts) else np.zeros(len(ctx), bool)
                rest[known] += level.log_w[c[known]]
            out[miss] = rest
        return out

    def entropies(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy by row and language, characters, has a letter)."""
        parts = [(i, *_grams(data, off[i : j + 1])) for i, j in C.chunks(off)]
        n = np.concatenate([np.zeros(0, np.int64), *(np.bincount(row, minlength=len(has)) for _, _, row, has in parts)])
        has = np.concatenate([np.zeros(0, bool), *(has for *_, has in parts)])
        total = np.zeros((len(has), len(self.langs)))
        for low, high, shared in self.shards:
            levels = shared.value
            for i, gram, row, _ in parts:
                if len(self.shards) > 1:
                    third = gram >> C.U64(16) & _MASK[1]
                    some = np.flatnonzero((third >= low) & (third < high))
                    gram, row = gram[some], row[some]
                for a in range(0, len(gram), AT_ONCE):  # a very long text is one part
                    r = row[a : a + AT_ONCE]
                    at = np.flatnonzero(np.diff(r, prepend=-1))
                    total[i + r[at]] += np.add.reduceat(self.log_p(levels, gram[a : a + AT_ONCE]).astype(np.float64), at, axis=0)
            if len(self.shards) > 1:
                del levels, shared._value  # one shard in memory at a time
        return -total / np.maximum(n, 1)[:, None], n, has

    def judge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, score, cross-entropy, rejected) of each row."""
        h, n, has = self.entropies(data, off)
        if not self.langs:
            none = np.zeros(len(has))
            return np.full(len(has), -1), none, none, np.ones(len(has), bool)
        best = np.argmin(h, axis=1)
        low = h[np.arange(len(h)), best]
        gap = np.minimum((h - low[:, None]) * (n / self.tau)[:, None], 700.0)
        score = 1.0 / np.exp(-gap).sum(axis=1)
        z = (low - self.mean[best]) / np.sqrt(self.spread[0, best] + self.spread[1, best] / np.maximum(n, 1))
        return np.where(has, best, -1), np.where(has, score, 0.0), low, ~has | (z > self.reject)


def _by_order(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """n-grams and counts of order 1 to ORDER from the counts (keys x langs) of distinct sorted 4-grams."""
    grams: list[tuple[np.ndarray, np.ndarray]] = [(keys, counts.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many characters come before
        k, c = grams[0]
        low, back = np.unique(k & _MASK[order], return_inverse=True)
        cont = np.stack([np.bincount(back, weights=c[:, i] > 0, minlength=len(low)) for i in range(c.shape[1])], axis=1)
        grams.insert(0, (low, cont))
    return grams


def _once_twice(counts: np.ndarray) -> np.ndarray:
    return np.stack([(counts == 1).sum(axis=0), (counts == 2).sum(axis=0)])


def _levels(n_langs: int, grams: list[tuple[np.ndarray, np.ndarray]], seen_by_order: list[np.ndarray]) -> tuple[list[Level], np.ndarray]:
    """Levels 1 to ORDER of a shard from its n-grams, all n-grams of order 1, and the numbers of n-grams seen once and
    twice in all shards."""
    unknown = np.full(n_langs, 1.0 / (len(grams[0][0]) + 1))
    levels, lower = [], np.zeros((0, n_langs))
    for order, (k, c) in enumerate(grams, 1):
        ones, twos = seen_by_order[order - 1]
        d = np.where((ones > 0) & (twos > 0), ones / np.maximum(ones + 2 * twos, 1), 0.75)
        ctx, at = np.unique(k >> C.U64(16) if order > 1 else np.zeros(len(k), C.U64), return_inverse=True)
        total = np.stack([np.bincount(at, weights=c[:, i], minlength=len(ctx)) for i in range(n_langs)], axis=1)
        kinds = np.stack([np.bincount(at, weights=c[:, i] > 0, minlength=len(ctx)) for i in range(n_langs)], axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            weight = np.where(total > 0, d * kinds / total, 1.0)
            seen = np.where(total[at] > 0, np.maximum(c - d, 0) / total[at], 0.0)
        if order == 1:
            p = seen + weight[at] * unknown
            unknown = weight[0] * unknown if len(weight) else unknown
        else:
            p = seen + weight[at] * lower[np.searchsorted(grams[order - 2][0], k & _MASK[order - 1])]
        levels.append(Level(k, np.log(np.maximum(p, 1e-30)).astype(np.float32), ctx, np.log(np.maximum(weight, 1e-30)).astype(np.float32)))
        lower = p
    return levels, np.log(unknown).astype(np.float32)


def train(docs: DataFrame, max_cells: int = 1 << 24) -> Model:
    """A model from ``docs(text, lang)``; rows without lang or text are not used.

    n-grams are counted over all rows, and all counts are used and kept. The model is cut into shards by a 4-gram's third
    symbol, in which all that its probability needs lies together; a shard has at most ``max_cells`` n-grams times
    languages (more only where one symbol has), so that it can be broadcast. Ranges of cross-entropy
    and the score's scale are fitted on all these rows too. Without labelled rows the model knows no language and everything
    is ``und``.
    """
    scratch = C.Scratch(docs.sparkSession)
    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = scratch.save(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    langs = [r[0] for r in counts.select("lang").distinct().sort("lang").collect()]
    number = {lang: i for i, lang in enumerate(langs)}
    third = F.shiftright("gram", 16).bitwiseAND(F.lit(0xFFFF))
    cells = [(r[0], r[1] * len(langs)) for r in counts.select("gram").distinct().groupBy(third.alias("third")).count().sort("third").collect()]
    cuts, held = [0], 0
    for symbol, n in cells:
        if held and held + n > max_cells:
            cuts.append(symbol)
            held = 0
        held += n
    ranges = list(zip(cuts, [*cuts[1:], 1 << 16], strict=True)) if cells else []

    def grams(low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        part = counts if len(ranges) == 1 else counts.where((third >= low) & (third < high))
        table = part.toArrow()
        keys, at = np.unique(np.ascontiguousarray(table["gram"].to_numpy()).view(C.U64), return_inverse=True)
        dense = np.zeros((len(keys), len(langs)))
        dense[at, [number[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
        return _by_order(keys, dense)

    seen, single = np.zeros((ORDER, 2, len(langs)), np.int64), np.zeros((1 << 16, len(langs)))
    for low, high in ranges:
        found = grams(low, high)
        single[found[0][0].astype(np.int64)] += found[0][1]
        seen[1:] += np.stack([_once_twice(c) for _, c in found[1:]])
    seen[0] = _once_twice(single)
    first = np.flatnonzero(single.any(axis=1))
    unknown, shards = np.zeros(len(langs), np.float32), []
    for low, high in ranges:
        rest = (found if len(ranges) == 1 else grams(low, high))[1:]
        levels, unknown = _levels(len(langs), [(first.astype(C.U64), single[first]), *rest], list(seen))
        shards.append((low, high, docs.sparkSession.sparkContext.broadcast(levels)))
    model = Model(langs, shards, unknown, np.zeros(len(langs)), np.ones((2, len(langs))))
    if langs:
        _calibrate(model, rows, number, scratch)
    return model


TAUS = [2.0**k for k in range(2, 9)]


def _calibrate(model: Model, rows: DataFrame, number: dict[str, int], scratch: C.Scratch) -> None:
    """Mean and spread of the cross-entropy and the score's scale, from all rows; copies count once. Only sums by language
    reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        for b in batches:
            data, off = C.text_buffer(b.column("text"))
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for i, j in C.chunks(off, m.chunk):
                h, n, _ = m.entropies(data, off[i : j + 1])
                who, own = np.arange(j - i), lang[i:j]
                gap = (h - h.min(axis=1)[:, None]) * n[:, None]
                cost = np.stack([gap[who, own] / t + np.log(np.exp(-np.minimum(gap / t, 700)).sum(axis=1)) for t in TAUS], axis=1)
                part = {c: b.column(c).slice(i, j - i) for c in ("text_a", "text_b")}
                part |= {"lang": pa.array(own), "n": pa.array(n.astype(np.int64)), "own": pa.array(h[who, own]), "cost": pa.array(list(cost), pa.list_(pa.float64()))}
                yield pa.RecordBatch.from_pydict(part)

    named = rows.withColumns({"text_a": F.xxhash64("text"), "text_b": F.xxhash64("text", F.lit(29))})  # together the name of a text
    judged = named.mapInArrow(run, "text_a long, text_b long, lang long, n long, own double, cost array<double>").where("n > 0")
    once = scratch.save(judged.groupBy("lang", "text_a", "text_b").agg(*[F.min(c).alias(c) for c in ("n", "own", "cost")]), "calibration")
    total = F.sum("n").cast("double")
    means = once.groupBy("lang").agg(F.count("*").alias("rows"), (F.sum(F.col("own") * F.col("n")) / total).alias("mean"), F.percentile("n", 0.5).alias("half"))
    means = once.sparkSession.createDataFrame(means.collect(), "lang long, rows long, mean double, half double")  # a row a language
    off = (F.col("own") - F.col("mean")) * (F.col("own") - F.col("mean"))
    costs = [F.sum(F.col("cost")[k]).alias(f"cost{k}") for k in range(len(TAUS))]
    sums = once.join(F.broadcast(means), "lang").groupBy("lang").agg(
        F.first("rows").alias("rows"), F.first("mean").alias("mean"), F.avg(F.when(F.col("n") >= F.col("half"), off)).alias("wide"),
        F.avg(off * F.least(F.col("n"), F.lit(200))).alias("falls"), *costs,
    ).collect()
    scratch.drop(once)
    if not sums:
        return
    for r in sums:
        if r.rows >= 2:  # rounded: the order in which a cluster adds changes the last places
            model.mean[r.lang] = round(r.mean, 9)
            model.spread[:, r.lang] = round(max(r.wide, 0.15**2), 9), round(max(r.falls, 1e-2), 9)
    model.tau = TAUS[int(np.argmin([sum(r[f"cost{k}"] for r in sums) for k in range(len(TAUS))]))]


_NEW = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predict(docs: DataFrame, model: Model, text: str = "text", only_kept: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected, which
    replace columns of these names. Null texts and texts without a letter are ``und``, score 0, and
    rejected. Only ``text`` is looked at, whole. ``only_kept``: the rows that aren't rejected, with
    their own columns alone."""
    C.small_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if only_kept or f.name not in _NEW.names]
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        labels = np.array([*m.langs, "und"], object)
        for b in batches:
            data, off = C.text_buffer(b.column(text))
            for i, j in C.chunks(off, m.chunk):
                best, score, h, rejected = m.judge(data, off[i : j + 1])
                part = b.slice(i, j - i)
                if only_kept:
                    yield part.select(names).filter(pa.array(~rejected))
                else:
                    new = [pa.array(labels[best], pa.string()), pa.array(score), pa.array(h), pa.array(rejected)]
                    yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *new], names=[*names, *_NEW.names])

    schema = T.StructType(own if only_kept else [*own, *_NEW.fields])
    return docs.select(*[F.col(f"`{x}`") for x in names]).mapInArrow(run, schema)
