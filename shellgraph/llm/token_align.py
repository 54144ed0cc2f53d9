"""Alignment of two tokenizers' tokens of the same texts, by their byte offsets.

Both tokenizers are cut before a space that a visible character follows, whatever stands before it, but for another
space. So a text is a row of words, each with its leading space, and its alignment is that of its words, one after
the other. Texts are written as codes of words in chunks of bounded size, each with its own list of words; what the lists have
in common is tokenised and aligned once, by relational steps: tokens exploded with their places, windowed sums of lengths as
ends, an equi-join on word and end as cuts, running counts of cuts as group ids, whose ranges of both sides are linked.
Chunks and the facts of their words then meet again, and documents are summed up there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

FOLDER = "/opt/tokenizers"
SPACE = "▁"
WORDS = re.compile(r"(?<=[^ ])(?= \S)")
#: Texts in which not every space begins a word: one is first or last, or white space follows it (fixed values: all code
#: points that either tokenizer or Python takes for it).
UNEVEN = r"^ | $| [\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MANY = 1_000_000  # counts of pairs that may be broadcast, counted


@dataclass(frozen=True)
class Pair:
    """The two vocabulary files: byte-level BPE (A) and sentence pieces with byte fallback (B); chunk_bytes: text that is
    coded with one list of words, and held at once (or one longer text)."""

    a: str = f"{FOLDER}/byte_bpe_50k.json"
    b: str = f"{FOLDER}/piece_bpe_32k.model"
    chunk_bytes: int = 16 << 20


class Tokenizers:
    """Both tokenizers from the contents of their files, and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        # byte-level vocabularies write bytes that aren't visible characters as those from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in plain]
        byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.vocab_size())]
        self.a_lens = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int32)
        self.b_lens = np.array([len(x) for x in self.b_bytes], np.int32)

    def splits(self) -> bool:
        """Whether no token of B runs over a boundary between a character and a space, and A splits words as usual."""
        pre = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not any(re.search(rf"[^{SPACE}]{SPACE}", self.b.id_to_piece(i)) for i in range(len(self.b_bytes)))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int], bool]]:
        """For each text, without the space before it: ids and byte lengths of A and B, and whether both give its bytes and
        the space's."""
        a = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        b = self.b.encode(texts, num_threads=1)
        for t, x, y in zip(texts, a, b, strict=True):
            p, q = [self.a_bytes[i] for i in x.ids], [self.b_bytes[i] for i in y]
            raw = b" " + t.encode()
            yield x.ids, [len(k) for k in p], y, [len(k) for k in q], b"".join(p) == raw and b"".join(q) == raw

    def encode_row(self, words: list[str]) -> list[pa.ListArray] | None:
        """Ids and lengths of both sides of many words as lists, encoded as one text and cut at the words' ends; None
        if they don't come out whole."""
        text = " ".join(words)
        raw = (" " + text).encode()
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        out = []
        for ids, table, lens in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes, self.a_lens), (self.b.encode(text), self.b_bytes, self.b_lens)):
            if b"".join([table[i] for i in ids]) != raw:
                return None
            flat = np.array(ids, np.int32)
            at = np.cumsum(lens[flat])
            cut = np.searchsorted(at, ends)
            if (at[cut] != ends).any():
                return None
            off = pa.array(np.concatenate([[0], cut + 1]).astype(np.int32))
            out += [pa.ListArray.from_arrays(off, pa.array(flat)), pa.ListArray.from_arrays(off, pa.array(lens[flat]))]
        return out


@lru_cache(maxsize=1)
def _loaded(a: str, b: bytes) -> Tokenizers:
    """One pair of tokenizers a worker process."""
    return Tokenizers(a, b)


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, without the space before each; none of a null or empty text."""
    uneven = pc.fill_null(pc.match_substring_regex(texts, UNEVEN), False).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts, " ")
    odd = [[w[1:] for w in WORDS.split(" " + t)] for t in texts.filter(pa.array(uneven)).to_pylist()]
    at = np.arange(len(texts))
    at[uneven] = len(texts) + 1 + np.arange(len(odd))
    at[pc.fill_null(pc.equal(pc.binary_length(texts), 0), True).to_numpy(zero_copy_only=False)] = len(texts)
    return pa.concat_arrays([parts, pa.array([[], *odd], parts.type)]).take(pa.array(at))


def code_chunks(docs: DataFrame, scratch: C.Scratch, p: Pair, split: bool) -> tuple[DataFrame, DataFrame]:
    """(chunk, doc_id, codes) of every row and (part, code, word), part a chunk: codes are the words of a text in order, each without the
    space before it. A text that is null, empty or not valid UTF-8 has none."""
    C.small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.is_valid_utf8(text), text).alias("text"))
    names = ["kind", "chunk", "doc_id", "codes", "code", "word"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.string()]

    def whole(texts: pa.Array) -> pa.ListArray:
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, texts.filter(some))

    def coded(chunk: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        lists = split_words(texts) if split else whole(texts)
        flat = lists.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int32)
        k, words = len(ids), flat.dictionary.cast(pa.string())
        null = lambda t, m: pa.nulls(m, t)
        yield pa.RecordBatch.from_arrays([pa.array(["doc"] * k, types[0]), pa.array([chunk] * k, types[1]), ids, pa.ListArray.from_arrays(ends, flat.indices), null(types[4], k), null(types[5], k)], names=names)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(["word"] * m), pa.array([chunk] * m, types[1]), null(types[2], m), null(types[3], m), pa.array(range(i, i + m), types[4]), part], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, size = TaskContext.get().partitionId() << 32, 0, 0
        held: list[pa.RecordBatch] = []
        column = lambda c, t: pa.concat_arrays([b.column(c).cast(t) for b in held])
        for batch in batches:
            if size and size + batch.nbytes > p.chunk_bytes:
                yield from coded(base + n, column("doc_id", types[1]), column("text", pa.large_string()))
                held, size, n = [], 0, n + 1
            held.append(batch)
            size += batch.nbytes
        if size:
            yield from coded(base + n, column("doc_id", types[1]), column("text", pa.large_string()))

    made = rows.mapInArrow(run, "kind string, chunk long, doc_id long, codes array<int>, code int, word string")
    # a chunk is one task's, so its rows are written to their bucket as they come
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = scratch.save_buckets(made, "codes", "chunk", n, "kind")
    lists = docs.sparkSession.table(table._scratch_table).where("kind = 'word'").select(F.col("chunk").alias("part"), "code", "word")
    lists = scratch.save_buckets(lists.repartition(n, "word"), "lists", "word", n)
    C.delete(docs.sparkSession, f"{table._scratch_path}/kind=word")
    scratch.free_shuffles()
    return table.where("kind = 'doc'").select("chunk", "doc_id", "codes"), lists


def tokenise(words: DataFrame, a: str, b: bytes) -> DataFrame:
    """(word, a, a_len, b, b_len, ok) of each row of ``words(word)``: ids and byte lengths, and whether both sides' bytes are
    the word's."""
    files = words.sparkSession.sparkContext.broadcast((a, b))  # the two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(*files.value)
        ints, names = pa.list_(pa.int32()), ["word", "a", "a_len", "b", "b_len", "ok"]
        for batch in batches:
            # words that begin with a visible character and don't end with a space may stand in a row
            word = batch.column("word")
            plain = pc.invert(pc.match_substring_regex(word, r"^$|^[\x00-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{3000}]| $|" + SPACE))
            alone = word.filter(pc.invert(plain))
            word = word.filter(plain)
            for i in range(0, len(word), 2000):
                part = word.slice(i, 2000)
                row = t.encode_row(part.to_pylist())
                if row is None:
                    alone = pa.concat_arrays([alone, part])
                else:
                    yield pa.RecordBatch.from_arrays([part, *row, pa.array(np.ones(len(part), bool))], names=names)
            for i in range(0, len(alone), 2000):
                part = alone.slice(i, 2000)
                cols = list(zip(*t.encode(part.to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part, *(pa.array(c, ints) for c in cols[:4]), pa.array(cols[4], pa.bool_())], names=names)

    return words.mapInArrow(run, "word string, a array<int>, a_len array<int>, b array<int>, b_len array<int>, ok boolean")


@contextmanager
def _joined_in_place(spark: SparkSession):
    """Plans made inside let a join on (word, end) use rows that lie by word already."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def aligned(tokens: DataFrame) -> DataFrame:
    """(word, gid, a_from, a_to, b_from, b_to): the groups of each row of ``tokens(word, a, a_len, b, b_len)`` whose two sides
    have equal bytes, as ranges of places of both sides (from excluded). A group ends where a token of A and one of B end.
    Rows lie by word throughout."""
    by = W.partitionBy("word")

    def ends(side: str) -> DataFrame:
        one = tokens.select("word", F.posexplode(f"{side}_len").alias("pos", "len"))
        return one.select("word", (F.col("pos") + 1).alias(f"{side}_to"), F.sum("len").over(by.orderBy("pos")).alias("end"))

    cuts = ends("a").join(ends("b").hint("merge"), ["word", "end"])
    along = by.orderBy("end")
    before = lambda c: F.lag(c, 1, 0).over(along)
    return cuts.select("word", F.row_number().over(along).alias("gid"), before("a_to").alias("a_from"), "a_to", before("b_to").alias("b_from"), "b_to")


def word_facts(tokens: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """(word, ok, n_a, n_b, n_groups, groups, pairs) of each of ``tokens``: groups as text, pairs of every link, as often
    as they occur, as a * size_b + b; without groups where not ok."""
    kind = "int" if size_a * size_b < 1 << 31 else "long"
    ranges = aligned(tokens.where("ok")).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("gid", "a_from", "a_to", "b_from", "b_to"))).alias("r"))
    rows = tokens.join(ranges.hint("merge"), "word", "left")
    part = lambda side: F.transform("r", lambda g: F.slice(side, g[f"{side}_from"] + 1, g[f"{side}_to"] - g[f"{side}_from"]))
    rows = rows.select("word", "ok", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size("r").alias("n_groups"), F.arrays_zip(part("a").alias("a"), part("b").alias("b")).alias("g"))
    text = F.array_join(F.transform("g", lambda g: F.concat(F.array_join(g["a"], ","), F.lit("|"), F.array_join(g["b"], ","))), ";")
    links = F.flatten(F.transform("g", lambda g: F.flatten(F.transform(g["a"], lambda x: F.transform(g["b"], lambda y: x.cast(kind) * F.lit(size_b).cast(kind) + y)))))
    return rows.select("word", "ok", "n_a", "n_b", "n_groups", text.alias("groups"), links.alias("pairs"))


def _by_code(entries: pa.Table) -> pa.Table:
    return entries.take(pa.array(np.argsort(entries.column("code").to_numpy(), kind="stable")))


def _rows(docs: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """(ids, codes, ends) of a chunk's documents."""
    col = docs.column("codes").combine_chunks()
    ends = col.offsets.to_numpy()
    return docs.column("doc_id").to_pylist(), col.values.to_numpy(zero_copy_only=False), ends


def _count_pairs(docs: pa.Table, entries: pa.Table) -> pa.Table:
    """(pair, n): in how many of a chunk's documents a pair is linked."""
    entries = _by_code(entries.select(["code", "pairs"]))
    col = entries.column("pairs").combine_chunks()
    ok = col.is_valid().to_numpy(zero_copy_only=False)
    del entries
    off = col.offsets.to_numpy()
    named = col.values.dictionary_encode()
    flat, names = named.indices.to_numpy(zero_copy_only=False), named.dictionary
    hits = np.zeros(len(names), np.int64)
    _, codes, ends = _rows(docs)
    for i, j in zip(ends[:-1], ends[1:], strict=True):
        u = np.unique(codes[i:j])
        if len(u) and ok[u].all():
            lens = off[u + 1] - off[u]
            at = np.repeat(off[u] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            hits[np.unique(flat[at])] += 1
    some = pa.array(hits > 0)
    return pa.table({"pair": names.filter(some).cast(pa.int64()), "n": pa.array(hits).filter(some)})


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _sum_up(docs: pa.Table, entries: pa.Table) -> pa.Table:
    """A row for each of a chunk's documents. ``facts`` of a word: SUMS and its groups as one text, null if it has none."""
    entries = _by_code(entries.select(["code", "facts"]))
    parts = pc.split_pattern(pc.fill_null(entries.column("facts").combine_chunks(), "0 0 0 0 0 0 "), " ")
    ok = entries.column("facts").is_valid().to_numpy()
    facts = np.stack([pc.list_element(parts, k).cast(pa.int64()).to_numpy() for k in range(len(SUMS))], axis=1)
    text = pc.list_element(parts, len(SUMS)).to_pylist()
    ids, codes, ends = _rows(docs)
    sums, shas = np.zeros((len(ids), len(SUMS)), np.int64), []
    for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        c = codes[i:j]
        if not len(c) or not ok[c].all():
            shas.append("")
            continue
        sums[k] = facts[c].sum(axis=0)
        shas.append(hashlib.sha256(";".join([text[x] for x in c.tolist()]).encode()).hexdigest())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), **{c: pa.array(sums[:, q]) for q, c in enumerate(SUMS)}, "groups_sha256": pa.array(shas, pa.string())})


def align(docs: DataFrame, p: Pair = Pair()) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    A encodes a space and the text, B the text, to which it adds a space itself; special tokens' names in a text are plain
    text. A group is what lies between two byte offsets at which tokens of both end; all tokens of A in a group are linked
    with all of B. The count of a pair of ids is the number of rows that hold it linked; n_best counts the links whose pair
    no other pair of its A id exceeds, count_sum adds up the counts of all links. Texts that are null, empty, not valid
    UTF-8, or that one side changes (its bytes aren't those of a space and the text) have zeros and ''. Repeated rows count
    each. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    with open(p.a, encoding="utf-8") as f, open(p.b, "rb") as g:  # the tokenizers' own files, on the driver
        a, b = f.read(), g.read()
    t = Tokenizers(a, b)
    size_b = len(t.b_bytes)
    coded, lists = code_chunks(docs, scratch, p, t.splits())
    # lists, words and their facts lie by word, so that they meet without moving
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = tokenise(lists.select("word").distinct(), a, b).repartition(n, "word")
    words = scratch.save_buckets(words, "words", "word", n)
    scratch.free_shuffles()
    with _joined_in_place(spark):
        facts = scratch.save_buckets(word_facts(words, len(t.a_lens), size_b), "facts", "word", n)
    scratch.drop(words)
    scratch.free_shuffles()
    met = lists.join(facts.select("word", "pairs"), "word").select("part", "code", "pairs")
    parts = coded.groupBy("chunk").cogroup(met.groupBy("part")).applyInArrow(_count_pairs, "pair long, n long")
    counts = scratch.save(parts.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    scratch.free_shuffles()
    top = F.max("n").over(W.partitionBy(F.expr(f"pair div {size_b}")))
    ranked = counts.select("pair", "n", (F.col("n") == top).cast("long").alias("best"))
    if counts.count() <= MANY:
        ranked = F.broadcast(ranked)
    links = facts.where("ok").select("word", F.explode("pairs").alias("pair")).join(ranked, "pair")
    sums = links.groupBy("word").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    # one text, which takes less room on its way to the chunks than seven columns
    told = F.when(F.col("ok"), F.concat_ws(" ", *SUMS, "groups")).alias("facts")
    full = scratch.save_buckets(facts.drop("pairs").join(sums.hint("merge"), "word", "left").select("word", told).repartition(n, "word"), "sums", "word", n)
    scratch.drop(facts)
    scratch.free_shuffles()
    met = lists.join(full, "word").select("part", "code", "facts")
    return coded.groupBy("chunk").cogroup(met.groupBy("part")).applyInArrow(_sum_up, "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string")
