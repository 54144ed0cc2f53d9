import hashlib
import os
import random
from collections import Counter

import pyarrow as pa
import pytest

from shellgraph.llm import token_align as M

pytestmark = pytest.mark.skipif(not os.path.isdir(M.FOLDER), reason="vocabularies are not here")


@pytest.fixture(scope="module")
def tok():
    return M.Tokenizers(open(M.Pair().a, encoding="utf-8").read(), open(M.Pair().b, "rb").read())


def brute(tok, texts):
    """Whole texts, encoded and aligned one by one."""
    docs = []
    for t in texts:
        groups = []
        if t:
            ((ai, al, bi, bl, ok),) = list(tok.encode([t]))
            if ok:
                i = j = x = y = 0
                ga, gb = [], []
                while i < len(ai) or j < len(bi):
                    if x <= y and i < len(ai):
                        ga.append(ai[i])
                        x += al[i]
                        i += 1
                    else:
                        gb.append(bi[j])
                        y += bl[j]
                        j += 1
                    if x == y and ga and gb:
                        groups.append((ga, gb))
                        ga, gb = [], []
        docs.append(groups)
    count = Counter(p for g in docs for p in {(a, b) for x, y in g for a in x for b in y})
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for g in docs:
        links = [(a, b) for x, y in g for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def compare(spark, tok, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, word string, code int")
    got = {r.doc_id: tuple(r[c] for c in [*M.SUMS, "groups_sha256"]) for r in M.align(df.repartition(3), M.Pair(**options)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(tok, texts)


def test_words_join_to_whole_texts(tok):
    """Tokens of the words in a row are those of the text, with all kinds of white space."""
    r = random.Random(4)
    parts = [" ", "  ", "\n", "\t", " ", " ", "\r\n", "a", "the", "Straße", "don't", "12", "!?", "漢字", "😀", "▁", "<s>", "</s>", "<|endoftext|>", "\x00", "\x1c", "\x85", "_", "é"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        (whole,) = list(tok.encode([text]))
        (split,) = M.split_words(pa.array([text])).to_pylist()
        assert " ".join(split) == text
        words = list(tok.encode(split))
        assert all(w[4] for w in words) == whole[4], repr(text)
        if whole[4]:
            assert [x for w in words for x in w[0]] == whole[0] and [x for w in words for x in w[2]] == whole[2], repr(text)


def test_against_brute_force(spark, tok):
    r = random.Random(1)
    word = ["the", "there", "Unbelievable", "naïve", "x", "12.5", "(see", "end.", "漢字", "two  spaces", "line\nbreak", "😀😀"]
    texts = [" ".join(r.choice(word) for _ in range(r.randint(1, 30))) for _ in range(60)]
    odd = [None, "", " ", "  lead", "trail ", "\n", "a▁b", "<s> <|endoftext|>", " ", "é", "\x00"]
    compare(spark, tok, texts + odd + ["same text"] * 40)
    compare(spark, tok, texts[:20] + odd, chunk_bytes=50)


def test_without_splitting(spark, tok, monkeypatch):
    monkeypatch.setattr(M.Tokenizers, "splits", lambda self: False)
    compare(spark, tok, ["one two three", "two three", None, "a  b c"])


def test_odd_rows(spark, tok, odd, none):
    rows = odd.collect()
    got = M.align(odd).collect()
    want = brute(tok, [r.text for r in rows])
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((r.doc_id, *w)) for r, w in zip(rows, want, strict=True))
    assert M.align(none).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_query(spark, tok):
    from shellgraph.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.queries()["op12_token_alignment"](spark, "/root/testdata/sf0.001").collect()
    want = brute(tok, [r.text for r in rows])
    assert sorted(tuple(r) for r in got) == sorted((r.doc_id, *w) for r, w in zip(rows, want, strict=True))
