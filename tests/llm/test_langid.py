import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shellgraph.llm import common as C
from shellgraph.llm import langid as M


def stream(text):
    out = [" "] * 3
    for c in text:
        import unicodedata

        kind = unicodedata.category(c)[0]
        c = (c.lower() if len(c.lower()) == 1 else c) if kind in "LM" else " "
        if not (c == " " and len(out) > 3 and out[-1] == " "):
            out.append(c)
    return "".join(out)


class Slow:
    """Interpolated Kneser-Ney by the book, for one language, over the vocabulary of all."""

    def __init__(self, texts, vocab):
        top = Counter(s[i - 3 : i + 1] for s in map(stream, texts) for i in range(3, len(s)))
        self.c = {4: dict(top)}
        for n in (3, 2, 1):
            self.c[n] = dict(Counter(g[1:] for g in self.c[n + 1]))
        self.d, self.total, self.kinds, self.vocab = {}, {}, {}, vocab
        for n, c in self.c.items():
            one, two = (sum(v == k for v in c.values()) for k in (1, 2))
            self.d[n] = one / (one + 2 * two) if one and two else 0.75
            self.total[n], self.kinds[n] = Counter(), Counter()
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.kinds[n][g[:-1]] += 1

    def p(self, g):
        n = len(g)
        if not n:
            return 1 / (self.vocab + 1)
        lower, total = self.p(g[1:]), self.total[n][g[:-1]]
        if not total:
            return lower
        return max(self.c[n].get(g, 0) - self.d[n], 0) / total + self.d[n] * self.kinds[n][g[:-1]] / total * lower

    def entropy(self, text):
        s = stream(text)
        return -sum(math.log(self.p(s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(s) - 3)


LANGS = {"aa": "abracadabra alakazam banana ananas kakadu", "bb": "the quick brown fox jumped over dogs", "cc": "écoute là-bas où été naïve çà"}


def texts(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return [" ".join(rng.choices(LANGS[lang].split(), k=rng.randrange(3, 12))) + rng.choice([".", "! 12", ""]) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, lang) for lang in LANGS for t in texts(lang, 60, 1)] + [(None, "aa"), ("ignored", None)]
    return M.train(spark.createDataFrame(rows, "text string, lang string"))


def test_same_as_the_book(model):
    slow = [Slow(texts(lang, 60, 1), 0) for lang in LANGS]
    vocab = len(set().union(*(s.c[1] for s in slow)))
    for s in slow:
        s.vocab = vocab
    probe = [*texts("aa", 5, 2), *texts("cc", 5, 2), "zzz quark", "été abra", "漢字 x"]
    data, off = C.text_buffer(pa.array(probe))
    h, _, _ = model.entropies(data, off)
    want = np.array([[s.entropy(t) for s in slow] for t in probe])
    assert model.langs == sorted(LANGS) and np.allclose(h, want, rtol=1e-4)


def test_blocks_change_nothing(model, monkeypatch):
    texts = ["", "the cat sat on the mat " * 40, None, "der hund", "7", "le chat " * 9]
    data, off = C.text_buffer(pa.array(texts))
    whole = model.entropies(data, off)
    monkeypatch.setattr(M, "AT_ONCE", 7)
    for a, b in zip(whole, model.entropies(data, off), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-6)


def test_bound_keeps_rare_languages(spark):
    """With a bound on what is broadcast at once the model is the same, and a language of few texts keeps its own."""
    rows = [(t, lang) for lang, n in (("aa", 400), ("bb", 400), ("cc", 3)) for t in texts(lang, n, 1)]
    df = spark.createDataFrame(rows, "text string, lang string")
    whole, cut = M.train(df), M.train(df, max_cells=120)
    probe = [*texts("aa", 5, 2), *texts("cc", 30, 2), "zzz quark", "", "漢字 x"]
    data, off = C.text_buffer(pa.array(probe))
    assert len(whole.shards) == 1 and len(cut.shards) > 2
    assert np.allclose(whole.entropies(data, off)[0], cut.entropies(data, off)[0], rtol=1e-9)
    got = M.predict(spark.createDataFrame([(t,) for t in probe[5:35]], "text string"), cut).collect()
    assert np.mean([r.lang_pred == "cc" for r in got]) > 0.97


def test_held_out(spark, model):
    rows = [(t, lang) for lang in LANGS for t in texts(lang, 40, 7)]
    got = M.predict(spark.createDataFrame(rows, "text string, lang string"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.rejected for r in got]) < 0.03


def test_rejects_what_is_no_language(spark, model):
    rng = random.Random(1)
    noise = ["".join(rng.choice("qwxzjkvhp") for _ in range(300)) for _ in range(10)]
    got = M.predict(spark.createDataFrame([(t,) for t in noise], "text string"), model).collect()
    assert all(r.rejected for r in got)


def test_calibrated_on_all_rows(spark):
    """Ranges come from every text, each distinct one once, however many there are."""
    rows = sorted({(f"{t} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} {'uvwxyz'[i % 6]}", lang) for lang in ("aa", "bb") for i, t in enumerate(texts(lang, 4500, 3))})
    assert len(rows) > 8000
    model = M.train(spark.createDataFrame([*rows, *rows[:500]], "text string, lang string"))
    h, n, _ = model.entropies(*C.text_buffer(pa.array([t for t, _ in rows])))
    for k, lang in enumerate(model.langs):
        mine = np.array([x == lang for _, x in rows])
        own, size = h[mine, k], n[mine]
        mean = np.average(own, weights=size)
        off = (own - mean) ** 2
        want = [mean, max(off[size >= np.median(size)].mean(), 0.15**2), max((off * np.minimum(size, 200)).mean(), 1e-2)]
        np.testing.assert_allclose([model.mean[k], *model.spread[:, k]], want, rtol=1e-6)


def test_odd(spark, odd, none):
    model = M.train(odd)
    rows = M.predict(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and r.rejected))
    assert M.predict(none, model).collect() == []
    nothing = M.train(none)
    assert {r.lang_pred for r in M.predict(odd, nothing).collect()} == {"und"}
    kept = M.predict(odd, model, only_kept=True)
    assert kept.schema == odd.schema and kept.count() <= sum(r.lang_pred != "und" for r in rows)
