"""Phrases against a count of every phrase by plain loops, and tiles against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from barloom.llm import collocation


def brute(rows, least, held, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        rows = []
        for p, a in cand.items():
            if 100 * most[p] >= held * a and most[p]:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(11)
    words = ["new", "york", "city", "hall", "of", "the", "é", "ÀB", "x1", "\xa0y", "日本", "a"]
    chunks = ["new york city hall", "of the", "New York", "the city", "a a a a a", "日本 é", "x1 ÀB \xa0y"]
    texts = [None, "", " ", "...", "one"]
    for _ in range(500):
        texts.append("".join(rng.choice(chunks if rng.random() < 0.6 else words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\x0b"]) for _ in range(rng.randint(0, 40))))
    texts += ["the end " * 9000, texts[40], texts[40]]
    return [(t, rng.choice(["en", "en", "fr", None])) for t in texts]


def rows_of(df):
    return sorted((r["lang"], r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_phrases_equal_plain_counts(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(t, lang, "clash", 1, 2) for t, lang in rows], "text string, lang string, word string, code int, n int").repartition(3)
    assert rows_of(collocation.collocations(docs)) == brute(rows, 30, 80, 2000)
    got = rows_of(collocation.collocations(docs, least=5, top=7, held=50))
    assert got == brute(rows, 5, 50, 7) and len(got) == 21


def test_small_chunks_and_dense_tiles_give_the_same(monkeypatch):
    draw = np.random.default_rng(1)
    i, j = np.minimum(draw.geometric(0.002, (2, 60_000)), 2999)
    want = Counter(zip(i.tolist(), j.tolist()))
    for dense in (10, 2000, 10**9):
        monkeypatch.setattr(collocation, "DENSE", dense)
        codes, heads, tails, counts = collocation.count_pairs(i, j, 3000)
        assert dict(zip(zip(heads.tolist(), tails.tolist()), counts.tolist())) == want and (heads[codes] == i).all() and (tails[codes] == j).all()


def test_no_phrases(spark):
    for rows in ([], [(None, "en"), ("", None)], [("only one here", "en")]):
        assert collocation.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_exact_scores_of_large_counts(spark):
    from pyspark.sql import functions as F

    a, l, r = 9 * 10**18, 9_223_372_036_854_775_806, 9_100_000_000_000_000_001
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocation._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 2_000_000 * a // (l + r)


def test_pairs_come_in_bounded_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(collocation, "AT_ONCE", 100, raising=False)
    stream = np.random.default_rng(1).integers(0, 60, 5000).astype(np.int32)
    known = pa.table({"own": np.arange(1, 60, dtype=np.int32), "f": np.arange(1, 60), "id": np.arange(1, 60) * 7})
    out = collocation._pair_streams(True)((pa.scalar(3),), pa.table({"stream": [collocation.packed(stream)]}), known)
    assert max(b.num_rows for b in out.to_batches()) <= 100
    a, b = stream[:-1].astype(int), stream[1:].astype(int)
    pairs, counts = np.unique(np.stack([a, b])[:, (a > 0) & (b > 0)] * 7, axis=1, return_counts=True)
    got = sorted(zip(*(out[c].to_pylist()[1:] for c in ("head", "tail", "n"))))
    assert got == list(zip(*pairs.tolist(), counts.tolist()))
