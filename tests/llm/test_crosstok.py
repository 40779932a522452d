"""Alignment of two vocabularies against whole texts encoded by fresh libraries and compared byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from barloom.llm import crosstok, tokens

A, B = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
PARTS = ["the", "Stone", "naïve", "日本語", "ｗｉｄｅ", "🙂🙃", "▁x", "<|endoftext|>", "<s>", "<0x41>", "x\0y", "é́", "don't", "123", "--", "…", "　", "\xa0", "​", "İ", "한국", "\x1f", "\x85", "aaaaaaaaaaaaaaaaaaaaaaaaa"]


def texts():
    rng = random.Random(3)
    made = [None, "", " ", "  ", "\n", " \n ", "a", "a ", "a  ", " a", "<|endoftext|>", "▁", "a▁ b", "the " * 50, "word " * 20_000, "x" * 5000, "日" * 300]
    for _ in range(400):
        made.append("".join(rng.choice(PARTS) + rng.choice(["", " ", " ", " ", "  ", "\n", " \n", "\t", ". "]) for _ in range(rng.randint(1, 30))))
    return [*made, made[-1], made[-1]]


def brute(all_texts):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printed = {chr(tokens._BYTES.get(x, x)): x for x in range(256)}
    raw = lambda p: bytes([int(p[1:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    out = []
    for t in all_texts:
        row = None
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False), b.encode(t)
            xb, yb = [bytes(printed[c] for c in w) for w in x.tokens], [raw(b.id_to_piece(i)) for i in y]
            if b"".join(xb) == b"".join(yb) == (" " + t).encode():
                ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] if len(s) < 300 else list(__import__("itertools").accumulate(map(len, s))) for s in (xb, yb)]
                both, groups = set(ends[0]) & set(ends[1]), defaultdict(lambda: ([], []))
                marks = sorted(both)
                at = {}
                for side, (ids, es) in enumerate(((x.ids, ends[0]), (y, ends[1]))):
                    k = 0
                    for i, e in zip(ids, es):
                        while marks[k] < e:
                            k += 1
                        groups[k][side].append(i)
                row = (len(x.ids), len(y), [groups[k] for k in sorted(groups)])
        out.append(row)
    counts = Counter()
    for row in out:
        if row:
            counts.update({(p, q) for g in row[2] for p in g[0] for q in g[1]})
    best = defaultdict(int)
    for (p, _), c in counts.items():
        best[p] = max(best[p], c)
    rows = []
    for row in out:
        if not row:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        linked = [(p, q) for g in row[2] for p in g[0] for q in g[1]]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in row[2])
        rows.append((row[0], row[1], len(row[2]), len(linked), sum(counts[l] == best[l[0]] for l in linked), sum(counts[l] for l in linked), hashlib.sha256(text.encode()).hexdigest()))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts())], "doc_id long, text string, chunk string, place string").repartition(3)


def test_statistics_equal_whole_texts(docs):
    got = {r.doc_id: tuple(r[1:]) for r in crosstok.statistics(docs, A, B).collect()}
    want = brute(texts())
    assert [(i, got[i], w) for i, w in enumerate(want) if got[i] != w] == [] and len(got) == len(want)
    assert sum(w[6] != "" for w in want) > 200 and sum(w[6] == "" for w in want) > 30


def test_spans_tile_the_text(docs):
    for r in crosstok.spans(docs, A, B).collect():
        t = texts()[r.doc_id]
        if r.a_ids:
            size = len((" " + t).encode())
            assert r.a_ends[-1] == r.b_ends[-1] == r.cuts[-1] == size and set(r.cuts) == set(r.a_ends) & set(r.b_ends)
        else:
            assert not t or "▁" in t


def test_small_chunks_and_memory_give_the_same(spark, docs, tmp_path):
    own = crosstok.aligner(A, B)
    known = [t for t in texts() if t and len(t) < 300]
    memory = crosstok._Memory(own)
    whole = crosstok._chunk_rows(memory, 0, list(range(len(known))), known).slice(0, len(known)).to_pylist()
    for k, t in enumerate(known):
        one = crosstok._chunk_rows(crosstok._Memory(own), 7, [k], [t]).to_pylist()[0]
        assert {c: one[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")} == {c: whole[k][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}


def test_memory_keeps_what_most_chunks_have(monkeypatch):
    """What was met first but once goes, what many chunks have stays, and chunks come out the same after that."""
    monkeypatch.setattr(crosstok, "MEMORY", 6)
    memory = crosstok._Memory(crosstok.aligner(A, B))
    chunks = [["one-off first word 日本語"], ["late naïve"], ["late naïve again"], ["naïve late 🙂 more"], ["late naïve again more"]]
    for k, some in enumerate(chunks):
        got = crosstok._chunk_rows(memory, k, [0], some)
        assert got.equals(crosstok._chunk_rows(crosstok._Memory(memory.own), k, [0], some))
        memory.shrink()
        assert len(memory.slots) <= 6 and len(memory.written) == len(memory.numbers) == len(memory.uses) == len(memory.slots) == len(memory.bounds) - 1
    assert {" late", " naïve"} <= set(memory.slots) and " one-off" not in memory.slots
    assert crosstok._memory(A, B) is crosstok._memory(A, B)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.statistics(none, A, B).count() == 0 and crosstok.spans(none, A, B).count() == 0


def test_common_ends_and_units_are_those_of_the_plain_way():
    import re

    rng = np.random.default_rng(3)
    empty = np.empty(0, np.int64)
    for a, b in [(empty, empty), (empty, np.array([0, 4])), *((rng.integers(0, 50, n), rng.integers(0, 90, 40)) for n in (1, 30, 200))]:
        assert crosstok._common(a, b).tolist() == np.intersect1d(a, b).tolist()
    plain = re.compile("(?<=[!-~\xa1-ɏ‐-‧、-鿿가-힣]) ")
    for _ in range(300):
        text = "".join(rng.choice(list("  aé—語한\n\t　­"), 30))
        assert crosstok._UNIT.split(" " + text) == plain.split(" " + text)
