"""Language of every word by a linear-chain conditional random field, and of whole documents.

A word's features are affixes (to four letters), letter n-grams (two and three, with word ends), its own form if it is
in a language's lexicon, and the lexicons that it is in; they are hashed to a weight table. Transition weights are
learned with them, from a bounded number of labelled documents (per_lang of each language, a parameter). Their whole
texts are cut to pieces, which are spliced to code-switched sequences; every word is in one. Forward-backward gives each
word's label distribution; a document gets the label with the largest mean probability over its words, and that mean as
its score.

Words are runs without white space that hold a letter. Null text, or text without a letter, is `und` with score 0. Equal
probabilities go to the first label by code point. Where nothing is labelled every document is `und`. Predictions see
the text alone; whole texts are read, a few megabytes at a time or one longer text. Repeated rows are each predicted, alike.
Held out is decided by the key; rows with a null key have a null there and aren't learned from. An empty table gives an
empty result. Extra columns stay, whatever their names, but for lang_pred and score, which are replaced. A stage returns
the columns that it got.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
BITS = 16
#: Words whose emissions a worker remembers, and words that are decoded at once.
MEMORY, AT_ONCE = 150_000, 200_000
LOWEST_SCORE = 0.5
#: Documents of a batch that are predicted together.
ROWS = 1024


def letters(token: str) -> str:
    """The token in lower case without what surrounds its letters; empty if it has none."""
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    return token[a:b].lower()


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """For distinct words, the rows of the weight table that they use and the index of the word that uses each."""
    lens = np.array([len(w) for w in words], np.int64)
    c = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.arange(len(words))
    owner = np.repeat(word, lens + 2)
    head = np.cumsum(lens + 2) - (lens + 2)
    rows, owners = [], []

    def add(kind: int, who: np.ndarray, *parts: np.ndarray) -> None:
        h = np.full(len(who), kind, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for x in parts:
            h = (h ^ x) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        rows.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(who)

    for k in (2, 3):  # n-grams
        at = np.flatnonzero(owner[k - 1 :] == owner[: len(owner) - k + 1])
        add(k, owner[at], *[c[at + j] for j in range(k)])
    for k in range(1, 5):  # affixes
        who = word[lens >= k]
        add(10 + k, who, *[c[head[who] + 1 + j] for j in range(k)])
        add(20 + k, who, *[c[head[who] + 1 + lens[who] - k + j] for j in range(k)])
    listed = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    form = np.array([zlib.crc32(words[i].encode()) for i, _ in listed], np.uint64)
    add(30, np.array([i for i, _ in listed], np.int64), form)
    for k in range(max((x.bit_length() for _, x in listed), default=0)):
        add(40 + k, np.array([i for i, x in listed if x >> k & 1], np.int64))
    return np.concatenate(rows), np.concatenate(owners)


def word_scores(weights: np.ndarray, rows: np.ndarray, owners: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Sum of each word's weights over the root of their number."""
    return np.stack([np.bincount(owners, weights[rows, k], len(share)) for k in range(weights.shape[1])], axis=1) * share[:, None]


@dataclass
class Model:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    move: np.ndarray  # from label, to label
    begin: np.ndarray
    _rows: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": {}, "_table": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        rows, owners = features(words, self.lexicon)
        return word_scores(self.weights, rows, owners, 1 / np.sqrt(np.bincount(owners, minlength=len(words)))).astype(np.float32)

    def rows(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """For each text the emission rows of its words, and the emission table. Row -1: no letter."""
        split = [x.split() for x in texts]
        if len(self._rows) > MEMORY or self._table is None:
            self._rows, self._table = {}, np.zeros((0, len(self.labels)), np.float32)
        known = self._rows
        new = list({t for tokens in split for t in tokens if t not in known})
        forms = [letters(t) for t in new]
        distinct = list(dict.fromkeys(f for f in forms if f))
        at = dict(zip(distinct, range(len(self._table), len(self._table) + len(distinct))))
        self._table = np.concatenate([self._table, self.emissions(distinct)])
        for t, f in zip(new, forms):
            known[t] = at[f] if f else -1
        return [list(map(known.__getitem__, tokens)) for tokens in split], self._table

    def forget(self) -> None:
        """Frees what was remembered: the worker goes on to other tasks."""
        self._rows, self._table = {}, None

    def word_probabilities(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Forward-backward over sequences laid end to end; first: where one begins."""
        return forward_backward(scores, first, self.move, self.begin)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out, begin, words = [], 0, 0
        for k, x in enumerate(texts):
            words += len(x) // 5
            if words > AT_ONCE:
                out += self._predict(texts[begin : k + 1])
                begin, words = k + 1, 0
        return out + self._predict(texts[begin:])

    def _predict(self, texts: list[str]) -> list[tuple[str, float]]:
        rows, table = self.rows(texts)
        lengths = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((i for r in rows for i in r), np.int64, lengths.sum())
        owner = np.repeat(np.arange(len(texts)), lengths)[flat >= 0]
        flat = flat[flat >= 0]
        if not len(flat) or not self.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        first = np.append(True, owner[1:] != owner[:-1])
        p = self.word_probabilities(table[flat], first)
        heads = np.flatnonzero(first)
        counts = np.diff(np.append(heads, len(flat)))
        mean = np.add.reduceat(p, heads, axis=0) / counts[:, None]
        best = mean.argmax(axis=1)
        found = {int(o): (self.labels[b], float(min(1.0, mean[j, b]))) for j, (o, b) in enumerate(zip(owner[heads], best))}
        return [found.get(k, (UNKNOWN, 0.0)) for k in range(len(texts))]


def forward_backward(scores: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Label probabilities of each word.

    The chain is cut into about sqrt(n) chunks of sqrt(n) words. Products of the transfer matrices of each chunk carry
    messages over chunk ends, so every step works on all chunks at once, however long one text is.
    """
    n, labels = scores.shape
    width = max(1, int(np.sqrt(n)))
    chunks = -(-n // width)
    pad = chunks * width - n
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    e = np.concatenate([e, np.ones((pad, labels))]).reshape(chunks, width, labels)
    cut = np.concatenate([first, np.ones(pad, bool)]).reshape(chunks, width)
    step, start = np.exp(move - move.max()), np.exp(begin - begin.max())
    product = np.broadcast_to(np.eye(labels), (chunks, labels, labels)).copy()
    for c in range(width):
        product = np.where(cut[:, c, None, None], product.sum(axis=2, keepdims=True) * start, product @ step) * e[:, c, None, :]
        product /= product.max(axis=(1, 2), keepdims=True)
    into, out = np.ones((chunks, labels)), np.ones((chunks, labels))
    for k in range(1, chunks):
        into[k] = into[k - 1] @ product[k - 1]
        into[k] /= into[k].max()
    for k in range(chunks - 2, -1, -1):
        out[k] = product[k + 1] @ out[k + 1]
        out[k] /= out[k].max()
    forward = np.empty_like(e)
    a = into
    for c in range(width):
        a = np.where(cut[:, c, None], a.sum(axis=1, keepdims=True) * start, a @ step) * e[:, c]
        a = a / a.max(axis=1, keepdims=True)
        forward[:, c] = a
    b = out
    for c in range(width - 1, -1, -1):
        forward[:, c] *= b
        after = e[:, c] * b
        b = np.where(cut[:, c, None], (after * start).sum(axis=1, keepdims=True), after @ step.T)
        b = b / b.max(axis=1, keepdims=True)
    p = forward.reshape(-1, labels)[:n]
    return p / p.sum(axis=1, keepdims=True)


def sequences(texts: list[str], langs: list[int], rng: np.random.Generator, longest: int = 64) -> list[tuple[list[str], list[int]]]:
    """Code-switched sequences of one to three pieces, one language a piece. The pieces tile the texts."""
    pieces = []
    for x, k in zip(texts, langs):
        w, at = [w for w in (letters(t) for t in x.split()) if w], 0
        while at < len(w):
            size = int(rng.integers(6, longest // 2))
            pieces.append((w[at : at + size], k))
            at += size
    order, out, at = rng.permutation(len(pieces)), [], 0
    while at < len(order):
        words, tags = [], []
        for i in order[at : (at := at + int(rng.integers(1, 4)))]:
            if len(words) + len(pieces[i][0]) > longest:
                out.append((words, tags))
                words, tags = [], []
            words = words + pieces[i][0]
            tags = tags + [pieces[i][1]] * len(pieces[i][0])
        out.append((words, tags))
    return out


def train(texts: list[str], langs: list[str], *, least: int = 12_000, batch: int = 200, rate: float = 0.08, ridge: float = 1e-4, top: int = 300, seed: int = 3) -> Model:
    """Fit weights and transitions by Adam on the conditional log-likelihood: all sequences, again until there were `least`."""
    labels = sorted(set(langs))
    tags = [labels.index(x) for x in langs]
    found = [Counter() for _ in labels]
    for x, k in zip(texts, tags):
        found[k].update(w for w in (letters(t) for t in x.split()) if w)
    lexicon: dict[str, int] = {}
    for k, c in enumerate(found):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top]:
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    rng, size = np.random.default_rng(seed), len(labels)
    data = sequences(texts, tags, rng)
    words = {w: i for i, w in enumerate(dict.fromkeys(w for s, _ in data for w in s))}
    rows, owners = features(list(words), lexicon) if words else (np.zeros(0, np.int64),) * 2
    counts = np.bincount(owners, minlength=len(words))
    share, rows = 1 / np.sqrt(np.maximum(1, counts)), rows[np.argsort(owners, kind="stable")]
    heads = np.cumsum(counts) - counts
    params = {"weights": np.zeros((1 << BITS, size)), "move": np.zeros((size, size)), "begin": np.zeros(size)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    clock = 0
    for _ in range(-(-least // len(data)) if data else 0):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), batch):
            part = [data[i] for i in order[lo : lo + batch]]
            ids = np.array([words[w] for s, _ in part for w in s])
            tag = np.array([t for _, s in part for t in s])
            first = np.concatenate([[True] + [False] * (len(s) - 1) for s, _ in part])
            met, at = np.unique(ids, return_inverse=True)
            few = counts[met]
            own = np.repeat(np.arange(len(met)), few)
            used = rows[np.arange(few.sum()) + np.repeat(heads[met] - np.cumsum(few) + few, few)]
            scores = word_scores(params["weights"], used, own, share[met])[at]
            p, pairs = _expected(scores, first, params["move"], params["begin"])
            gap = (np.eye(size)[tag] - p) / len(part)
            spread = (np.stack([np.bincount(at, gap[:, k], len(met)) for k in range(size)], axis=1) * share[met][:, None])[own]
            grads = {"weights": np.stack([np.bincount(used, spread[:, k], 1 << BITS) for k in range(size)], axis=1), "begin": gap[first].sum(axis=0)}
            inner = np.flatnonzero(~first)
            seen = np.zeros((size, size))
            np.add.at(seen, (tag[inner - 1], tag[inner]), 1.0)
            grads["move"] = (seen - pairs) / len(part)
            clock += 1
            for k, g in grads.items():
                m, v = moments[k]
                g = g - ridge * params[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[k] += rate * (m / (1 - 0.9**clock)) / (np.sqrt(v / (1 - 0.99**clock)) + 1e-8)
    return Model(labels, lexicon, params["weights"].astype(np.float32), params["move"], params["begin"])


def _expected(scores: np.ndarray, first: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word and expected transition counts, for short sequences side by side."""
    heads = np.flatnonzero(first)
    lens = np.diff(np.append(heads, len(first)))
    order = np.argsort(-lens, kind="stable")
    heads, lens = heads[order], lens[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    step, start = np.exp(move), np.exp(begin)
    forward, p = np.empty_like(e), np.empty_like(e)
    active = [int((lens > t).sum()) for t in range(int(lens[0]))]
    for t, k in enumerate(active):
        at = heads[:k] + t
        a = (start if t == 0 else forward[at - 1] @ step) * e[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    b, pairs = np.ones((len(heads), scores.shape[1])), np.zeros_like(step)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = heads[:k] + t
        q = forward[at] * b[:k]
        p[at] = q / q.sum(axis=1, keepdims=True)
        if t:
            after = e[at] * b[:k]
            joint = forward[at - 1][:, :, None] * step * after[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b[:k] = after @ step.T
            b[:k] /= b[:k].sum(axis=1, keepdims=True)
    return p, pairs


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 400, most_bytes: int = 8 << 20, **training) -> Model:
    """Train on the whole texts of at most per_lang documents of each language, and at most about most_bytes bytes of them.

    A language's documents are those with the smallest hashes of key and text, so every language that has a text has one
    at least; equal rows count once. Rows without a key aren't learned from.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.xxhash64(F.lit(5), F.col(key), F.col(text)).alias("draw"), F.octet_length(text).cast("long").alias("size"), F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    by = Window.partitionBy("lang").orderBy("draw")
    # Light rows tell the last draw of each language; each task passes on no more of them than are taken.
    light = known.groupBy("lang", "draw").agg(F.first("size").alias("size")).withColumn("n", F.row_number().over(by)).filter(F.col("n") <= per_lang)
    before = F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = light.withColumn("before", before).filter(F.col("before") < most_bytes).select("lang", "draw")
    rows = known.join(taken, ["lang", "draw"]).dropDuplicates(["lang", "draw"]).select("k", "lang", "text").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.k, r.text))
    return train([r.text for r in rows], [r.lang for r in rows], **training)


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop(*[c for c in docs.columns if c in ("lang_pred", "score")])
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            got = found.predict([x or "" for x in b.column(at).to_pylist()])
            columns = [*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "lang_pred", "score"])
        found.forget()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def label_words(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each word with a letter: key, position, word, lang, probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for k, x in zip(b.column(0), b.column(1).to_pylist()):
                words = [(i, w) for i, w in enumerate((x or "").split()) if letters(w)]
                if not words or not m.labels:
                    continue
                p = m.word_probabilities(m.emissions([letters(w) for _, w in words]), np.arange(len(words)) == 0)
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([k.as_py()] * len(words), b.schema.field(0).type), pa.array([i for i, _ in words], pa.int64()), pa.array([w for _, w in words]),
                    pa.array([m.labels[j] for j in best]), pa.array(p[np.arange(len(words)), best]),
                ], names=[key, "position", "word", "lang", "probability"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, position long, word string, lang string, probability double")


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, recognised with a score of LOWEST_SCORE or more.

    Documents without a letter go. Nulls, ties, repeats and empty tables as in predict(); columns stay as they are.
    """
    model = fit(docs.filter(~held_out()))
    found = predict(common.carried(docs, text=F.col("text")), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LOWEST_SCORE)).select("row.*")


def op7_word_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
