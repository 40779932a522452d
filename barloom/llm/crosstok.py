"""Alignment of the tokens of two vocabularies: a byte-level one (A, tokenizers) and one of pieces (B, sentencepiece).

A encodes a space and the text, B the text (it adds that space itself). Tokens' own spans say where they end: A's are
offsets in characters, B's in bytes. Where a token of each ends cleanly at one place (its span isn't empty and the next
token begins there), the text is cut. What lies between two such cuts and holds a token without a clean end, as pieces
of a character do and bytes that B falls back on, is refined: there the ends are those of the tokens' decoded bytes. The
tokens between two common ends are a group, and each of its A tokens is linked with each of its B tokens.

Neither vocabulary joins a space to a letter before it. So a text is cut into units (a space and what follows, up to the
next space after a visible character), which are aligned once and remembered by the worker, from task to task: no more
than MEMORY units beyond those of the chunk in hand, and of those the ones that most chunks had. A vocabulary that has tokens with a space after a letter gets whole texts.

Links are counted without shuffling a text's links: documents are put together to chunks of some megabytes, whose
distinct pairs of ids are numbered. A pair has one row for each chunk with the number of documents that hold it; these
rows are added up by pair, get the corpus' counts back, and each chunk is scored with the counts of its own pairs.
What is broadcast is the best count of each A id: at most as many rows as A has ids.

Texts that are null, empty, or whose decoded bytes differ from a space and the text (as of U+2581) have no tokens.
Repeated rows are documents of their own; an empty table gives none. Only the key and the text are read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Bytes of texts of a chunk, units that a worker remembers when it begins one.
CHUNK, MEMORY = 8 << 20, 400_000
#: Units aligned at once, documents cut into units at once, links of a group from which its ids are counted first.
AT_ONCE, DOCS, LARGE = 4096, 64, 64

#: A space after a visible character. Characters outside these ranges don't count: a unit may be longer than it must be.
_UNIT = re.compile(" (?<=[!-~\xa1-ɏ‐-‧、-鿿가-힣] )")


@functools.cache
def _special_as_text(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


class Aligner:
    """align(units): tokens of both vocabularies with their byte ends. Every unit begins with a space."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = _special_as_text(a_path), SentencePieceProcessor(model_file=b_path)
        byte_of = {chr(tokens._BYTES.get(b, b)): b for b in range(256)}
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [special.get(i) or bytes(byte_of[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        b = self.b
        self.b_bytes = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        joined = re.compile(r"[^\s] |[^▁]▁")
        self.by_unit = self.a.normalizer is None and type(self.a.pre_tokenizer).__name__ == "ByteLevel" and not any(joined.search(x) for x in chain((t.decode("utf-8", "replace") for t in self.a_bytes), map(b.id_to_piece, range(b.vocab_size()))))

    def units(self, text: str) -> list[str]:
        """The parts of a space and a text that are encoded each by itself; each begins with a space."""
        if not self.by_unit:
            return [" " + text]
        first, *rest = _UNIT.split(" " + text)
        found = [first, *(" " + r for r in rest)]
        if len(found) > 1 and found[-1] == " ":
            found[-2:] = [found[-2] + " "]
        return found

    def align(self, units: list[str]) -> tuple[tuple, tuple, np.ndarray, np.ndarray]:
        """(ids, bounds by unit, ends) of A and of B, where units begin in bytes, and whether both decode to the unit."""
        raw = [u.encode() for u in units]
        base = np.cumsum([0, *map(len, raw)])
        flat = chain.from_iterable
        a_found = self.a.encode_batch(units, add_special_tokens=False)
        b_found = self.b.encode([u[1:] for u in units], return_type="offset_mapping", return_bytes=True, num_threads=1)
        a_ids, b_ids = [e.ids for e in a_found], [m["ids"] for m in b_found]
        a_at, b_at = (np.cumsum([0, *map(len, x)]) for x in (a_ids, b_ids))
        a = np.fromiter(flat(a_ids), np.int64, a_at[-1])
        a_spans = np.fromiter(flat(flat(e.offsets for e in a_found)), np.int64, 2 * a_at[-1]).reshape(-1, 2)
        b = np.fromiter(flat(b_ids), np.int64, b_at[-1])
        b_spans = np.fromiter(flat(flat(m["offsets"] for m in b_found)), np.int64, 2 * b_at[-1]).reshape(-1, 2) + 1
        b_spans[b_at[:-1][np.diff(b_at) > 0], 0] = 0  # the space that B adds belongs to its first piece
        wide = [k for k, u in enumerate(units) if not u.isascii()]
        if wide:  # characters to bytes
            chars = np.frombuffer("".join(units[k] for k in wide).encode("utf-32-le"), "<u4")
            starts = np.append(0, np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)))
            first = np.cumsum([0, *(len(units[k]) for k in wide)])[:-1]
            n = np.diff(a_at)[wide]
            at = _ragged(a_at[wide], n)
            begin = np.repeat(first, n)[:, None]
            a_spans[at] = starts[begin + a_spans[at]] - starts[begin]
        same = self._decodes(self.a_bytes, a, a_at, raw) & self._decodes(self.b_bytes, b, b_at, raw)
        a_ends, b_ends = refined(a_spans, a_at, self.a_size[a], base), refined(b_spans, b_at, self.b_size[b], base)
        for ends, at in ((a_ends, a_at), (b_ends, b_at)):  # a unit that doesn't decode keeps to its own bytes
            unit = np.repeat(np.arange(len(units)), np.diff(at))
            ends[~same[unit]] = base[unit + 1][~same[unit]]
        return (a, a_at, a_ends), (b, b_at, b_ends), base, same

    @staticmethod
    def _decodes(known: list[bytes], ids: np.ndarray, at: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each unit's tokens are its bytes."""
        found = [known[i] for i in ids.tolist()]
        return np.array([b"".join(found[x:y]) == r for x, y, r in zip(at.tolist(), at[1:].tolist(), raw)], bool)


def refined(spans: np.ndarray, at: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes of all units end to end: by their spans where these are clean, else by decoded bytes since the last clean end."""
    counts = np.diff(at)
    n, unit = len(spans), np.repeat(np.arange(len(counts)), counts)
    if not n:
        return np.empty(0, np.int64)
    begin, end = (spans + base[unit][:, None]).T
    final = np.zeros(n, bool)
    final[at[1:][counts > 0] - 1] = True
    follows = np.where(final, base[unit + 1], np.append(begin[1:], 0))
    clean = (end > begin) & (follows == end)
    run = np.cumsum(sizes)
    # The last clean end before each token (or the unit's begin), and the decoded bytes up to there.
    index = np.arange(n)
    last = np.maximum.accumulate(np.where(clean, index, -1))
    last = np.append(-1, last[:-1])
    inside = last >= at[unit]
    first = at[unit]
    since = np.where(inside, end[last], base[unit])
    before = np.where(inside, run[last], run[first] - sizes[first])
    decoded = since + run - before
    return np.where(clean & (decoded == end), end, decoded)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places (0 or more, of one batch of units) that are in both, ascending and once each, as np.intersect1d finds them."""
    there = np.zeros((2, max(a.max(initial=-1), b.max(initial=-1)) + 1), bool)
    there[0, a] = there[1, b] = True
    return np.flatnonzero(there[0] & there[1])


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    return Aligner(a_path, b_path)


def spans(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, a_ids, a_ends, b_ids, b_ends (in bytes of a space and the text) and cuts, where both end."""
    fields = ["a_ids", "a_ends", "b_ids", "b_ends", "cuts"]
    schema = pa.schema([("doc_id", pa.int64()), *((f, pa.list_(pa.int64())) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [[]] * 5
                if t:
                    units = own.units(t)
                    a, b, base, same = own.align(units)
                    if same.all():
                        found = [a[0], a[2], b[0], b[2], np.intersect1d(a[2], b[2])]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([doc_id, *found], schema)], schema=schema)

    with common.batches_of(docs.sparkSession, 256):
        return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} array<long>" for f in fields))


def _joined(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids joined by commas, for slices that end at ends."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pc.cast(pa.array(ids), pa.string())), ",")


class _Memory:
    """What is known of units, by slots: written groups (null: doesn't decode), number of tokens and groups, pairs of linked ids."""

    def __init__(self, own: Aligner) -> None:
        self.own, self.slots = own, {}
        self.written, self.numbers = pa.array([], pa.string()), np.empty((0, 3), np.int64)
        #: How many chunks each slot was in.
        self.uses = np.empty(0, np.int64)
        #: Pairs of all slots end to end with how often each is linked, and where a slot's begin.
        self.pairs, self.times, self.bounds = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)

    def learn(self, units: list[str]) -> None:
        found = [self._aligned(units[k : k + AT_ONCE]) for k in range(0, len(units), AT_ONCE)]
        if not found:
            return
        written, numbers, pairs, times, sizes = zip(*found)
        self.slots.update(zip(units, range(len(self.slots), len(self.slots) + len(units))))
        self.written = pa.concat_arrays([self.written, *written])
        self.numbers, self.uses = np.concatenate([self.numbers, *numbers]), np.append(self.uses, np.zeros(len(units), np.int64))
        self.pairs, self.times = np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times])
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes)))

    def shrink(self) -> None:
        """Beyond MEMORY units half as many stay, those that most chunks had."""
        if len(self.slots) > MEMORY:
            kept = np.sort(np.argsort(-self.uses, kind="stable")[: MEMORY // 2])
            units, sizes = list(self.slots), np.diff(self.bounds)[kept]
            self.slots = {units[k]: i for i, k in enumerate(kept.tolist())}
            self.written, self.numbers, self.uses = self.written.take(pa.array(kept)), self.numbers[kept], self.uses[kept]
            own = _ragged(self.bounds[kept], sizes)
            self.pairs, self.times, self.bounds = self.pairs[own], self.times[own], np.append(0, np.cumsum(sizes))

    def _aligned(self, units: list[str]) -> tuple:
        (a, a_at, a_ends), (b, b_at, b_ends), base, same = self.own.align(units)
        ends = _common(a_ends, b_ends)
        groups = np.searchsorted(ends, base, "right")
        a_cut, b_cut = (np.append(0, np.searchsorted(e, ends, "right")) for e in (a_ends, b_ends))
        n_a, n_b = np.diff(a_cut), np.diff(b_cut)
        texts = pc.binary_join_element_wise(_joined(a, a_cut[1:]), _joined(b, b_cut[1:]), "|")
        written = pc.if_else(pa.array(same), pc.binary_join(pa.ListArray.from_arrays(pa.array(groups, pa.int32()), texts), ";"), pa.scalar(None, pa.string()))
        # All pairs of a group's tokens; those of a large group are counted by distinct ids first.
        wide = (n_a > 1) & (n_b > 1) & (n_a * n_b > LARGE)
        unit = np.repeat(np.arange(len(units)), np.diff(groups))
        size = np.where(wide | ~same[unit], 0, n_a * n_b)
        group = np.repeat(np.arange(len(ends)), size)
        place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        pairs = [a[a_cut[group] + place // n_b[group]] << 32 | b[b_cut[group] + place % n_b[group]]]
        times, units_of = [np.ones(len(group), np.int64)], [unit[group]]
        for g in np.flatnonzero(wide & same[unit]).tolist():
            (x, m), (y, n) = (np.unique(ids[cut[g] : cut[g + 1]], return_counts=True) for ids, cut in ((a, a_cut), (b, b_cut)))
            pairs.append((x[:, None] << 32 | y).ravel())
            times.append((m[:, None] * n).ravel())
            units_of.append(np.full(len(x) * len(y), unit[g]))
        pairs, times, units_of = (np.concatenate(x) for x in (pairs, times, units_of))
        if len(units_of) > len(group):
            order = np.argsort(units_of, kind="stable")
            pairs, times, units_of = pairs[order], times[order], units_of[order]
        numbers = np.stack([np.diff(a_at), np.diff(b_at), np.diff(groups)], axis=1)
        return written, numbers, pairs, times, np.bincount(units_of, minlength=len(units))


@functools.cache
def _memory(a_path: str, b_path: str) -> _Memory:
    """One for each worker process, which keeps it from task to task."""
    return _Memory(aligner(a_path, b_path))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the slices that begin at starts."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _digests(written: pa.Array, slots: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Of the groups of each document's units, one after the other."""
    if (pc.sum(pc.take(pc.binary_length(written), pa.array(slots))).as_py() or 0) + len(slots) < 1 << 30:
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), written.take(pa.array(slots))), ";")
        return [hashlib.sha256(t.as_buffer() if t.is_valid else b"").hexdigest() for t in texts]
    out = []
    for b, e in zip(bounds.tolist(), bounds[1:].tolist()):
        one = hashlib.sha256()
        for k in range(b, e, 1 << 16):
            one.update((";" * (k > b) + ";".join(x or "" for x in written.take(pa.array(slots[k : min(k + (1 << 16), e)])).to_pylist())).encode())
        out.append(one.hexdigest())
    return out


_SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, place int, pair long, docs long"
_ARROW = pa.schema([("chunk", pa.int64()), *((f, pa.int64()) for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary()), ("place", pa.int32()), ("pair", pa.int64()), ("docs", pa.int64())])


def _chunk_rows(memory: _Memory, chunk: int, keys: list, texts: list) -> pa.RecordBatch:
    """A row for each document with its links (places of pairs, times), and one for each pair of the chunk."""
    import zstandard

    own, packer, slots, lengths = memory.own, zstandard.ZstdCompressor(level=1), [], []
    for k in range(0, len(texts), DOCS):
        units = [own.units(t) if t else [] for t in texts[k : k + DOCS]]
        memory.learn(sorted(set(chain.from_iterable(units)).difference(memory.slots)))
        lengths += map(len, units)
        slots.append(np.fromiter(map(memory.slots.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units))))
    n_docs, flat = len(texts), np.concatenate([*slots, np.empty(0, np.int64)])
    bounds = np.cumsum([0, *lengths])
    doc = np.repeat(np.arange(n_docs), lengths)
    # A text whose units don't all decode has no tokens.
    broken = np.zeros(n_docs, bool)
    broken[doc[~memory.written.is_valid().to_numpy(zero_copy_only=False)[flat]]] = True
    shas = ["" if x or not n else d for d, n, x in zip(_digests(memory.written, flat, bounds), lengths, broken.tolist())]
    flat, doc = flat[~broken[doc]], doc[~broken[doc]]
    used, code = np.unique(flat, return_inverse=True)
    memory.uses[used] += 1
    sums = np.zeros((n_docs, 3), np.int64)
    np.add.at(sums, doc, memory.numbers[flat])
    # Distinct pairs of the chunk, and of each unit their places.
    sizes = np.diff(memory.bounds)[used]
    own_pairs = _ragged(memory.bounds[used], sizes)
    all_pairs, all_times = memory.pairs[own_pairs], memory.times[own_pairs]
    pairs, place = np.unique(all_pairs, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    # A document's distinct units with their numbers, then its distinct pairs with theirs.
    width = max(len(used), 1)
    held, repeats = np.unique(doc * width + code, return_counts=True)
    of, what = held // width, held % width
    at = _ragged(starts[what], sizes[what])
    weight, of = all_times[at] * np.repeat(repeats, sizes[what]), np.repeat(of, sizes[what])
    width = max(len(pairs), 1)
    linked, inverse = np.unique(of * width + place[at], return_inverse=True)
    times = np.zeros(len(linked), np.int64)
    np.add.at(times, inverse, weight)
    of, where = linked // width, linked % width
    bounds = np.searchsorted(of, np.arange(n_docs + 1))
    n_links = np.array([times[b:e].sum() for b, e in zip(bounds, bounds[1:])], np.int64)
    links = [packer.compress(np.concatenate([np.diff(where[b:e], prepend=0), times[b:e]]).astype("<i8").tobytes()) for b, e in zip(bounds, bounds[1:])]
    m = len(pairs)
    both = lambda x, y, t: pa.concat_arrays([pa.array(x, t) if x is not None else pa.nulls(n_docs, t), pa.array(y, t) if y is not None else pa.nulls(m, t)])
    columns = [np.full(n_docs, chunk), keys, *sums.T, n_links, shas, links, None, None, None]
    of_pairs = [np.full(m, chunk), *[None] * 7, np.arange(m, dtype=np.int32), pairs, np.bincount(where, minlength=m)]
    return pa.RecordBatch.from_arrays([both(x, y, f.type) for x, y, f in zip(columns, of_pairs, _ARROW)], schema=_ARROW)


def _chunks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        memory, keys, texts, size = _memory(a_path, b_path), [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                texts.append(text)
                size += len(text or "") + 64
                if size >= CHUNK:
                    yield _chunk_rows(memory, number, keys, texts)
                    number, keys, texts, size = number + 1, [], [], 0
                    memory.shrink()
        if keys:
            yield _chunk_rows(memory, number, keys, texts)
            memory.shrink()

    return run


def _score(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
    """Sums of counts and best links of a chunk's documents."""
    import zstandard

    opener = zstandard.ZstdDecompressor()
    place, count, best = (known[c].to_numpy() for c in ("place", "count", "best"))
    counts, bests = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    counts[place], bests[place] = count, best
    n_best, count_sum = [], []
    for links in docs["links"].to_pylist():
        steps, times = np.frombuffer(opener.decompress(links), "<i8").reshape(2, -1)
        where = np.cumsum(steps)
        n_best.append(int((bests[where] * times).sum()))
        count_sum.append(int((counts[where] * times).sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def links(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chunks, counts): the chunks' rows as written, and of each pair of ids: pair (A id << 32 | B id), count, best (1 or 0)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = common.cut(rows.mapInArrow(_chunks(a_path, b_path), _SCHEMA), "aligned", rows_at_once=256)
    counts = chunks.filter(F.col("place").isNotNull()).groupBy("pair").agg(F.sum("docs").alias("count"))
    counts = common.cut(counts.withColumn("a", F.shiftright("pair", 32)), "counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # at most one row for each id of A
    return chunks, counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def statistics(docs: DataFrame, a_path: str, b_path: str, **how) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    chunks, counts = links(docs, a_path, b_path, **how)
    known = chunks.filter(F.col("place").isNotNull()).join(counts, "pair").select(F.col("chunk").alias("of"), "place", "count", "best")
    own = chunks.filter(F.col("place").isNull()).select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_score, fields)


def op11_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(common.documents(spark, sf_dir), tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model"))
