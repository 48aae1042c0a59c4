"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting. Words are met by 64-bit hashes. Each task counts its tokens in blocks and hands on, by
ranges of the hash, sorted arrays of hashes with their counts; a range is merged to one sorted
array in the shared folder, and a word's number is its place in the order of all. A second pass
maps that vocabulary into memory and counts pairs of numbers the same way, by ranges of the first
word, which gives each context's totals on the spot; how many different words each word follows is
summed by ranges of the second word. A range's arrays are merged as they arrive, so a worker holds the different
keys of a range, not what all tasks sent. A pair that is frequent everywhere is one row a block, so no
range grows with how often its words occur, only with how many different ones there are.

Scoring. Workers memory-map the arrays and look up each block's distinct words and pairs in sorted
order. p(w|v) = max(c(vw) - D(c), 0) / c(v) + g(v) p(w), with the discounts of modified Kneser-Ney
for pairs, and for words the same over the number of different words they follow, interpolated
with the uniform distribution over the vocabulary and one unknown word. Documents begin after a
start mark; the end mark is a token.

Defined cases: a null text is empty and has the end mark only; over 4 billion different words are an error; without training text every
probability is 1; a null doc_id counts as the text "null"; rows may repeat; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import arrays, shared, tokens

#: Bytes of input for each range of the hash: what one task merges.
RANGE_BYTES = 8 << 20
CHUNK_BYTES = (1 << 21) - 4096
#: From this on, Spark's estimate of a table's size says that it has none.
UNKNOWN_BYTES = 1 << 55
#: Keys that wait to be merged, at least.
MERGE_KEYS = 1 << 20
#: Tokens that a task counts before it hands them on.
COUNT_TOKENS = 2_000_000
END = np.uint64(0x51AB17E7D0C0FFEE)

_BLOB = "part int, keys binary, counts binary"
_STATS = "kind int, n1 long, n2 long, n3 long, n4 long, more long, entries long, total long"


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 7 == 2


def token_stream(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every token, the end mark after each document's words."""
    w = tokens.words(data, offs, tokens.BLANKS)
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), w.counts + 1)
    out = np.full(len(doc), END, np.uint64)
    out[np.arange(len(w.hash)) + w.doc] = w.hash
    return doc, out


def part_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The range of a hash: its top bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[head], np.add.reduceat(c, head) if len(k) else c


def _blobs(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each range; part rises, keys rise within it."""
    head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    stop = np.concatenate((head[1:], [len(part)]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[head].astype(np.int32)),
            pa.array([keys[a:z].tobytes() for a, z in zip(head, stop, strict=True)], pa.binary()),
            pa.array([counts[a:z].astype(np.uint32).tobytes() for a, z in zip(head, stop, strict=True)], pa.binary()),
        ],
        names=["part", "keys", "counts"],
    )


class _Merged:
    """Sorted keys and their counts, from any number of sorted arrays; what waits to be merged is no more than what is."""

    def __init__(self):
        self.keys, self.counts, self.held, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: bytes, counts: bytes) -> None:
        self.held.append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)))
        self.size += len(self.held[-1][0])
        if self.size > max(MERGE_KEYS, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        self.keys, self.counts = _merge([self.keys, *[k for k, _ in self.held]], [self.counts, *[c for _, c in self.held]])
        self.held, self.size = [], 0
        return self.keys, self.counts


def _by_part(rows: DataFrame, finish, schema: str) -> DataFrame:
    """finish(part, keys, counts) for each range, whose blobs are merged as they come: a range is never held as blobs."""

    def run(batches):
        part, merged = None, _Merged()
        for batch in batches:
            for p, keys, counts in zip(*[batch.column(k) for k in range(3)], strict=True):
                if p.as_py() < 0:
                    # Counts of counts, one row of them a range: handed on as they are.
                    yield from finish(-1, np.frombuffer(keys.as_py(), np.int64), None).to_batches()
                    continue
                if p.as_py() != part:
                    if part is not None:
                        yield from finish(part, *merged.merge()).to_batches()
                    part, merged = p.as_py(), _Merged()
                merged.add(keys.as_py(), counts.as_py())
        if part is not None:
            yield from finish(part, *merged.merge()).to_batches()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _stats(kind: int, counts: np.ndarray) -> list[int]:
    n = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    return [kind, *n, int((counts >= 3).sum()), len(counts), int(counts.sum())]


def _rows(rows: list[list[int]]) -> pa.Table:
    names = [x.split()[0] for x in _STATS.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.int64()) for k in range(len(names))], names=names)


class Vocabulary:
    """Numbers of words: places in the sorted hashes, which lie by ranges in the shared folder."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int]):
        self.folder, self.bits = folder, bits
        self.first = np.concatenate(([0], np.cumsum([sizes.get(p, 0) for p in range(1 << bits)])))

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one that is not there."""
        names, which = np.unique(hashes, return_inverse=True)
        out = np.full(len(names), -1, np.int64)
        edge = np.searchsorted(part_of(names, self.bits), np.arange((1 << self.bits) + 1))
        for p in np.flatnonzero(np.diff(edge)):
            if self.first[p] < self.first[p + 1]:
                have, own = arrays.load(self.folder, f"words-{p}.npy"), names[edge[p] : edge[p + 1]]
                at = np.minimum(np.searchsorted(have, own), len(have) - 1)
                ok = have[at] == own
                out[edge[p] : edge[p + 1]][ok] = at[ok] + self.first[p]
        return out[which]

    def by_number(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Values by word number (an array a range); 0 for -1."""
        names, which = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(names), np.int64)
        edge = np.searchsorted(names, self.first)
        for p in np.flatnonzero(np.diff(edge)):
            out[edge[p] : edge[p + 1]] = arrays.load(self.folder, f"{name}-{p}.npy")[names[edge[p] : edge[p + 1]] - self.first[p]]
        return out[which]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d.append(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else d[-1])
    return np.array(d)


class Model:
    def __init__(self, vocabulary: Vocabulary, total: int, pairs: list[int], follows: list[int], starts: list[int]):
        self.vocabulary, self.total, self.starts = vocabulary, total, starts
        self.d2, self.d1 = discounts(*pairs[1:5]), discounts(*follows[1:5])
        self.follow_total = follows[7]
        self.uniform = 1.0 / (vocabulary.size + 1)
        spread = self.d1[1] * follows[1] + self.d1[2] * follows[2] + self.d1[3] * follows[5]
        self.back = spread / self.follow_total if self.follow_total else 1.0

    def word(self, w: np.ndarray) -> np.ndarray:
        """p(w) by how many words w follows."""
        c = self.vocabulary.by_number("follow", w)
        own = (c - self.d1[np.minimum(c, 3)]) / max(self.follow_total, 1)
        return np.where(w >= 0, own, 0.0) + self.back * self.uniform

    def pair(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p(w|v); v is the vocabulary's size for the start mark, -1 for an unknown word."""
        voc, size = self.vocabulary, self.vocabulary.size
        if not self.total:
            return self.word(w)
        key = np.where((v >= 0) & (w >= 0), (v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
        names, which = np.unique(key, return_inverse=True)
        count = np.zeros(len(names), np.int64)
        bounds = np.concatenate((voc.first, [size + 1])).astype(np.uint64) << np.uint64(32)
        edge = np.searchsorted(names, bounds)
        for p in np.flatnonzero(np.diff(edge)):
            have, own = arrays.load(voc.folder, f"pairs-{p}.npy"), names[edge[p] : edge[p + 1]]
            if len(have):
                at = np.minimum(np.searchsorted(have, own), len(have) - 1)
                ok = np.flatnonzero(have[at] == own)
                count[edge[p] + ok] = arrays.load(voc.folder, f"times-{p}.npy")[at[ok]]
        count = count[which]
        inner = np.where((v >= 0) & (v < size), v, -1)
        sums = [np.where(v == size, s, voc.by_number(f"context{k}", inner)) for k, s in enumerate(self.starts)]
        total = sums[0]
        spread = self.d2[1] * sums[1] + self.d2[2] * sums[2] + self.d2[3] * sums[3]
        safe = np.maximum(total, 1)
        own = np.maximum(count - self.d2[np.minimum(count, 3)], 0) / safe
        return np.where(total > 0, own + spread / safe * self.word(w), self.word(w))


def _with_start(doc: np.ndarray, number: np.ndarray, start: int) -> np.ndarray:
    """The number before each token, the start mark before a document's first."""
    before = np.concatenate(([start], number[:-1])) if len(number) else number
    before[np.concatenate(([True], doc[1:] != doc[:-1]))] = start
    return before


def train(docs: DataFrame, folder: str | None = None) -> Model:
    """Count the texts of docs into arrays under folder."""
    spark = docs.sparkSession
    folder = folder or shared.new_path(spark, "ngrams")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, min(20, (size // RANGE_BYTES).bit_length()))

    def count_words(batches):
        held, n = [], 0

        def give():
            k, c = _merge([x[0] for x in held], [x[1] for x in held])
            return _blobs(part_of(k, bits), k, c)

        for batch in batches:
            for part in shared.chunks(batch, "text", CHUNK_BYTES):
                _, h = token_stream(*shared.text_buffers(part.column(0)))
                held.append(np.unique(h, return_counts=True))
                n += len(h)
                if n >= COUNT_TOKENS:
                    yield give()
                    held, n = [], 0
        if n:
            yield give()

    def merge_words(p, k, c):
        arrays.save(folder, f"words-{p}.npy", k)
        arrays.save(folder, f"count-{p}.npy", c)
        return _rows([[p, 0, 0, 0, 0, 0, len(k), int(c.sum())]])

    rows = docs.select("text")
    found = _by_part(rows.mapInArrow(count_words, _BLOB), merge_words, _STATS).collect()
    vocabulary = Vocabulary(folder, bits, {r.kind: r.entries for r in found})
    total = sum(r.total for r in found)
    parts, start = 1 << bits, vocabulary.size
    if start >= 1 << 32:
        raise ValueError("more than 4 billion different words: numbers of 32 bits don't hold them")

    def range_of(number: np.ndarray) -> np.ndarray:
        return np.searchsorted(vocabulary.first[1:], number, side="right")

    def count_pairs(batches):
        held, n = [], 0

        def give():
            k, c = _merge([x[0] for x in held], [x[1] for x in held])
            return _blobs(range_of((k >> np.uint64(32)).astype(np.int64)), k, c)

        for batch in batches:
            for part in shared.chunks(batch, "text", CHUNK_BYTES):
                doc, h = token_stream(*shared.text_buffers(part.column(0)))
                number = vocabulary.numbers(h)
                held.append(np.unique((_with_start(doc, number, start).astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64), return_counts=True))
                n += len(h)
                if n >= COUNT_TOKENS:
                    yield give()
                    held, n = [], 0
        if n:
            yield give()

    def merge_pairs(p, k, c):
        """Arrays of one range of first words; hands on how often each second word was found, and the counts of counts."""
        v = (k >> np.uint64(32)).astype(np.int64)
        low = int(vocabulary.first[p]) if p < parts else start
        width = int(vocabulary.first[p + 1]) - low if p < parts else 1
        arrays.save(folder, f"pairs-{p}.npy", k)
        arrays.save(folder, f"times-{p}.npy", c.astype(np.uint32) if int(c.max(initial=0)) < 1 << 32 else c)
        sums = [np.bincount(v - low, c, width), *[np.bincount(v - low, m, width) for m in (c == 1, c == 2, c >= 3)]]
        for i, s in enumerate(sums):
            arrays.save(folder, f"context{i}-{p}.npy", s.astype(np.int64))
        w, times = np.unique(k & np.uint64(0xFFFFFFFF), return_counts=True)
        out = _blobs(range_of(w.astype(np.int64)), w, times)
        stats = np.array(_stats(0, c), np.int64)
        extra = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([stats.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=out.schema.names)
        return pa.Table.from_batches([out, extra])

    def merge_follows(p, k, c):
        if p < 0:
            return _rows([[0, *map(int, k[1:])]])
        low = int(vocabulary.first[p])
        dense = np.zeros(int(vocabulary.first[p + 1]) - low, np.int64)
        dense[k.astype(np.int64) - low] = c
        arrays.save(folder, f"follow-{p}.npy", dense)
        return _rows([_stats(1, dense)])

    merged = _by_part(rows.mapInArrow(count_pairs, _BLOB), merge_pairs, _BLOB)
    stats = _by_part(merged, merge_follows, _STATS).groupBy("kind")
    stats = {r[0]: list(r) for r in stats.agg(*[F.sum(x.split()[0]).alias(x.split()[0]) for x in _STATS.split(", ")[1:]]).collect()}
    none = [0] * 8
    starts = [int(arrays.load(folder, f"context{i}-{parts}.npy")[0]) if total else 0 for i in range(4)]
    return Model(vocabulary, total, stats.get(0, none), stats.get(1, none), starts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs."""
    voc, total = model.vocabulary, model.total
    floor = total + voc.size + 1

    def run(batches):
        for batch in batches:
            for part in shared.chunks(batch, "text", CHUNK_BYTES):
                n = part.num_rows
                doc, h = token_stream(*shared.text_buffers(part.column(1)))
                number = voc.numbers(h)
                count = voc.by_number("count", number)
                base = np.log10((count + 1) / floor)
                p = np.log10(model.pair(_with_start(doc, number, voc.size), number))
                columns = [np.bincount(doc, minlength=n), np.bincount(doc, count > 0, n).astype(np.int64), np.bincount(doc, base, n), np.bincount(doc, p, n)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
