"""Benchmark decontamination with training suffix arrays.

Benchmark items are cut into words; each batch of training documents becomes a shard with a
suffix array over its words, and every benchmark suffix is binary-searched in it for its longest
verbatim match and where that lies. A match as long as the item's window (WINDOW words, or the
whole of a shorter item) marks the words of every occurrence. Words that no benchmark item has
next to each other end every match, so a shard's array holds only the runs between them.

The benchmark is stored in blocks of BLOCK_BYTES in the shared folder, which workers hold one at a time; the
documents are read once and never leave their partition, so there is no shuffle. Words are compared by 64-bit
hashes of their own.

Defined cases: a null or wordless text has no words and is clean; a null or wordless item has no
window; items that share an item_id count once, a null item_id as "null"; rows that repeat give a
row each; empty tables give an empty or a clean result; other columns pass through unread (names
beginning with _contam_ must be free: a clash is an error before any work); a text is held whole in memory, with
some ten times its bytes beside it.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import arrays, shared, tokens

WINDOW = 13
#: A document is contaminated when hits make up at least one in SHARE of its words.
SHARE = 20
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = (1 << 21) - 4096

_STATE = [("_contam_words", T.LongType()), ("_contam_hit", T.LongType()), ("_contam_spans", T.ArrayType(T.LongType())), ("_contam_items", T.ArrayType(T.StringType()))]
_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]


class Block:
    """Word ids of some benchmark items, one after the other, with a 0 after each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        data, offs = shared.text_buffers(pa.array([t for _, t in items], pa.large_string()))
        w = tokens.words(data, offs, tokens.WORDS)
        self.names = [i for i, _ in items]
        self.vocabulary = np.unique(w.hash)
        ids = np.searchsorted(self.vocabulary, w.hash) + 1
        n, first = w.counts, w.first
        place = np.arange(len(ids)) - first[w.doc] if len(ids) else np.zeros(0, np.int64)
        self.text = np.zeros(len(ids) + len(items) + 1, np.int64)
        at = np.arange(len(ids)) + w.doc
        self.text[at] = ids
        self.start, self.item = at, w.doc
        self.length = n[w.doc] - place
        #: Words of the window that begins at each suffix; 0 where none does.
        self.window = np.where(n[w.doc] >= window, np.where(self.length >= window, window, 0), np.where(place == 0, n[w.doc], 0))
        self.least = int(self.window[self.window > 0].min()) if len(ids) else 0
        pair = self.text[:-1] * (len(self.vocabulary) + 1) + self.text[1:]
        self.pairs = np.unique(pair[(self.text[:-1] > 0) & (self.text[1:] > 0)])
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True


def blocks(benchmark: DataFrame, window: int = WINDOW, most_bytes: int = BLOCK_BYTES):
    """Blocks of at most most_bytes of text (a longer item comes alone), read one at a time."""
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").toLocalIterator():
        if held and size + len(row.text or "") > most_bytes:
            yield Block(held, window)
            held, size = [], 0
        held.append((row.i, row.text))
        size += len(row.text or "")
    if held:
        yield Block(held, window)


def member(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(among, values), max(len(among) - 1, 0))
    return at, (among[at] == values) if len(among) else np.zeros(len(values), bool)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of seq in the order of their first `depth` words, by prefix doubling."""
    n = len(seq)
    rank, k = seq.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth and n:
        second = np.zeros(n, np.int64)
        second[: n - k if n > k else 0] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        k *= 2
    return order


def _compare(seq, at, text, start, length):
    """(words in common, sign of training suffix against pattern; 0 where the pattern is its prefix)."""
    common, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
    live = np.arange(len(at))
    j = 0
    while len(live):
        ended = length[live] <= j
        live = live[~ended]
        a, b = seq[at[live] + j], text[start[live] + j]
        sign[live] = np.sign(a - b)
        live = live[a == b]
        common[live] += 1
        j += 1
    return common, sign


def _bound(seq, order, text, start, length, above: bool):
    """First place in the suffix array whose suffix is not below (or is above) the pattern."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while (open_ := lo < hi).any():
        k = np.flatnonzero(open_)
        mid = (lo[k] + hi[k]) // 2
        _, sign = _compare(seq, order[mid], text, start[k], length[k])
        right = (sign <= 0) if above else (sign < 0)
        lo[k[right]] = mid[right] + 1
        hi[k[~right]] = mid[~right]
    return lo


class Shard:
    """Suffix array over those runs of a batch's words that a benchmark block could match."""

    def __init__(self, w: tokens.Words, block: Block):
        self.words, self.block = w, block
        n = len(w.hash)
        ids = np.zeros(n + 1, np.int64)
        maybe = np.flatnonzero(block.known[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        at, ok = member(w.hash[maybe], block.vocabulary)
        ids[maybe[ok]] = at[ok] + 1
        ids = ids[:n]
        linked = np.zeros(n, bool)
        if n > 1 and len(block.pairs):
            near = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (w.doc[1:] == w.doc[:-1]))
            _, ok = member(ids[near] * (len(block.vocabulary) + 1) + ids[near + 1], block.pairs)
            linked[near[ok]] = True
        heads = np.flatnonzero((ids > 0) & ~np.concatenate(([False], linked[:-1])))
        breaks = np.flatnonzero(~linked)
        length = breaks[np.searchsorted(breaks, heads)] - heads + 1 if n else np.zeros(0, np.int64)
        keep = length >= max(block.least, 1)
        heads, length = heads[keep], length[keep]
        run = np.repeat(np.arange(len(heads)), length)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
        self.seq = np.zeros(len(run) + len(heads) + 1, np.int64)
        place = np.arange(len(run)) + run
        self.seq[place] = ids[heads[run] + inner]
        #: The word that each place of seq stands for.
        self.word = np.full(len(self.seq), -1, np.int64)
        self.word[place] = heads[run] + inner
        depth = int(min(length.max(initial=0), block.length.max(initial=0)))
        order = suffix_array(self.seq, depth)
        self.order = order[self.seq[order] > 0]

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every benchmark suffix: words of its longest match in this shard, and the training word where it starts (-1: none)."""
        b = self.block
        length, where = np.zeros(len(b.start), np.int64), np.full(len(b.start), -1, np.int64)
        if not len(self.order):
            return length, where
        at = _bound(self.seq, self.order, b.text, b.start, b.length, False)
        for step in (-1, 0):
            k = np.flatnonzero((at + step >= 0) & (at + step < len(self.order)))
            suffix = self.order[at[k] + step]
            common, _ = _compare(self.seq, suffix, b.text, b.start[k], b.length[k])
            more = common > length[k]
            length[k[more]], where[k[more]] = common[more], self.word[suffix[more]]
        return length, where

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows: first training word, words, item."""
        b = self.block
        length, _ = self.longest()
        k = np.flatnonzero((b.window > 0) & (length >= b.window))
        lo = _bound(self.seq, self.order, b.text, b.start[k], b.window[k], False)
        hi = _bound(self.seq, self.order, b.text, b.start[k], b.window[k], True)
        times = hi - lo
        each = np.repeat(np.arange(len(k)), times)
        inner = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        return self.word[self.order[lo[each] + inner]], b.window[k][each], b.item[k][each]


def _runs(mask: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges.reshape(-1, 2)


def _mark(part: pa.RecordBatch, text_at: int, found) -> list[pa.Array]:
    """Counts, spans and items of each document, by all blocks of found, one at a time."""
    data, offs = shared.text_buffers(part.column(text_at))
    w = tokens.words(data, offs, tokens.WORDS)
    n_docs = part.num_rows
    items: list[set] = [set() for _ in range(n_docs)]
    hit = np.zeros(len(w.hash), bool)
    first = w.first
    for block in found if len(w.hash) else ():
        start, size, item = Shard(w, block).hits() if len(block.start) else ((), (), ())
        if len(start):
            change = np.zeros(len(hit) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + size, -1)
            hit |= np.cumsum(change[:-1]) > 0
            for code in np.unique(w.doc[start] * len(block.names) + item):
                items[int(code) // len(block.names)].add(block.names[int(code) % len(block.names)])
    n_hit = np.bincount(w.doc[hit], minlength=n_docs) if len(hit) else np.zeros(n_docs, np.int64)
    spans = [(_runs(hit[first[d] : first[d + 1]]).reshape(-1).tolist() if n_hit[d] else []) for d in range(n_docs)]
    columns = [w.counts, n_hit, spans, [sorted(x) for x in items]]
    return [pa.array(x, t) for x, t in zip(columns, _ARROW, strict=True)]


@lru_cache(maxsize=2)
def _stored_block(folder: str, k: int) -> Block:
    return pickle.loads(arrays.load(folder, f"block-{k}.npy").tobytes())


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with _contam_words, _contam_hit, _contam_spans (word positions, start and end in turn) and _contam_items."""
    names = docs.columns
    if clash := [n for n in names if n.lower() in {x for x, _ in _STATE}]:
        raise ValueError(f"columns {clash} are taken")
    text_at = names.index(text)
    schema = T.StructType(docs.schema.fields + [T.StructField(n, t) for n, t in _STATE])
    folder = shared.new_path(docs.sparkSession, "benchmark")
    n = 0
    for block in blocks(benchmark, window, most_bytes):
        # One block at a time on the driver, and on the workers.
        arrays.save(folder, f"block-{n}.npy", np.frombuffer(pickle.dumps(block), np.uint8))
        n += 1

    def mark(batches):
        for batch in batches:
            for part in shared.chunks(batch, text, CHUNK_BYTES):
                new = _mark(part, text_at, (_stored_block(folder, k) for k in range(n)))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *[x for x, _ in _STATE]])

    return docs.mapInArrow(mark, schema)


def contaminated() -> F.Column:
    return (F.col("_contam_hit") > 0) & (F.col("_contam_hit") * SHARE >= F.col("_contam_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates, as they were."""
    return scan(docs, benchmark).where(~contaminated()).select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = scan(docs, shared.read_table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        F.col("_contam_words").alias("n_words"),
        F.col("_contam_hit").alias("n_hit"),
        F.size("_contam_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_contam_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL_OP2 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[p:p + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
