"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts elsewhere.

To bring together what can match, each document is cut into runs of window starts that share the
least hash of the GRAM-byte strings inside the window: equal windows have equal least hashes, so
all occurrences of a window lie in runs of one key. Runs whose key occurs once anywhere end there.
The text under the other runs is gathered by key (documents never are), reduced to what may repeat,
and each key's strings are suffix-sorted by linear grouping (suffix_sort); neighbours in suffix
order that agree on LENGTH bytes are the repeats. Spans go back to the documents.

A key with over HOT runs is not gathered: its windows are counted by 128 bits of hash, in partial
sums, which has no large group. Every window is judged either way, and alike but for two windows of one
128-bit hash; a string that a key has twice and no other beside needs no sorting.

Equal texts are one text throughout: all of a text that has a copy is removed, and one
representative stands for it as a source of matches.

Texts are known by 128 bits of their SHA-256, and one is held whole in memory, with some 40 bytes for each of its own.

Defined cases: a null text is empty; a text under LENGTH bytes loses nothing; rows that repeat are
copies of each other; a null doc_id is a document; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import shared, tokens
from lexmill.llm.suffix_sort import suffix_arrays

LENGTH = 200
#: 32 + 16: built from hashes of powers of two.
GRAM = 48
HOT = 4096
CHUNK_BYTES = (1 << 20) - 4096
SORT_BYTES = 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15)


def least_grams(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window of `length` bytes, where the first of its least GRAM-byte strings begins; the strings' hashes."""
    n = len(data)
    h = data.astype(np.uint64) + np.uint64(1)
    power, size, half = int(_B), 1, h
    while size < 32:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power & 0xFFFFFFFFFFFFFFFF, size * 2
        if size == 16:
            half = h
    # h is of 32 bytes; 48 = 32 + 16.
    grams = n - GRAM + 1
    h = tokens.mix(h[:grams] * np.uint64(pow(int(_B), 16, 1 << 64)) + half[32 : 32 + grams])
    # Hash in the upper half, place in the lower: of equal hashes the first wins, in equal windows alike.
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    wide = length - GRAM + 1
    size = 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    starts = n - length + 1
    least = np.minimum(least[:starts], least[wide - size : wide - size + starts])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), h


def window_runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH):
    """(document, start within it, windows, key, several) of each run of window starts with one least string.

    Adjacent runs of equal strings, in text of a short period, are joined: several is then True."""
    none = np.zeros(0, np.int64)
    begins = offs[:-1]
    stops = np.maximum(offs[1:] - length + 1, begins)
    has = stops > begins
    if not has.any():
        return none, none, none, none, np.zeros(0, bool)
    at, h = least_grams(data, length)
    edge = np.zeros(len(at) + 1, np.int8)
    np.add.at(edge, begins[has], 1)
    np.add.at(edge, stops[has], -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    fresh = valid.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    fresh[begins[has]] = True
    start = np.flatnonzero(fresh)
    doc = np.searchsorted(offs, start, side="right") - 1
    end = np.minimum(np.concatenate((start[1:], [len(at)])), stops[doc])
    key = h[at[start]].view(np.int64)
    first = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    head = np.flatnonzero(first)
    many = np.diff(np.concatenate((head, [len(start)]))) > 1
    last = np.concatenate((head[1:], [len(start)])) - 1
    return doc[head], start[head] - begins[doc[head]], end[last] - start[head], key[head], many


def _runs(batches):
    seen: set[bytes] = set()
    for batch in batches:
        for part in shared.chunks(batch, "text", CHUNK_BYTES):
            fresh = []
            for i, x in enumerate(part.column(0).to_pylist()):
                if x not in seen:
                    fresh.append(i)
                    seen.add(x)
            if len(seen) > 200_000:
                seen.clear()
            # Copies within a task give the same runs again; copies across tasks are met by comparing (text, start).
            part = part.take(pa.array(fresh, pa.int32()))
            doc, start, count, key, many = window_runs(*shared.text_buffers(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(many)], names=["key", "t", "start", "n", "many"])


def _cut(batches):
    """The text under each run."""
    for batch in batches:
        for part in shared.chunks(batch, "text", CHUNK_BYTES):
            data, offs = shared.text_buffers(part.column(1))
            lists = part.column(2)
            per = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            key, start, n = (flat.field(k) for k in range(3))
            row = np.repeat(np.arange(part.num_rows), per)
            s = start.to_numpy().astype(np.int64) + offs[row]
            size = n.to_numpy().astype(np.int64) + LENGTH - 1
            ends = np.cumsum(size)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(s - ends + size, size)
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])
            yield pa.RecordBatch.from_arrays([key, part.column(0).take(pa.array(row)), start, n, pieces.cast(pa.binary())], names=["key", "t", "start", "n", "piece"])


#: A value of 64 bits for each byte.
_OTHER = tokens.mix(np.arange(1, 257, dtype=np.uint64))


def _hash_at(total: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return tokens.mix((total[end] - total[start]) * tokens.power(start, True) ^ tokens.mix(salt.view(np.uint64) + (end - start).astype(np.uint64)))


def _equal_windows(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 50_000):
        out[k : k + 50_000] = (view[a[k : k + 50_000]] == view[b[k : k + 50_000]]).all(axis=1)
    return out


def repeated(key: np.ndarray, t: np.ndarray, start: np.ndarray, n: np.ndarray, data: np.ndarray, offs: np.ndarray):
    """(t, from, to) of the bytes under repeated windows; whole keys, rows in the order of key."""
    total = tokens.prefix(data.astype(np.uint16) + np.uint16(1))
    # Every window of every row, and by hash whether it may occur twice under its key.
    row = np.repeat(np.arange(len(key)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + offs[row]
    hashed = _hash_at(total, at, at + LENGTH, key[row])
    order = np.argsort(hashed)
    same = hashed[order][1:] == hashed[order][:-1]
    maybe = np.zeros(len(row), bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    # Runs of such windows, as strings; equal strings under a key are one.
    opens = maybe.copy()
    opens[1:] &= ~maybe[:-1] | (row[1:] != row[:-1])
    closes = maybe.copy()
    closes[:-1] &= ~maybe[1:] | (row[1:] != row[:-1])
    a, z = np.flatnonzero(opens), np.flatnonzero(closes)
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    p_row, p_at, p_len = row[a], at[a], z - a + LENGTH
    name = _hash_at(total, p_at, p_at + p_len, key[p_row])
    names, first, which, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    raw = data.tobytes()
    if any(raw[p_at[i] : p_at[i] + p_len[i]] != raw[p_at[f := first[which[i]]] : p_at[f] + p_len[f]] for i in np.flatnonzero(times[which] > 1).tolist()):
        # Two strings under one 64-bit hash: they are told apart by what they are.
        known: dict[tuple[int, bytes], int] = {}
        name = np.array([known.setdefault((int(key[p_row[i]]), raw[p_at[i] : p_at[i] + p_len[i]]), i) for i in range(len(a))])
        names, first, which, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    d_key, d_at, d_len = key[p_row[first]], p_at[first], p_len[first]
    sure = times > 1
    by = np.argsort(d_key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], d_key[by][1:] != d_key[by][:-1], [True])))
    members = np.diff(edge)
    # A key with one string, found twice, is settled; the others are sorted.
    sort = np.repeat((members > 1) | ~np.maximum.reduceat(sure[by], edge[:-1]), members)
    todo = by[sort]
    confirmed: dict[int, np.ndarray] = {}
    sizes = d_len[todo] + 1
    blocks = np.flatnonzero(np.concatenate(([True], d_key[todo][1:] != d_key[todo][:-1]))) if len(todo) else np.zeros(0, np.int64)
    weight = np.add.reduceat(sizes, blocks) if len(todo) else np.zeros(0, np.int64)
    rank = np.argsort(weight, kind="stable")
    bounds = np.concatenate((blocks, [len(todo)]))
    held, filled = [], 0
    for k, b in enumerate(rank.tolist()):
        held.append(b)
        filled += int(weight[b])
        if filled >= SORT_BYTES or k == len(rank) - 1:
            picked = np.concatenate([todo[bounds[x] : bounds[x + 1]] for x in held])
            size = d_len[picked] + 1
            ends = np.cumsum(size)
            begin = ends - size
            # 0xFF, which UTF-8 never has, ends each string.
            text = np.full(int(ends[-1]), 0xFF, np.uint8)
            inner = np.arange(int(ends[-1])) - np.repeat(begin, size)
            real = inner < np.repeat(d_len[picked], size)
            text[real] = data[(np.repeat(d_at[picked], size) + inner)[real]]
            cuts = np.concatenate(([0], np.cumsum(weight[held])))
            _, order = suffix_arrays(text, cuts)
            owner = np.repeat(np.arange(len(picked)), size)
            whole = order[inner[order] + LENGTH <= d_len[picked][owner[order]]]
            block = np.searchsorted(cuts, whole, side="right")
            near = np.flatnonzero(block[1:] == block[:-1])
            alike = near[_equal_windows(text, whole[near], whole[near + 1])]
            found = np.zeros(len(text), bool)
            found[whole[alike]] = True
            found[whole[alike + 1]] = True
            for i, d in enumerate(picked.tolist()):
                confirmed[d] = found[begin[i] : begin[i] + d_len[d] - LENGTH + 1]
            held, filled = [], 0
    offset = p_at - offs[p_row] + start[p_row]
    full = sure[which] | np.array([d not in confirmed or bool(confirmed[d].all()) for d in range(len(names))])[which]
    out = [(t[p_row[full]], offset[full], offset[full] + p_len[full])]
    for i in np.flatnonzero(~full).tolist():
        mask = confirmed[int(which[i])]
        ends = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).reshape(-1, 2)
        out.append((np.repeat(t[p_row[i]], len(ends)), offset[i] + ends[:, 0], offset[i] + ends[:, 1] - 1 + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _repeats(batches):
    """Rows come in the order of key; a batch is worked through up to its last key, whose rows wait for the next."""
    held: pa.Table | None = None

    def work(table: pa.Table):
        table = table.combine_chunks()
        key, start, n = (table.column(k).to_numpy().astype(np.int64) for k in (0, 2, 3))
        texts = table.column(1).combine_chunks().dictionary_encode()
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        t = texts.indices.to_numpy().astype(np.int64)
        data, offs = shared.text_buffers(table.column(4))
        # A repeated row of the input gives the same run twice: once is enough.
        twice = np.lexsort((start, t, key))
        same = (key[twice][1:] == key[twice][:-1]) & (t[twice][1:] == t[twice][:-1]) & (start[twice][1:] == start[twice][:-1])
        if same.any():
            keep = np.sort(np.concatenate((twice[:1], twice[1:][~same])))
            yield from work(table.take(pa.array(keep)))
            return
        found = repeated(key, t, start, n, data, offs)
        yield pa.RecordBatch.from_arrays([texts.dictionary.take(pa.array(found[0], pa.int64())), *[pa.array(x, pa.int64()) for x in found[1:]]], names=["t", "a", "z"])

    for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        key = held.column(0).to_numpy()
        if held.nbytes > 2 * SORT_BYTES and key[0] != key[-1]:
            stop = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield from work(held.slice(0, stop))
            held = held.slice(stop).combine_chunks()
    if held is not None:
        yield from work(held)


def _windows(batches):
    """Two hashes of every window of hot runs."""
    for batch in batches:
        for part in shared.chunks(batch, "piece", CHUNK_BYTES // 4):
            start, n = (part.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            data, offs = shared.text_buffers(part.column(4))
            row = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = offs[row] + inner
            zero = np.zeros(len(row), np.int64)
            one = _hash_at(tokens.prefix(data.astype(np.uint16) + np.uint16(1)), at, at + LENGTH, zero)
            # The second is over other values of the bytes, so it does not follow from the first.
            two = _hash_at(tokens.prefix(_OTHER[data]), at, at + LENGTH, zero)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), part.column(1).take(pa.array(row)), pa.array(start[row] + inner)], names=["w1", "w2", "t", "start"])


def _remove(batches):
    for batch in batches:
        for part in shared.chunks(batch, "text", CHUNK_BYTES):
            removed, spans, kept = [], [], []
            data, offs = shared.text_buffers(part.column(2))
            for i, ivs in enumerate(part.column(3)):
                n = int(offs[i + 1] - offs[i])
                a, z = (ivs.values.field(k).to_numpy() for k in range(2))
                change = np.zeros(n + 1, np.int32)
                np.add.at(change, a, 1)
                np.add.at(change, z, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(hashlib.sha256(data[offs[i] : offs[i + 1]][~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["id", "t", "removed", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # The document that stands for a text; null doc_ids join as any other.
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # 128 bits of the text's SHA-256 name it.
    name = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
    whole = docs.select("doc_id", ident.alias("id"), name.alias("t"), text.alias("text"))
    texts = shared.written(whole.select("doc_id", "id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "texts")
    reps = shared.written(texts.groupBy("t").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "text-copies")
    runs = shared.written(whole.select("t", "text").mapInArrow(_runs, "key long, t binary, start int, n int, many boolean"), "runs")
    place = F.xxhash64("t", "start")
    keys = runs.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("times"), F.max("many").alias("many"))
    keys = shared.written(keys.where("lo <> hi OR many").select("key", (F.col("times") > HOT).alias("hot")), "run-keys")
    # The copies of a text give the same runs: a set by text holds each once, at its representative.
    picked = runs.join(keys, "key").groupBy("t").agg(
        F.collect_set(F.when(~F.col("hot"), F.struct("key", "start", "n"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.struct("key", "start", "n"))).alias("hot")
    )
    picked = shared.written(picked.join(reps.select("t", "id"), "t"), "picked")
    body = shared.likely_among(whole.select("t", "id", "text"), "t", picked, texts.count())

    def cut(which: str) -> DataFrame:
        lists = picked.where(F.size(which) > 0).select("t", "id", F.col(which).alias("runs"))
        return body.join(lists, ["t", "id"]).select("t", "text", "runs").mapInArrow(_cut, "key long, t binary, start int, n int, piece binary")

    cold = cut("cold").repartition("key").sortWithinPartitions("key").mapInArrow(_repeats, "t binary, a long, z long")
    if not keys.where("hot").isEmpty():
        digests = shared.written(cut("hot").mapInArrow(_windows, "w1 long, w2 long, t binary, start long"), "hot-windows")
        twice = digests.groupBy("w1", "w2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("w1", "w2")
        cold = cold.unionByName(digests.join(twice, ["w1", "w2"]).select("t", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("z")))
    spans = cold.groupBy("t").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    spans = spans.join(reps.where("copies = 1").select("t", "id"), "t")
    done = body.join(spans, ["t", "id"]).select("id", "t", "text", "spans").mapInArrow(_remove, "id string, t binary, removed long, spans long, kept string")
    done = shared.written(done, "removed")
    shared.forget(runs, keys, picked)
    out = texts.join(reps.select("t", "copies"), "t").join(done, ["t", "id"], "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(shared.read_table(spark, sf_dir, "documents"))
