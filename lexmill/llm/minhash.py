"""Near-duplicates by DartMinHash: sparse weighted signatures, banded joining, exact check, classes.

A document is a weighted set: its shingles of SHINGLE words, weighted by how often they occur.
Each unit of an element's weight is a region on which a Poisson process, fixed by hashing, throws
darts: each dart has a rank and one of K coordinates. A document of weight W needs only the darts
of rank below (K ln K + 2K) / W; the earliest dart at each coordinate is the signature, and the
bound is doubled for a document with a coordinate left empty. Two signatures agree at a coordinate
with probability equal to the weighted Jaccard similarity, and a document costs W + K log K.

Signatures agree in a band of ROWS coordinates or more: such documents share a bucket. Exact copies
(same words) are one representative from the start. Within a bucket every member is compared with
the leader, the member whose buckets are the most crowded (the source of a group of copies is in
all its buckets), and with its NEAR next members in the order of their signatures, read from a
place that differs from bucket to bucket: likeness puts members side by side. Pairs that the
signatures don't rule out are checked on the shingles themselves: similarity SIMILAR or more is a
link. A group so costs its size, not its pairs, where its links connect it. Where they leave a bucket
in several components, each member outside the largest is compared with the members of the others, in
blocks of BLOCK by BLOCK: the likeliest pair of each is checked on its shingles first, which joins most
components, then every pair that is left between two, so that none that could join them goes unchecked.
Blocks are dealt with signatures only; shingles follow for those members of a block that are in such a pair.
Classes are the connected components of all links.

Links within a component change nothing, so leaving them out loses no class.

Defined cases: a text of fewer than SHINGLE words is one shingle; null and wordless texts, and rows
with a null doc_id, are classes of their own and stay; rows equal in doc_id and words are one document; of
rows with one doc_id and different words each is judged by its own; of a class the smallest doc_id stays (of
one doc_id's texts, the one with the least digest); a text is held whole in memory, with some ten times its
bytes beside it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import shared, tokens
from lexmill.llm.components import components

SHINGLE = 5
#: Similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 26, 5
K = BANDS * ROWS
#: Pairs whose signatures agree less than this, four standard errors below the threshold, are not checked: one in 30,000 at the threshold, as many as share no bucket.
MAYBE = 0.66
#: Members after it, in a bucket's order, that a member is compared with; coordinates that make the order.
NEAR, ORDER = 3, 12
#: Members on either side of a block of pairs, about; pairs whose signatures are compared at a time.
BLOCK, AT_ONCE = 512, 1 << 14
CHUNK_BYTES = (1 << 20) - 4096
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def strips(w: tokens.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, id) of each unit of weight: the n-th occurrence of a shingle in a document is a strip of its own."""
    doc, shingle = tokens.shingles(w, size)
    if not len(doc):
        return doc, shingle
    order = np.argsort(tokens.mix(shingle ^ tokens.mix(doc.astype(np.uint64) + np.uint64(1))), kind="stable")
    doc, shingle = doc[order], shingle[order]
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])))
    at = np.arange(len(doc))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return doc, tokens.mix(shingle + nth.astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47))


def _throw(doc: np.ndarray, strip: np.ndarray, limit: np.ndarray, sig: np.ndarray) -> None:
    """Darts of rank below limit[doc], the earliest by document and coordinate into sig."""
    clock = np.zeros(len(doc))
    flat, k = sig.reshape(-1), np.uint64(sig.shape[1])
    turn = 0
    while len(doc):
        h = tokens.mix(strip + np.uint64((turn * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        live = clock < limit[doc]
        doc, strip, clock, h = doc[live], strip[live], clock[live], h[live]
        h = tokens.mix(h)
        at = doc * int(k) + (((h >> np.uint64(32)) * k) >> np.uint64(32)).astype(np.int64)
        dart = (clock.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, at, dart)
        turn += 1


def signatures(doc: np.ndarray, strip: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """k dart ids (32 bits) for each document; rows of documents without strips are all ones."""
    sig = np.full((n_docs, k), _NONE, np.uint64)
    weight = np.bincount(doc, minlength=n_docs)
    limit = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        mine = todo[doc]
        _throw(doc[mine], strip[mine], limit, sig)
        todo &= (sig == _NONE).any(axis=1)
        limit = limit * 2
    return (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.zeros((len(sig), bands), np.uint64) + tokens.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        key = tokens.mix(key + sig[:, r::rows][:, :bands].astype(np.uint64))
    return key.view(np.int64)


def _names(w: tokens.Words) -> list[str | None]:
    """A 128-bit digest of each document's words; None without any."""
    first = w.first
    return [xxhash.xxh3_128_hexdigest(w.hash[first[d] : first[d + 1]].tobytes()) if w.counts[d] else None for d in range(len(w.counts))]


def _sign(batches):
    for batch in batches:
        for part in shared.chunks(batch, "text", CHUNK_BYTES):
            w = tokens.words(*shared.text_buffers(part.column(1)), tokens.WORDS)
            doc, strip = strips(w)
            sig = signatures(doc, strip, part.num_rows)
            keys = band_keys(sig)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(_names(w), pa.string()), lists, pa.array([x.tobytes() for x in sig], pa.binary()), part.column(2)], names=["doc_id", "digest", "bands", "sig", "name"]
            )


def _agree(batches):
    """Share of coordinates at which two signatures agree."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, K) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(axis=1))], names=["u", "v", "likeness"])


def _order(batches):
    """A bucket's members by signature, from a place and in steps that the bucket's key gives."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, K)
        bucket = batch.column(0).to_numpy().view(np.uint64)
        step = (bucket >> np.uint64(8)) % np.uint64(K // 2) * np.uint64(2) + np.uint64(1)
        at = (bucket[:, None] % np.uint64(K) + step[:, None] * np.arange(ORDER, dtype=np.uint64)) % np.uint64(K)
        keys = np.take_along_axis(sig, at.astype(np.int64), 1).astype(">u4")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in keys], pa.binary()), batch.column(2)], names=["bucket", "id", "order", "sig"])


def _neighbours(batches):
    """Pairs of a member and the NEAR after it in its bucket whose signatures may mean SIMILAR; rows come in the order of bucket and signature."""
    bucket, ids, sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, K), np.uint32)
    for batch in batches:
        fresh = len(bucket)
        bucket = np.concatenate((bucket, batch.column(0).to_numpy()))
        ids = np.concatenate((ids, batch.column(1).to_numpy()))
        sig = np.concatenate((sig, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, K)))
        out = []
        for k in range(1, NEAR + 1):
            same = (bucket[k:] == bucket[:-k]) & (ids[k:] != ids[:-k]) & (np.arange(k, max(k, len(ids))) >= fresh)
            same[same] = (sig[k:][same] == sig[:-k][same]).mean(axis=1) >= MAYBE
            out.append(np.stack((ids[k:][same], ids[:-k][same])))
        pairs = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])
        bucket, ids, sig = bucket[-NEAR:], ids[-NEAR:], sig[-NEAR:]


_PAIR, _MEMBER = "u long, v long", "block long, side int, id long, root long, sig binary, bucket long"


def _cross(batches, pick: str):
    """Pairs of different components whose signatures may mean SIMILAR, of each block's members of side 0 and of sides 1 and 2; rows come in the order of block and side.

    pick: "best" gives for each member of side 0 the likeliest pair only, "members" the rows of those that are in a pair, "links" the pairs that are SIMILAR by their strips."""

    def pairs(block, side, ids, root, sig, buckets, strips, edge):
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            k = a + int(np.searchsorted(side[a:z], 1))
            held, n, asked = [], 0, np.zeros(z - a, bool)
            # A few of side 0 at a time: a block's pairs are never all in memory.
            step = max(1, AT_ONCE // max(z - k, 1))
            for r in range(a, k, step):
                r2 = min(r + step, k)
                x, y = np.nonzero((root[r:r2, None] != root[None, k:z]) & ((side[None, k:z] == 2) | (ids[r:r2, None] < ids[None, k:z])))
                held.append((x + r, y + k))
                n += len(x)
                if n and (n >= AT_ONCE or r2 == k):
                    x, y = agreeing(held, sig, strips, buckets[a])
                    held, n = [], 0
                    if pick == "members":
                        asked[x - a] = asked[y - a] = True
                    else:
                        both = np.sort(np.stack((ids[x], ids[y])), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])
            if asked.any():
                m = a + np.flatnonzero(asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[m]), pa.array(side[m]), pa.array(ids[m]), pa.array(root[m]), pa.array([g.tobytes() for g in sig[m]], pa.binary()), pa.array(buckets[m])],
                    names=["block", "side", "id", "root", "sig", "bucket"],
                )

    def agreeing(held, sig, strips, bucket):
        x, y = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        same = sig[x] == sig[y]
        like = same.mean(axis=1)
        # A pair counts in the first bucket that it shares only: that of its first equal band.
        band = int(np.flatnonzero(band_keys(sig[x[:1]])[0] == bucket)[0])
        shared_ = same[:, : BANDS * ROWS].reshape(len(x), BANDS, ROWS).all(axis=2)
        ok = (like >= MAYBE) & (shared_.argmax(axis=1) == band)
        if pick == "best":
            order = np.lexsort((-like, x))
            order = order[ok[order]]
            ok = np.zeros(len(x), bool)
            ok[order[np.concatenate(([True], x[order][1:] != x[order][:-1]))] if len(order) else order] = True
        elif pick == "links":
            k = np.flatnonzero(ok)
            ok[k] = [_similar(np.frombuffer(strips[i], np.uint64), np.frombuffer(strips[j], np.uint64)) for i, j in zip(x[k].tolist(), y[k].tolist(), strict=True)]
        return x[ok], y[ok]

    rest = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, K), np.uint32), np.zeros(0, np.int64), np.zeros(0, object)]
    for batch in batches:
        new = [batch.column(k).to_numpy() for k in range(4)] + [np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(-1, K), batch.column(5).to_numpy()]
        new.append(np.array([*batch.column(6).to_pylist(), None], object)[:-1] if pick == "links" else np.full(batch.num_rows, None))
        rows = [np.concatenate(x) for x in zip(rest, new, strict=True)]
        block = rows[0]
        edge = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1)) if len(block) else np.zeros(1, np.int64)
        yield from pairs(*rows, edge)
        rest = [x[edge[-1] :] for x in rows]
    yield from pairs(*rest, np.array([0, len(rest[0])]))


def _sets(batches):
    """Each text's sorted strips."""
    for batch in batches:
        for part in shared.chunks(batch, "text", CHUNK_BYTES):
            w = tokens.words(*shared.text_buffers(part.column(1)), tokens.WORDS)
            doc, strip = strips(w)
            order = np.lexsort((strip, doc))
            doc, strip = doc[order], strip[order]
            at = np.searchsorted(doc, np.arange(part.num_rows + 1))
            blobs = [strip[at[d] : at[d + 1]].tobytes() for d in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_names(w), pa.string()), pa.array(blobs, pa.binary())], names=["doc_id", "digest", "strips"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of strips are SIMILAR."""
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    both = int((y[at] == x).sum()) if len(y) else 0
    return both * SIMILAR[1] >= (len(x) + len(y) - both) * SIMILAR[0]


def _check(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            keep.append(_similar(*(np.frombuffer(s.as_py(), np.uint64) for s in (a, b))))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(u, v): pairs of representatives, by their numbers, that share a bucket, its leader's and neighbours', and whose signatures may mean SIMILAR.

    With them the tables of the buckets' members and of their signatures."""
    rows = signed.select("id", F.explode("bands").alias("bucket"))
    crowded = shared.written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    # Most members are alone in their bucket: they aren't shuffled again.
    members = shared.written(shared.likely_among(rows, "bucket", crowded, crowded.count()).join(crowded, "bucket"), "buckets")
    crowd = shared.written(members.groupBy("id").agg(F.sum("n").alias("p")), "crowds")
    sig = shared.written(signed.select("id", "sig").join(crowd.select("id"), "id", "left_semi"), "signatures")
    lead = members.join(crowd, "id").groupBy("bucket").agg(F.max(F.struct("p", (-F.col("id")).alias("less"))).alias("m")).select("bucket", (-F.col("m.less")).alias("leader"))
    star = members.join(lead, "bucket").where("leader <> id").select(F.least("leader", "id").alias("u"), F.greatest("leader", "id").alias("v"))
    both = star.distinct().join(sig.withColumnsRenamed({"id": "u", "sig": "a"}), "u").join(sig.withColumnsRenamed({"id": "v", "sig": "b"}), "v")
    star = both.select("u", "v", "a", "b").mapInArrow(_agree, "u long, v long, likeness double").where(F.col("likeness") >= MAYBE).select("u", "v")
    # Ranges of (bucket, order), not buckets, are dealt to tasks: a hot bucket is split.
    ordered = members.join(sig, "id").select("bucket", "id", "sig").mapInArrow(_order, "bucket long, id long, `order` binary, sig binary")
    dealt = ordered.repartitionByRange("bucket", "order").sortWithinPartitions("bucket", "order", "id")
    near = dealt.select("bucket", "id", "sig").mapInArrow(_neighbours, "u long, v long")
    out = shared.written(star.unionByName(near).distinct(), "pairs")
    shared.forget(crowded, crowd)
    return out, members, sig


def missed(docs: DataFrame, reps: DataFrame, members: DataFrame, sig: DataFrame, roots: DataFrame, n_docs: int, best: bool) -> DataFrame:
    """(u, v): pairs that share a bucket, are in different components (roots: those of the links found), and whose signatures may mean SIMILAR.

    best: of a member outside its bucket's largest component the likeliest in each block. Else all that are
    SIMILAR by their shingles, which go to the blocks with those members that are in a pair there: no pair leaves
    a block that isn't a link."""
    # The leader has met both members of a bucket of two.
    rows = members.where("n > 2").join(roots.withColumnsRenamed({"u": "id", "v": "root"}), "id", "left")
    rooted = shared.written(rows.select("bucket", "id", F.coalesce("root", "id").alias("root")), "rooted")
    parts = rooted.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    parts = parts.groupBy("bucket").agg(F.sum("size").alias("n"), F.max(F.struct("size", "root")).alias("most")).where("n > most.size")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = parts.select("bucket", F.col("most.root").alias("most"), blocks(F.col("n") - F.col("most.size")).alias("few"), blocks(F.col("n")).alias("all"))
    rows = rooted.join(parts, "bucket")
    rows = rows.join(sig, "id")
    small = F.col("root") != F.col("most")
    place = F.xxhash64("id", "bucket")
    x, y = (F.pmod(place, F.col(k)).cast("int") for k in ("few", "all"))
    xs, ys = (F.explode(F.sequence(F.lit(0), F.col(k) - 1)) for k in ("few", "all"))
    probes = rows.where(small).select("bucket", x.alias("x"), ys.alias("y"), F.lit(0).alias("side"), "id", "root", "sig")
    others = rows.select("bucket", xs.alias("x"), y.alias("y"), F.when(small, 1).otherwise(2).alias("side"), "id", "root", "sig")
    dealt = probes.unionByName(others).select(F.xxhash64("bucket", "x", "y").alias("block"), "side", "id", "root", "sig", "bucket")
    crossed = lambda rows, pick, schema: rows.repartition("block").sortWithinPartitions("block", "side").mapInArrow(lambda batches: _cross(batches, pick), schema)
    if best:
        out = shared.written(crossed(dealt, "best", _PAIR).distinct(), "missed")
    else:
        paired = shared.written(crossed(dealt, "members", _MEMBER), "paired")
        once, stale = _strips(docs, reps, paired.select("id").distinct(), n_docs)
        out = shared.written(crossed(paired.join(once, "id").select(*paired.columns, "strips"), "links", _PAIR).distinct(), "missed")
        shared.forget(paired, *stale)
    shared.forget(rooted)
    return out


def links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n_docs: int) -> DataFrame:
    """The pairs (of representatives' numbers) whose shingles, not only their signatures, are SIMILAR.

    Texts are read again, not shuffled; of those that are not asked for, most are filtered out, and the rest find no pair."""
    once, stale = _strips(docs, reps, pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), n_docs)
    both = pairs.join(once.withColumnsRenamed({"id": "u", "strips": "a"}), "u").join(once.withColumnsRenamed({"id": "v", "strips": "b"}), "v")
    out = shared.written(both.select("u", "v", "a", "b").mapInArrow(_check, _PAIR), "links")
    shared.forget(*stale)
    return out


def _strips(docs: DataFrame, reps: DataFrame, asked: DataFrame, n_docs: int) -> tuple[DataFrame, list[DataFrame]]:
    """id, strips of the representatives asked for (column id), one row for each; and the tables that hold them until forgotten."""
    need = shared.written(reps.select("id", "doc_id", "digest").join(asked, "id"), "asked")
    rows = shared.likely_among(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), "doc_id", need.select("doc_id"), n_docs)
    sets = rows.mapInArrow(_sets, f"doc_id {_type(docs)}, digest string, strips binary")
    sets = shared.written(sets.join(need, ["doc_id", "digest"]).select("id", "strips"), "strips")
    return sets.dropDuplicates(["id"]), [need, sets]


def _type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, name (a hash of the text), class_id (the class's smallest doc_id) and kept (this document is the one that stays), a row per row of docs."""
    docs = docs.select("doc_id", "text")
    named = docs.withColumn("name", F.xxhash64("text"))
    signed = shared.written(named.mapInArrow(_sign, f"doc_id {_type(docs)}, digest string, bands array<long>, sig binary, name long"), "signed")
    # One representative for each text, numbered by its place in the stored table. Signatures are kept once, by the table that is needed next.
    reps = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = shared.written(reps.withColumn("id", F.monotonically_increasing_id()), "representatives")
    rows = shared.written(signed.select("doc_id", "name", "digest"), "names")
    shared.forget(signed)
    pairs, members, sig = candidates(reps)
    wide, reps = reps, shared.written(reps.select("id", "doc_id", "digest"), "numbered")
    shared.forget(wide)
    n_docs = rows.count()
    found = links(docs, reps, pairs, n_docs)
    stale = [pairs, found]
    roots = components(found)
    # First the likeliest pairs between components, which join most of them; then all that are left between components.
    for best in (True, False):
        more = missed(docs, reps, members, sig, roots, n_docs, best)
        stale.append(more)
        if more.isEmpty():
            continue
        if best:
            more = links(docs, reps, more, n_docs)
            stale.append(more)
        # The components found stand for their links.
        stale.append(roots)
        roots = components(roots.unionByName(more))
    rooted = reps.select("id", "digest", "doc_id").join(roots.withColumnsRenamed({"u": "id", "v": "root"}), "id", "left")
    rooted = shared.written(rooted.select("digest", "doc_id", F.coalesce("root", "id").alias("root")), "rooted-texts")
    # Classes of one text need no second look.
    firsts = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    texts = shared.written(rooted.join(firsts, "root").select("digest", F.col("first.doc_id").alias("class_id"), F.col("first.digest").alias("best")), "classes")
    out = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL").join(texts, "digest")
    out = out.select("doc_id", "name", "class_id", (F.col("class_id").eqNullSafe(F.col("doc_id")) & (F.col("best") == F.col("digest"))).alias("kept"))
    alone = rows.where("doc_id IS NULL OR digest IS NULL").select("doc_id", "name", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    out = shared.written(out.unionByName(alone), "judged")
    shared.forget(rows, reps, members, sig, *stale, roots, rooted, texts)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept of judged(); a document is kept if its row is."""
    return judged(docs).select("doc_id", "class_id", "kept")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without those documents for which another of their class stays; the texts of those that stay don't move if the others are few."""
    gone = shared.written(judged(docs).where("NOT kept").select("doc_id", "name").distinct(), "near-copies")
    names = docs.columns
    id_, name = shared.spare(names, "_id"), shared.spare(names, "_name")
    rows = docs.withColumns({id_: F.col("doc_id"), name: F.xxhash64("text")})
    return shared.without(rows, gone.withColumnsRenamed({"doc_id": id_, "name": name}), [id_, name], gone.count()).select(*[F.col(f"`{n}`") for n in names])


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(shared.read_table(spark, sf_dir, "documents"))
