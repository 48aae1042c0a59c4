"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source's target is its weighted share of all words, held at MOST times what it has; the
excess is reshared by weight until none is above. Within a source, a document's expected copies
go with its length class, the bits of its word count (1 for one word, 9 for 300, 15 for 20,000): they
are rate * class, held at MOST, at the one rate that adds up to the target. Whole copies are
certain; the fraction left is the document's own probability of one more. For that, documents are
ranked by the odds of a uniform number, fixed by doc_id, text and seed, divided by their odds of
inclusion, and taken in the order of rank as long as they fit the words the target still lacks: the
sample's size is fixed, in words.

Taking in order is done in passes. A pass takes, of the documents that fit what is left, the first
whose sizes add up to it; what is left then is smaller than the next one's size. A source's passes end when
no document fits, or what is left is SLACK of the target at most. A pass is a budget and a last rank for each source, so the table of documents is
never rewritten: a document is taken if some pass's budget holds it and its rank comes no later.

A running total over a source, which may hold a third of all rows, is never one task: sums by bins of
the rank say in which bin the cut falls, that bin is divided again until it has few rows, and only
those are ordered. Sources, which may be hosts, are never in one window either.

Defined cases: a null text has no words and is never taken; a null source is a source of its own,
the last; rows equal in doc_id and text are taken together or not at all; with no words in the table all
targets are 0; an empty table gives an empty result; columns other than doc_id, text and source pass
through sample() unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm import shared

WEIGHTS = (5, 2, 1)
MOST = 3
#: Bins a range of ranks is divided into; rows that are few enough to be ordered by one task.
BINS, FEW_ROWS = 1024, 50_000
#: Share of a target that may be left open.
SLACK = 0.001
#: Most sources whose table is broadcast: some MB.
FEW_SOURCES = 50_000


def word_count(text) -> F.Column:
    """Runs of anything but ASCII white space."""
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " "), lambda x: x != "")).cast("long")


def uniform(seed: int) -> F.Column:
    """A number in (0, 1) fixed by doc_id, text and seed, from 48 bits of an MD5."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed)), F.coalesce(F.col("text"), F.lit("")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def length_class(size) -> F.Column:
    """Bits of the size: 0 for none, and at most 63, whatever the documents."""
    return F.when(F.col(size) > 0, F.length(F.bin(size))).otherwise(0)


def weighed(sizes: DataFrame, weights) -> DataFrame:
    """source, source_size and w, the weight by the source's place in the order of code points, null last; ranges of sources are numbered side by side."""
    ranged = shared.written(sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    # A row for each partition.
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, first = 0, [F.lit(-1), F.lit(0)]
    for part in sorted(counts):
        first += [F.lit(part), F.lit(before)]
        before += counts[part]
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.element_at(F.create_map(*first), F.col("part"))
    return ranged.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int")).cast("long")).drop("part")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target. sizes: a row per source. The level is raised until no source is above its ceiling."""
    s = weighed(sizes, weights).withColumn("cap", F.lit(most) * F.col("source_size"))
    total, open_, level = s.agg(F.sum("source_size"), F.sum("w")).first() + (0.0,)
    held = 0
    while total:
        level = (total - held) / open_ if open_ else 0.0
        over = F.lit(level) * F.col("w") > F.col("cap")
        held_, open__ = s.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0))).first()
        if held_ == held:
            break
        held, open_ = held_, open__
    share = F.lit(float(level)) * F.col("w")
    return s.select("source", "source_size", F.when(share > F.col("cap"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def rates(classes: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """source, rate, sure: copies a length class, by which the source's documents add up to its target, and the words of their whole copies. classes: source, class, words."""
    own = W.partitionBy("source").orderBy(F.desc("class"))
    c = classes.withColumns({"held": F.coalesce(F.sum("words").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "open": F.sum(F.col("class") * F.col("words")).over(own.rowsBetween(W.currentRow, W.unboundedFollowing))})
    c = c.withColumnRenamed("source", "s").join(goal.select("source", "target"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    rate = (F.col("target") - F.lit(most) * F.col("held")) / F.col("open")
    # The longest classes reach the ceiling first; the first class that doesn't fixes the rate. None is left where the target is the ceiling of all.
    best = F.max(F.when(F.col("rate") * F.col("class") <= most, F.struct("class", "rate"))).over(W.partitionBy("source"))
    c = c.withColumn("rate", rate).withColumn("rate", best["rate"])
    whole = F.floor(copies_of(most)).cast("long")
    return c.groupBy("source").agg(F.first("rate").alias("rate"), F.sum(whole * F.col("words")).alias("sure"))


def copies_of(most: int) -> F.Column:
    """Copies to expect of a document of some words, by its class and its source's rate."""
    return F.coalesce(F.least(F.lit(float(most)), F.col("rate") * F.col("class")), F.lit(float(most)))


def _taken() -> F.Column:
    """Whether some pass takes the row."""
    own = F.struct("rank", "doc_id", "size")
    return F.exists("passes", lambda p: (F.col("size") <= p["budget"]) & (own <= p["last"]))


class Mix:
    """What the mix does with each source: `goal` has a row for each, with source_size, target, rate, and its passes."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 17):
        self.most, self.seed = most, seed
        base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), uniform(seed).alias("u"))
        self.base = shared.written(base.withColumn("class", length_class("size")), "mix-sizes")
        classes = shared.written(self.base.groupBy("source", "class").agg(F.sum("size").alias("words")), "mix-classes")
        goal = shared.written(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets")
        # A row a source is broadcast if there are few; else adaptive joins split hot sources.
        self.few = goal.count() <= FEW_SOURCES
        rate = rates(classes.where("class > 0"), goal, most).withColumnRenamed("source", "rs")
        goal = goal.join(rate, F.col("source").eqNullSafe(F.col("rs")), "left").drop("rs")
        goal = goal.withColumn("budget", F.coalesce(F.floor(F.col("target") - F.col("sure")), F.lit(0)).cast("long")).drop("sure")
        key = docs.schema["doc_id"].dataType.simpleString()
        self.pass_type = f"array<struct<budget:bigint,last:struct<rank:double,doc_id:{key},size:bigint>>>"
        self.goal = shared.written(goal.withColumn("passes", F.array().cast(self.pass_type)), "mix-state")
        shared.forget(classes)
        pool = self._ranked(self.base).where("chance > 0").select("source", "rank", "doc_id", "size")
        while True:
            pool = self._fitting(pool)
            most = pool.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            if most is None:
                break
            if most <= FEW_ROWS:
                self._state(self._finished(pool))
                break
            last = self._cut(pool).withColumnRenamed("source", "ls")
            goal = self.goal.join(last, F.col("source").eqNullSafe(F.col("ls")), "left").drop("ls")
            passes = F.when(F.col("last").isNull(), F.col("passes")).otherwise(F.concat("passes", F.array(F.struct("budget", "last")).cast(self.pass_type)))
            # Rows that tie can fit one by one and not together: a pass that takes nothing is the last.
            goal = goal.withColumns({"passes": passes, "budget": F.coalesce(F.col("budget") - F.col("used"), F.lit(0))})
            self._state(goal.drop("last", "used"))

    def _state(self, goal: DataFrame) -> None:
        before, self.goal = self.goal, shared.written(goal, "mix-state")
        shared.forget(before)

    def _named(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """rows with columns of their source's state."""
        state = self.goal.select(F.col("source").alias("s"), *columns)
        return rows.join(F.broadcast(state) if self.few else state, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """rows (source, size, u, class) with source_size, target, passes, whole copies, chance of one more, and rank."""
        rows = self._named(rows, ["source_size", "target", "rate", "passes"])
        expected = F.when(F.col("size") == 0, 0.0).otherwise(copies_of(self.most))
        rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long")).withColumn("chance", F.col("expected") - F.col("whole"))
        odds = (F.col("u") / (1 - F.col("u"))) * (1 - F.col("chance"))
        # odds of u over odds of inclusion, q, as q / (1 + q): the same order, within (0, 1).
        return rows.withColumn("rank", F.when(F.col("chance") > 0, odds / (odds + F.col("chance"))).otherwise(F.lit(1.0))).drop("expected", "class", "rate", "u")

    def _fitting(self, pool: DataFrame) -> DataFrame:
        """Rows not taken that fit what their source still lacks, if that is over SLACK of its target."""
        rows = self._named(pool, ["budget", "target", "passes"])
        rows = rows.where((F.col("size") <= F.col("budget")) & (F.col("budget") > SLACK * F.col("target")) & ~_taken())
        out = shared.written(rows.select("source", "rank", "doc_id", "size"), "mix-open")
        if hasattr(pool, "stored_at"):
            shared.forget(pool)
        return out

    def _cut(self, pool: DataFrame) -> DataFrame:
        """source, last, used: the last row of those in rank order that add up to the source's budget at most, and what they add up to."""
        key = F.struct("rank", "doc_id", "size")
        found, step = [], 1.0
        rows = self._named(pool, ["budget"]).withColumns({"lo": F.lit(0.0), "rest": F.col("budget")}).drop("budget")
        while True:
            # The bin in which the running total passes what is left; earlier bins are taken whole.
            step /= BINS
            binned = rows.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("rank") - F.col("lo")) / F.lit(step))))
            sums = binned.groupBy("source", "bin").agg(
                F.sum("size").alias("b"), F.max(key).alias("top"), F.count("*").alias("n"), F.min("rank").alias("r0"), F.max("rank").alias("r1"), F.first("rest").alias("rest"), F.first("lo").alias("lo")
            )
            own = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
            sums = shared.written(sums.withColumn("upto", F.sum("b").over(own)), "mix-bins")
            passed = F.col("upto") > F.col("rest")
            found.append(sums.where(~passed).groupBy("source").agg(F.max("top").alias("last"), F.sum("b").alias("used")))
            # Rows of one rank can't be divided further.
            divide = (F.col("n") > FEW_ROWS) & (F.col("r0") < F.col("r1"))
            edge = sums.where(passed).groupBy("source").agg(F.min(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("b")).alias("left"), "lo", divide.alias("divide"))).alias("e"))
            edge = edge.select(F.col("source").alias("es"), F.col("e.bin").alias("ebin"), F.col("e.left").alias("left"), (F.col("e.lo") + F.col("e.bin") * F.lit(step)).alias("elo"), F.col("e.divide").alias("divide"))
            if self.few:
                edge = F.broadcast(edge)
            close = binned.drop("rest", "lo").join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("bin") == F.col("ebin")))
            close = close.select("source", "rank", "doc_id", "size", F.col("elo").alias("lo"), F.col("left").alias("rest"), "divide")
            order = W.partitionBy("source").orderBy("rank", "doc_id", "size").rangeBetween(W.unboundedPreceding, W.currentRow)
            ready = close.where(~F.col("divide")).withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= F.col("rest"))
            found.append(ready.groupBy("source").agg(F.max(key).alias("last"), F.sum("size").alias("used")))
            if step < 1e-12 or edge.where("divide").isEmpty():
                break
            rows = close.where("divide").drop("divide")
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return every.groupBy("source").agg(F.max("last").alias("last"), F.sum("used").alias("used"))

    def _finished(self, pool: DataFrame) -> DataFrame:
        """The state after all passes, found by going through each source's rows in order; for sources of few rows."""
        named = self.goal.select(F.col("source").alias("s"), "target", "budget")
        ties = pool.groupBy("source", "rank", "doc_id", "size").agg(F.sum("size").alias("all"))
        rows = ties.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "size", "all"))).alias("rows"))
        rows = rows.join(F.broadcast(named) if self.few else named, F.col("source").eqNullSafe(F.col("s")))
        key = self.pass_type[self.pass_type.index("last:") + 5 : -2]
        none = F.lit(None).cast(key)
        more = lambda state: F.concat(state["passes"], F.array(F.struct(state["open"].alias("budget"), state["last"].alias("last"))).cast(self.pass_type))
        start = F.struct(F.col("budget").alias("left"), F.col("budget").alias("open"), none.alias("last"), F.lit(False).alias("done"), F.array().cast(self.pass_type).alias("passes"))

        def step(state, row):
            asked = ~state["done"] & (row["size"] <= state["open"])
            take, ends = asked & (row["all"] <= state["left"]), asked & (row["all"] > state["left"])
            again = ends & state["last"].isNotNull()
            own = F.struct(row["rank"].alias("rank"), row["doc_id"].alias("doc_id"), row["size"].alias("size")).cast(key)
            return F.struct(
                F.when(take, state["left"] - row["all"]).otherwise(state["left"]).alias("left"),
                F.when(again, state["left"]).otherwise(state["open"]).alias("open"),
                F.when(take, own).when(again, none).otherwise(state["last"]).alias("last"),
                (state["done"] | (ends & (state["last"].isNull() | (state["left"] <= SLACK * F.col("target"))))).alias("done"),
                F.when(again, more(state)).otherwise(state["passes"]).alias("passes"),
            )

        walk = F.aggregate("rows", start, step, lambda state: F.when(state["last"].isNull(), state["passes"]).otherwise(more(state)))
        found = rows.select(F.col("source").alias("fs"), walk.alias("found"))
        goal = self.goal.join(found, F.col("source").eqNullSafe(F.col("fs")), "left").drop("fs")
        return goal.withColumn("passes", F.when(F.col("found").isNull(), F.col("passes")).otherwise(F.concat("passes", "found"))).drop("found")

    def copies(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, size, u, class, and others that pass through) with source_size, target and copies."""
        ranked = self._ranked(rows)
        extra = (F.col("chance") > 0) & _taken()
        return ranked.withColumn("copies", F.col("whole") + extra.cast("long")).drop("whole", "chance", "rank", "passes")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every row of docs."""
    made = Mix(docs.select("doc_id", "source", "text"), weights, most, seed)
    out = made.copies(made.base)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def sample(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs. Rows stay where they are."""
    names = docs.columns
    made = Mix(docs.select("doc_id", "source", "text"), weights, most, seed)
    # All columns travel in one struct, so no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), "doc_id", "source", "text")
    rows = rows.select("row", "doc_id", "source", word_count(F.col("text")).alias("size"), uniform(seed).alias("u"))
    out = made.copies(rows.withColumn("class", length_class("size"))).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*[F.col(f"row.`{n}`").alias(n) for n in names])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL_OP3 = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> ''))::BIGINT AS size,
         ((('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, 'null'), ':17:', coalesce(text, ''))), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
dc AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM d),
s AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM (
    SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM dc GROUP BY source)),
level AS (
  SELECT *, row_number() OVER o AS k, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
free AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM level WHERE level * w <= cap),
goal AS (SELECT source, source_size, CASE WHEN level.k >= free.k THEN free.level * w ELSE cap::DOUBLE END AS target FROM level, free),
c AS (SELECT source, class, sum(size)::BIGINT AS words FROM dc WHERE class > 0 GROUP BY ALL),
co AS (
  SELECT c.source, class, (target - (3 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
         / (sum(class * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate
  FROM c JOIN goal ON c.source IS NOT DISTINCT FROM goal.source WINDOW o AS (PARTITION BY c.source ORDER BY class DESC)),
rate AS (SELECT source, arg_max(rate, class) AS rate FROM co WHERE rate * class <= 3 GROUP BY source),
e AS (
  SELECT dc.*, source_size, target, CASE WHEN size = 0 THEN 0.0 ELSE coalesce(least(3.0::DOUBLE, rate * class), 3.0::DOUBLE) END AS expected
  FROM dc JOIN goal ON dc.source IS NOT DISTINCT FROM goal.source LEFT JOIN rate ON dc.source IS NOT DISTINCT FROM rate.source),
f AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS chance FROM e),
r AS (SELECT *, CASE WHEN chance > 0 THEN ((u / (1 - u)) * (1 - chance)) / ((u / (1 - u)) * (1 - chance) + chance) ELSE 1.0 END AS rank FROM f),
b AS (SELECT source, any_value(target) AS target, floor(any_value(target) - sum(whole * size)::DOUBLE)::BIGINT AS budget FROM r GROUP BY source),
p AS (SELECT source, doc_id, size, row_number() OVER (PARTITION BY source ORDER BY rank, doc_id, size) AS n FROM r WHERE chance > 0),
walk AS (
  SELECT source, target, 0::BIGINT AS n, NULL::BIGINT AS doc_id, budget AS lack, budget AS open, budget <= 0.001 * target AS done, false AS took FROM b
  UNION ALL
  SELECT w.source, target, p.n, p.doc_id, CASE WHEN NOT done AND size <= lack THEN lack - size ELSE lack END,
         CASE WHEN size > lack AND size <= open THEN lack ELSE open END,
         done OR (size > lack AND size <= open AND lack <= 0.001 * target), NOT done AND size <= lack
  FROM walk w JOIN p ON w.source IS NOT DISTINCT FROM p.source AND p.n = w.n + 1)
SELECT r.doc_id, size, source_size, target, ((whole + coalesce(took, false)::INT) * size)::BIGINT AS taken
FROM r LEFT JOIN (SELECT doc_id, took FROM walk WHERE n > 0) t ON r.doc_id = t.doc_id
"""
