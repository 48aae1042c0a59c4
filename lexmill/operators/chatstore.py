"""The conversation store: users, threads, steps, elements and feedback, and the reads and deletes they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.stored import stored

#: The kinds of steps.
STEP_TYPES = ("assistant_message", "embedding", "llm", "retrieval", "rerank", "run", "system_message", "tool", "undefined", "user_message")

_STAMPS = "createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ"
#: Columns of the store.
SCHEMAS = {
    "User": f"id STRING, {_STAMPS}, metadata STRING, identifier STRING",
    "Thread": f"id STRING, {_STAMPS}, deletedAt TIMESTAMP_NTZ, name STRING, metadata STRING, tags ARRAY<STRING>, userId STRING",
    "Step": f"id STRING, {_STAMPS}, parentId STRING, threadId STRING, input STRING, metadata STRING, name STRING, output STRING, type STRING, showInput STRING, isError BOOLEAN, startTime TIMESTAMP_NTZ, endTime TIMESTAMP_NTZ",
    "Element": f"id STRING, {_STAMPS}, threadId STRING, stepId STRING, metadata STRING, mime STRING, name STRING, objectKey STRING, url STRING, chainlitKey STRING, display STRING, size STRING, language STRING, page INT, props STRING",
    "Feedback": f"id STRING, {_STAMPS}, stepId STRING, name STRING, value DOUBLE, comment STRING",
}


def with_defaults(steps: DataFrame) -> DataFrame:
    return steps.withColumns({"showInput": F.coalesce("showInput", F.lit("json")), "isError": F.coalesce("isError", F.lit(False))})


def thread_defaults(threads: DataFrame) -> DataFrame:
    return threads.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def timeline(steps: DataFrame, thread: str = "threadId", start: str = "startTime", end: str = "endTime") -> DataFrame:
    """Steps in their thread's order: the sort is by partition of threads."""
    return steps.repartition(thread).sortWithinPartitions(thread, start, end)


def step_depths(steps: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """id, root and depth of every step at or below a root (column id; by default those without a parent); of roots above one another the nearest counts.

    Pointers are doubled: each round takes a step as far up as the one it points to has come, so a tree of any
    depth takes as many rounds as its depth has bits. Steps of a cycle, and those without a root, are left out."""
    top = (steps.where("parentId IS NULL") if roots is None else roots).select(F.col("id").alias("_root")).distinct()
    all_ = steps.select("id", "parentId").join(top, F.col("id") == F.col("_root"), "left")
    done = all_.where("_root IS NOT NULL").select("id", F.col("id").alias("up"), F.lit(0).alias("depth"))
    open_ = all_.where("_root IS NULL AND parentId IS NOT NULL").select("id", F.col("parentId").alias("up"), F.lit(1).alias("depth"))
    state = stored(done.withColumn("ended", F.lit(True)).unionByName(open_.withColumn("ended", F.lit(False))))
    before = -1
    while True:
        open_ = state.where("NOT ended")
        n = open_.count()
        # Below a root, every round ends some: where none has, only cycles are left.
        if n in (0, before):
            break
        before = n
        far = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("ended").alias("ends"))
        step = open_.join(far, "up").select("id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).cast("int").alias("depth"), F.col("ends").alias("ended"))
        state = stored(state.where("ended").unionByName(step))
    return state.where("ended").select("id", F.col("up").alias("root"), "depth")


def counts(steps: DataFrame, by: str = "type") -> DataFrame:
    return steps.groupBy(by).agg(F.count("*").alias("n"))


def feedback_summary(feedback: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    return feedback.groupBy(name).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"))


def live(threads: DataFrame) -> DataFrame:
    return threads.where(F.col("deletedAt").isNull())


def tagged(threads: DataFrame, tag: str) -> DataFrame:
    return threads.where(F.array_contains("tags", tag))


def delete_threads(store: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The store without the threads (column id) and what hangs on them: steps and elements go, feedback loses its step."""
    steps_gone = store["Step"].join(gone.select(F.col("id").alias("threadId")), "threadId", "left_semi")
    # Steps below a deleted step go with it, in whatever thread they are.
    dead = step_depths(store["Step"], steps_gone).select("id").distinct()
    elements = store["Element"].join(gone.select(F.col("id").alias("threadId")), "threadId", "left_anti")
    feedback = store["Feedback"].join(dead.select(F.col("id").alias("stepId"), F.lit(True).alias("_gone")), "stepId", "left")
    return store | {
        "Thread": store["Thread"].join(gone.select("id"), "id", "left_anti"),
        "Step": store["Step"].join(dead, "id", "left_anti"),
        "Element": elements.join(dead.select(F.col("id").alias("stepId")), "stepId", "left_anti").select(*store["Element"].columns),
        "Feedback": feedback.withColumn("stepId", F.when(F.col("_gone").isNull(), F.col("stepId"))).select(*store["Feedback"].columns),
    }


def delete_users(store: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The store without the users (column id); their threads stay, without a user."""
    threads = store["Thread"].join(gone.select(F.col("id").alias("userId"), F.lit(True).alias("_gone")), "userId", "left")
    return store | {
        "User": store["User"].join(gone.select("id"), "id", "left_anti"),
        "Thread": threads.withColumn("userId", F.when(F.col("_gone").isNull(), F.col("userId"))).select(*store["Thread"].columns),
    }
