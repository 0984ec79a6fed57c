"""A queue of tasks as tables: claims, outcomes, routing, stale workers and progress, each one set-based step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, DONE = ("scheduled", "retrying", "running"), ("completed", "failed")


def eligible(status: Column, attempts: Column, most: int = 3) -> Column:
    """Scheduled, or retrying with attempts left."""
    return (status == "scheduled") | ((status == "retrying") & (attempts < most))


def claim(tasks: DataFrame, capacity: int, order: list[str], stage: str = "stage_name", most: int = 3) -> DataFrame:
    """The oldest eligible tasks of each stage, up to its capacity, one attempt more, running.

    Each task first keeps its own oldest ``capacity`` of a stage (a row limit inside the window that
    Spark pushes below the shuffle), so a long queue isn't sorted in one place.
    """
    w = Window.partitionBy(stage).orderBy(*order)
    got = tasks.where(eligible(F.col("status"), F.col("attempts"), most)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= capacity).drop("_n")
    return got.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def claim_within(tasks: DataFrame, limit: int, order: list[str], stage: str = "stage_name", most: int = 3) -> DataFrame:
    """As ``claim``, with ``limit`` less a stage's running tasks as its capacity."""
    running = tasks.where("status = 'running'").groupBy(stage).agg(F.count("*").alias("_running"))
    got = claim(tasks, limit, order, stage, most).join(running, stage, "left")  # the most a stage may take
    w = Window.partitionBy(stage).orderBy(*order)
    return got.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.lit(limit) - F.coalesce("_running", F.lit(0))).drop("_n", "_running")


def heartbeat(beats: DataFrame, new: DataFrame) -> DataFrame:
    """(executor_id, updated_at) upserted: the latest beat of each worker."""
    return beats.unionByName(new).groupBy("executor_id").agg(F.max("updated_at").alias("updated_at"))


def active_counts(tasks: DataFrame, run: str, node: str = "node") -> DataFrame:
    """(run, what, value, n): a run's tasks that aren't done, by node and by status."""
    live = tasks.where(~F.col("status").isin(*DONE))
    one = lambda c, what: live.groupBy(run, F.lit(what).alias("what"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return one(node, "node").union(one("status", "status"))


def outcome(result: Column, attempts: Column, raised: Column, most: int = 3) -> Column:
    """A task's next status: completed; a failed result retries while attempts are left; an exception or any other result fails."""
    return F.when(raised, "failed").when(result == "completed", "completed").when((result == "failed") & (attempts < most), "retrying").otherwise("failed")


def outcome_error(result: Column, attempts: Column, raised: Column, error: Column, most: int = 3) -> Column:
    """The error kept with it."""
    return F.when(raised | ~result.isin("completed", "failed"), F.coalesce(error, F.lit("Unhandled executor exception"))).when(
        result == "failed", F.coalesce(error, F.when(attempts < most, "Stage failed").otherwise("Stage failed; max attempts reached"))
    )


def stale(heartbeats: DataFrame, now: Column, minutes: float, factor: float = 3.0) -> DataFrame:
    """Workers whose last heartbeat is over factor * minutes old."""
    return heartbeats.where(F.col("updated_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(60 * minutes * factor))))


def sweep(tasks: DataFrame, stale_workers: DataFrame) -> DataFrame:
    """Running tasks of stale workers are scheduled again with one attempt less; other tasks stay as they are."""
    gone = stale_workers.select("executor_id", F.lit(True).alias("_gone")).distinct()
    hit = F.coalesce(F.col("_gone"), F.lit(False)) & (F.col("status") == "running")
    return tasks.join(gone, "executor_id", "left").select(
        *[
            F.when(hit, x).otherwise(F.col(c)).alias(c) if (x := {"status": F.lit("scheduled"), "executor_id": F.lit(None), "attempts": F.greatest(F.lit(0), F.col("attempts") - 1)}.get(c)) is not None else F.col(c)
            for c in tasks.columns
        ]
    )


def _field(name: str):
    return lambda x: x[name]


def fold(events: DataFrame, key: str, seq: str, sets: list[str], adds: list[str], pushes: list[str]) -> DataFrame:
    """A log of partial updates to the present row of each key: last set value, sum of increments, pushed values in order."""
    out = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in sets]
    out += [F.sum(c).alias(c) for c in adds]
    out += [F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(seq, c)))), _field(c)).alias(c) for c in pushes]
    return events.groupBy(key).agg(*out)


def route(done: DataFrame, targets: Column, allowed: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Child tasks of completed ones, and the rows whose target their node doesn't allow.

    ``targets`` is an array of node names.  A child has its parent's run, workflow, url, source,
    document and context, unless the stage gave a context of its own (column new_context).
    """
    plan = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]) if v else F.expr("cast(array() AS array<string>)"))])
    each = done.withColumn("child_node", F.explode(targets)).withColumn("_ok", F.array_contains(F.element_at(plan, F.col("node")), F.col("child_node")))
    kept = [c for c in ("run_id", "workflow_id", "url", "source", "document_id") if c in done.columns]
    context = F.coalesce(F.col("new_context"), F.col("context")) if "new_context" in done.columns else F.col("context")
    child = each.where("_ok").select(F.sha2(F.concat_ws("/", "id", "child_node").cast("binary"), 256).substr(1, 24).alias("id"), F.col("id").alias("parent_id"), F.col("child_node").alias("node"), *kept, context.alias("context"), F.lit("scheduled").alias("status"), F.lit(0).alias("attempts"))
    return child, each.where("NOT coalesce(_ok, false)").drop("_ok")


def progress(tasks: DataFrame, run: str = "run_id", status: str = "status") -> DataFrame:
    """Tasks of each run: all, completed, failed and active ones."""
    s = F.col(status)
    return tasks.groupBy(run).agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin(*DONE)).alias("active"))


def run_status(tasks: DataFrame, run: str = "run_id", status: str = "status", entry: Column | None = None) -> DataFrame:
    """A run waits while a task is active; then it is completed exactly if it has entry tasks and all of them completed."""
    entry = F.col("parent_id").isNull() if entry is None else entry
    s = F.col(status)
    good = (F.count_if(entry) > 0) & (F.count_if(entry & (s != "completed")) == 0)
    return tasks.groupBy(run).agg(F.when(F.count_if(~s.isin(*DONE)) > 0, "waiting").when(good, "completed").otherwise("failed").alias("status"))


def missing_context(required: Column, context: Column) -> Column:
    """Keys a stage needs that a context map lacks."""
    return F.array_except(required, F.coalesce(F.map_keys(context), F.expr("cast(array() AS array<string>)")))
