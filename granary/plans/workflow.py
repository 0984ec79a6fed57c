"""Cyclic workflows as super-steps over tables.

A workflow is a set of named nodes; a node has a stage (DataFrame -> DataFrame over the documents of
its tasks) and rules (SQL predicate, targets) that route each completed task.  Every round claims
all eligible tasks, runs each node's stage on its whole claim, writes tasks and documents to the
shared folder and routes the children of what completed.  The driver holds the plan and one count.
Failed rows retry while they have attempts; a rule may lead back to any node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.store import kept
from granary.operators.tasks import eligible, outcome

TASK = "id string, parent_id string, run_id string, node string, document_id string, status string, attempts int, error string"


@dataclass
class Node:
    """stage: adds or changes document columns, and may add stage_status ('completed' or 'failed') and stage_error."""

    name: str
    stage: Callable[[DataFrame], DataFrame]
    rules: list[tuple[str, list[str]]] = field(default_factory=list)
    needs: list[str] = field(default_factory=list)


@dataclass
class Workflow:
    name: str
    nodes: list[Node]
    entries: list[str]

    def __post_init__(self):
        names = [n.name for n in self.nodes]
        if any(not n or "." in n for n in [self.name, *names]):
            raise ValueError("names must not be empty or hold dots")
        if len(set(names)) != len(names):
            raise ValueError("node names must be unique")
        if not self.entries or not set(self.entries) <= set(names):
            raise ValueError("entries must be nodes")
        for n in self.nodes:
            if any(not set(t) <= set(names) for _, t in n.rules):
                raise ValueError(f"{n.name} routes to an unknown node")


def submit(flow: Workflow, docs: DataFrame, context: dict | None = None) -> DataFrame:
    """A scheduled task for each document and entry; ValueError names all context keys that stages need and that are missing."""
    missing = sorted({k for n in flow.nodes for k in n.needs} - set(context or {}))
    if missing:
        raise ValueError(f"missing context: {', '.join(missing)}")
    each = docs.select("document_id", F.explode(F.array(*[F.lit(e) for e in flow.entries])).alias("node"))
    return each.select(F.sha2(F.concat_ws("/", F.lit(flow.name), "document_id", "node").cast("binary"), 256).substr(1, 24).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.concat_ws("/", F.lit(flow.name), "document_id").alias("run_id"), "node", "document_id", F.lit("scheduled").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))


def run(flow: Workflow, tasks: DataFrame, docs: DataFrame, most: int = 3, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """Rounds until no task is left to claim: (tasks, documents), both read from the shared folder."""
    tasks, docs = kept(tasks), kept(docs)
    for _ in range(rounds):
        ready = tasks.where(eligible(F.col("status"), F.col("attempts"), most))
        if ready.isEmpty():
            return tasks, docs
        claimed = kept(ready.withColumn("attempts", F.col("attempts") + 1))
        done, changed = None, docs
        for node in flow.nodes:  # in order: two tasks of a round on one document see each other's changes
            mine = claimed.where(F.col("node") == node.name)
            here = changed.join(mine.select("document_id").distinct(), "document_id", "left_semi")
            out = node.stage(here)
            for c, kind in (("stage_status", F.lit("completed")), ("stage_error", F.lit(None).cast("string"))):
                if c not in out.columns:
                    out = out.withColumn(c, kind)
            routes = F.array(*[F.struct(F.expr(p).alias("hit"), F.array(*[F.lit(t) for t in ts]).alias("to")) for p, ts in node.rules]) if node.rules else None
            hits = F.flatten(F.transform(F.filter(routes, lambda x: x["hit"]), lambda x: x["to"])) if node.rules else F.expr("cast(array() AS array<string>)")
            out = kept(out.withColumn("_to", hits))
            status = outcome(F.col("stage_status"), F.col("attempts"), F.lit(False), most)
            part = mine.join(out.select("document_id", "stage_status", "stage_error", "_to"), "document_id").withColumn("status", status).withColumn("error", F.when(F.col("status") != "completed", F.coalesce("stage_error", F.lit("Stage failed"))))
            done = part if done is None else done.unionByName(part)
            changed = changed.join(out.select("document_id"), "document_id", "left_anti").unionByName(out.select(*docs.columns))
        done = kept(done)
        child = done.where("status = 'completed'").select(F.explode("_to").alias("child"), "id", "run_id", "document_id")
        child = child.select(F.sha2(F.concat_ws("/", "id", "child").cast("binary"), 256).substr(1, 24).alias("id"), F.col("id").alias("parent_id"), "run_id", F.col("child").alias("node"), "document_id", F.lit("scheduled").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
        names = [x.split()[0] for x in TASK.split(", ")]
        tasks = kept(tasks.join(claimed.select("id"), "id", "left_anti").select(*names).unionByName(done.select(*names)).unionByName(child.select(*names)))
        docs = kept(changed)
    raise RuntimeError(f"tasks left after {rounds} rounds")


def pipeline(docs: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], results: DataFrame | None = None) -> DataFrame:
    """An ordered list of stages over documents, idempotent for each: (document_id, step, seq, status, error).

    A stage maps documents to (document_id, status, error).  Steps whose latest result is completed
    are skipped for that document; a failed step doesn't stop the ones after it; a result equal to
    the latest isn't recorded again.
    """
    schema = "document_id string, step string, seq int, status string, error string"
    results = kept(docs.sparkSession.createDataFrame([], schema) if results is None else results)
    for name, stage in steps:
        last = results.where(F.col("step") == name).groupBy("document_id").agg(F.max_by(F.struct("status", "error"), "seq").alias("l"), F.max("seq").alias("n"))
        todo = docs.join(last.where("l.status = 'completed'"), "document_id", "left_anti")
        got = stage(todo).join(last, "document_id", "left")
        new = got.where(~(F.col("status").eqNullSafe(F.col("l.status")) & F.col("error").eqNullSafe(F.col("l.error"))))
        results = kept(results.unionByName(new.select("document_id", F.lit(name).alias("step"), (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("seq"), "status", "error")))
    return results


def cascade(edges: DataFrame, pending: DataFrame, start: DataFrame) -> DataFrame:
    """(document_id, pipeline) still to run among what the started documents lead to; each document is visited once, cycles end."""
    from granary.operators.graph import reachable

    seen = reachable(edges, start.select(F.col("document_id").alias("seed"))).select(F.col("node").alias("document_id")).distinct()
    return pending.where("status != 'completed'").join(seen, "document_id", "left_semi").select("document_id", "pipeline")
