"""Plans of steps that need each other, all plans at once: the order to run them in, and attempts chained to the ones before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_order(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """plan, step, layer, place: steps of a layer need earlier layers only; within a plan by layer, then by declared position.

    steps: plan, step (once in a plan), position. needs: plan, step, need; a need that is no step of the plan has been met elsewhere and doesn't
    count, a repeated one counts once. A cycle is an error that names some of its steps. A layer of all plans is peeled off by
    two joins, so there are as many rounds as the deepest plan has layers.
    """
    key = ["plan", "step"]
    left = _kept(steps.select(*key, "position"), "steps")
    known = left.select("plan", F.col("step").alias("need"))
    open_ = _kept(needs.select(*key, "need").distinct().join(known, ["plan", "need"], "left_semi").join(left.select(*key), key, "left_semi").select(*key, "need"), "needs")
    done, layer = None, 0
    while not left.isEmpty():
        ready = _kept(left.join(open_.select(*key), key, "left_anti").withColumn("layer", F.lit(layer)), "ready")
        if ready.isEmpty():
            some = ", ".join(f"{r.plan}/{r.step}" for r in left.orderBy(*key).limit(5).collect())
            raise ValueError(f"steps form a cycle: {some}")
        done = ready if done is None else done.unionByName(ready)
        left = _kept(left.join(ready.select(*key), key, "left_anti"), "steps")
        open_ = _kept(open_.join(ready.select("plan", F.col("step").alias("need")), ["plan", "need"], "left_anti").select(*key, "need"), "needs")
        layer += 1
    done = left.withColumn("layer", F.lit(0)) if done is None else done
    place = F.row_number().over(Window.partitionBy("plan").orderBy("layer", "position", "step"))
    return done.select(*key, "layer", place.alias("place"))


def chained_attempts(turns: DataFrame, run: str, agent: str, at: str) -> DataFrame:
    """turns with attempt (from 1), parent_at and final: calls of one agent that follow each other are attempts at one turn.

    The first attempt hangs from the last call of whoever came before, a later one from the attempt before it; the last one is final.
    """
    order = Window.partitionBy(run).orderBy(at)
    rows = turns.withColumn("_new", F.coalesce(F.col(agent) != F.lag(agent).over(order), F.lit(True)))
    rows = rows.withColumn("_turn", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"parent_at": F.lag(at).over(order), "attempt": F.row_number().over(Window.partitionBy(run, "_turn").orderBy(at))})
    return rows.withColumn("final", F.lead("_turn").over(order).isNull() | (F.lead("_turn").over(order) != F.col("_turn"))).drop("_new", "_turn")
