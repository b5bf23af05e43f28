"""Paths that sessions take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.ordering import running_sum
from larkspur.session import saved

#: Steps whose names are joined together.
PIECE = 1024


def session_paths(
    steps: DataFrame, session: Sequence[str], order: Sequence[str], step: str, goal: str, block: Column, piece: int = PIECE, sep: str = " > ",
) -> DataFrame:
    """The paths of whole sessions up to the goal: path, n_steps, n (sessions that took it), n_goal (those that then reached the
    goal), success_rate.

    The path of a session is all its steps in order before the first ``goal``, or all of them if that is never reached; a session
    that begins with the goal has the empty path. Null steps are steps called ``null``; null session keys are a session too. ``block``
    must not decrease along ``order``.

    A path is known by its length and 128 bits over places and names of its steps, which add up in any order, so no session
    is ever gathered. Only one session of each path has its names joined, in pieces of ``piece`` steps that are joined in turn."""
    named = steps.select(F.struct(*session).alias("session"), *order, F.coalesce(F.col(step).cast("string"), F.lit("null")).alias("step"), block.alias("block"))
    placed = saved(running_sum(named, ["session"], order, F.lit(1), "pos", F.col("block"), inclusive=False).select("session", "pos", "step"), "steps")
    reached = placed.groupBy("session").agg(F.min(F.when(F.col("step") == goal, F.col("pos"))).alias("goal_at"), F.count("*").alias("n_all"))
    reached = saved(reached, "goals")
    taken = placed.join(reached.where("goal_at IS NOT NULL"), placed["session"].eqNullSafe(reached["session"]), "left").select(
        placed["session"], "pos", "step", "goal_at").where("goal_at IS NULL OR pos < goal_at")
    keys = [F.bit_xor(F.xxhash64(F.lit(k), "pos", "step")).alias(f"k{k}") for k in (1, 2)]
    walked = taken.groupBy("session").agg(*keys)
    known = reached.join(walked, reached["session"].eqNullSafe(walked["session"]), "left").select(
        reached["session"], F.coalesce("goal_at", "n_all").alias("n_steps"), F.col("goal_at").isNotNull().alias("won"),
        F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2"))
    paths = known.groupBy("n_steps", "k1", "k2").agg(F.count("*").alias("n"), F.count_if("won").alias("n_goal"), F.min("session").alias("example"))
    paths = saved(paths, "paths")
    example = paths.select(F.col("example").alias("session"), "n_steps")
    spelled = placed.join(example, placed["session"].eqNullSafe(example["session"])).where("pos < n_steps").select(
        placed["session"], F.expr(f"pos div {piece}").alias("piece"), "pos", "step")
    pieces = spelled.groupBy("session", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "step"))), lambda x: x["step"]), sep).alias("names"))
    whole = pieces.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "names"))), lambda x: x["names"]), sep).alias("path"))
    told = paths.join(whole, paths["example"].eqNullSafe(whole["session"]), "left")
    return told.select(F.coalesce("path", F.lit("")).alias("path"), "n_steps", "n", "n_goal", (F.col("n_goal") / F.col("n")).alias("success_rate"))
