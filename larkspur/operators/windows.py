"""Series and sequence operators: indexing, context totals, entity spans, prefixes, paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.ordering import computed_once, first_value, join_group_stats, next_values, running_sum, seeded_rank


def sort_by_group_max(df: DataFrame, group: str, value: str, *ties: str) -> DataFrame:
    """Order rows by the largest value of their group, descending. The maximum is a combined
    aggregate joined back, so a hot group is never gathered for a window."""
    largest = df.groupBy(group).agg(F.max(value).alias("group_max"), F.count("*").alias("_rows"))
    rows = join_group_stats(df, largest, [group], "_rows", ties).drop("_rows")
    return rows.orderBy(F.desc("group_max"), group, *ties)


def index_to_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Value relative to the first value of its series; null when that is zero."""
    return first_value(df, keys, order, value, "_first", order).withColumn(out, F.try_divide(value, "_first")).drop("_first")


def context_before(turns: DataFrame, conversation: str, turn: str, tokens: str, out: str, block_turns: int = 1024) -> DataFrame:
    """Tokens of all earlier turns of the conversation, the part a prompt cache can serve."""
    block = F.floor(F.col(turn) / block_turns)
    return running_sum(turns, [conversation], [turn], F.col(tokens), out, block, inclusive=False)


def iob_spans(tokens: DataFrame, doc: str, pos: str, token: str, tag: str, block_tokens: int = 4096) -> DataFrame:
    """Entity spans from B-/I-/O tags. Every token that is not I- starts an island; islands whose
    first tag is B- are entities, islands that start with O are dropped, stray I- tokens with them."""
    starts = F.when(F.startswith(tag, F.lit("I-")), 0).otherwise(1)
    block = F.floor(F.col(pos) / block_tokens)
    islands = running_sum(tokens, [doc], [pos], starts, "_island", block)
    inside = islands.where(F.col(tag) != "O")
    first = F.struct(pos, tag)
    return (
        inside.groupBy(doc, "_island")
        .agg(F.min(first).alias("_f"), F.array_sort(F.collect_list(F.struct(pos, token))).alias("_t"))
        .where(F.startswith(F.col("_f")[tag], F.lit("B-")))
        .select(
            doc, F.col("_f")[pos].alias("start"), F.substring(F.col("_f")[tag], 3, 100).alias("label"),
            F.array_join(F.col("_t")[token], " ").alias("entity"),
        )
    )


def iob_spans_of_lists(df: DataFrame, doc: str, tokens: str, tags: str) -> DataFrame:
    """What :func:`iob_spans` finds, for texts that are a row each with all their tokens and tags as lists: a span is cut out of its
    row, and nothing is shuffled."""
    places = F.when(F.size(tags) > 0, F.sequence(F.lit(0), F.size(tags) - 1))
    starts = F.filter(places, lambda i: ~F.startswith(F.get(tags, i), F.lit("I-")))
    rows = computed_once(df.select(doc, tokens, tags), _starts=starts)

    def ends(start: Column, i: Column) -> Column:
        return F.struct(start.alias("start"), F.coalesce(F.get("_starts", i + 1), F.size(tags)).alias("end"))

    spans = F.filter(F.transform("_starts", ends), lambda s: F.startswith(F.get(tags, s["start"]), F.lit("B-")))
    found = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.substring(F.get(tags, s["start"]), 3, 100).alias("label"),
        F.array_join(F.slice(tokens, s["start"] + 1, s["end"] - s["start"]), " ").alias("entity")))
    return rows.select(doc, F.inline(found))


def learning_prefixes(df: DataFrame, id_col: str, seed: str, fractions: Sequence[float]) -> DataFrame:
    """Nested prefixes of a seeded shuffle: each row once per fraction it belongs to."""
    ranked = seeded_rank(df, id_col, seed, out="_rn", total="_total")
    inside = F.filter(F.array(*[F.lit(f) for f in fractions]), lambda f: F.col("_rn") <= F.floor(f * F.col("_total")))
    return ranked.withColumn("fraction", F.explode(inside)).drop("_rn", "_total")


def step_paths(
    steps: DataFrame, session: Sequence[str], order: Sequence[str], step: str, goal: str, length: int, block: Column,
) -> DataFrame:
    """Frequency of every path of ``length`` consecutive steps within a session, and how often the
    step right after it is ``goal``; a session of fewer steps is one path. Sessions are cut into blocks, so none is gathered whole."""
    placed = running_sum(steps.withColumn("_at", block), session, order, F.lit(1), "_pos", F.col("_at"), inclusive=False, total="_all")
    rows = next_values(placed, session, order, F.col(step), [f"_s{k}" for k in range(1, length + 1)], F.col("_at"))
    parts = [F.col(step), *[F.col(f"_s{k}") for k in range(1, length)]]
    return (
        rows.where(F.col("_pos") <= F.greatest(F.col("_all") - length, F.lit(0)))
        .groupBy(F.concat_ws(" > ", *parts).alias("path"))
        .agg(F.count("*").alias("n"), F.count_if(F.col(f"_s{length}") == goal).alias("n_goal"))
        .withColumn("success_rate", F.col("n_goal") / F.col("n"))
    )
