"""Labelled examples: sampling, splitting, noise, demos, preference pairs, review queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.scalar import seeded_hash
from larkspur.operators.ordering import seeded_rank, top_k


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("_n"))


def stratified_subsample(df: DataFrame, label: str, id_col: str, max_size: int, seed: str, n_classes: int = 2) -> DataFrame:
    """max_size // n_classes random rows of each class; a smaller class is taken whole."""
    ranked = seeded_rank(df, id_col, seed, [label], "_rn")
    return ranked.where(F.col("_rn") <= max_size // n_classes).drop("_rn")


def balance_classes(df: DataFrame, label: str, id_col: str, seed: str) -> DataFrame:
    """Undersample every class to the size of the smallest."""
    smallest = class_sizes(df, label).agg(F.min("_n")).scalar()
    return seeded_rank(df, id_col, seed, [label], "_rn").where(F.col("_rn") <= smallest).drop("_rn")


def stratified_split(
    df: DataFrame, label: str, id_col: str, seed: str, train: float = 0.6, test: float = 0.2,
) -> DataFrame:
    """Per class: floor(train * n) rows train, floor(test * n) rows test, the rest valid."""
    ranked = seeded_rank(df, id_col, seed, [label], "_rn", total="_n")
    n_train, n_test = F.floor(F.lit(train) * F.col("_n")), F.floor(F.lit(test) * F.col("_n"))
    split = (
        F.when(F.col("_rn") <= n_train, "train").when(F.col("_rn") <= n_train + n_test, "test").otherwise("valid")
    )
    return ranked.withColumn("split", split).drop("_rn", "_n")


def label_noise(df: DataFrame, label: str, id_col: str, noise: float, seed: str) -> DataFrame:
    """Flip floor(n * noise) // 2 random labels in each of two classes."""
    total = df.agg(F.count("*")).scalar()
    ranked = seeded_rank(df, id_col, seed, [label], "_rn").withColumn("_total", total)
    flips = F.floor(F.floor(F.col("_total") * F.lit(noise)) / 2)
    flipped = F.col("_rn") <= flips
    return (
        ranked.withColumns({"flipped": flipped, "noisy": F.when(flipped, 1 - F.col(label)).otherwise(F.col(label))})
        .drop("_rn", "_total")
    )


def noise_size_grid(
    df: DataFrame, label: str, id_col: str, sizes: Sequence[int], noises: Sequence[float], seed: str,
) -> DataFrame:
    """Every (size, noise) cell of subsample and label flips in one job: a row is ranked once and
    copied to the cells it belongs to, instead of one run per cell."""
    sized = class_sizes(df, label)
    totals = {s: f"_t{s}" for s in sizes}
    cell_totals = sized.agg(*[F.sum(F.least(F.col("_n"), F.lit(s // 2))).alias(c) for s, c in totals.items()])
    per_size = cell_totals.select(F.struct(*totals.values()).alias("t")).scalar()
    ranked = seeded_rank(df, id_col, seed, [label], "_rn").withColumn("_t", per_size)
    cells = F.array(*[
        F.struct(
            F.lit(s).alias("size"), F.lit(float(z)).alias("noise"),
            F.floor(F.floor(F.col("_t")[totals[s]] * F.lit(float(z))) / 2).alias("flips"),
        )
        for s in sizes for z in noises
    ])
    chosen = F.filter(cells, lambda c: F.col("_rn") <= F.floor(c["size"] / 2))
    rows = ranked.withColumn("_c", F.explode(chosen))
    flipped = F.col("_rn") <= F.col("_c.flips")
    return rows.select(
        *df.columns, F.col("_c.size").alias("size"), F.col("_c.noise").alias("noise"), flipped.alias("flipped"),
        F.when(flipped, 1 - F.col(label)).otherwise(F.col(label)).alias("noisy"),
    )


def to_chat(text: Column, label: Column) -> Column:
    """{"dialogue": [{"from": "human", ...}, {"from": "gpt", ...}]} as JSON text."""
    def say(who: str, what: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), what.alias("value"))

    return F.to_json(F.struct(F.array(say("human", text), say("gpt", label.cast("string"))).alias("dialogue")))


def from_chat(chat: Column) -> Column:
    """Dialogue JSON to [{role, content}]."""
    turns = F.from_json(chat, "dialogue ARRAY<STRUCT<from: STRING, value: STRING>>")["dialogue"]
    role = lambda t: F.when(t["from"] == "human", "user").when(t["from"] == "gpt", "assistant").otherwise(t["from"])
    return F.transform(turns, lambda t: F.struct(role(t).alias("role"), t["value"].alias("content")))


def few_shot_prompts(
    examples: DataFrame, pool: DataFrame, id_col: str, text: str, label: str, k: int, seed: str, max_classes: int = 100,
) -> DataFrame:
    """Up to k seeded demos per class of ``pool``, put before every example. The demos are a scalar
    subquery of at most k rows per class; the number of classes is checked."""
    if pool.select(label).distinct().limit(max_classes + 2).count() > max_classes + 1:
        raise ValueError(f"more than {max_classes} classes; a prompt cannot hold demos of each")
    order = [seeded_hash(seed, id_col), F.col(id_col)]
    demos = top_k(pool.where(F.col(label).isNotNull()), [label], order, k, "_rn")
    shot = F.concat(F.lit("Text: "), F.col(text), F.lit("\nLabel: "), F.col(label).cast("string"), F.lit("\n\n"))
    block = demos.agg(F.array_sort(F.collect_list(F.struct(label, "_rn", shot.alias("shot")))).alias("d")).select(
        F.array_join(F.col("d")["shot"], "")
    )
    return examples.withColumn("prompt", F.concat(block.scalar(), F.lit("Text: "), F.col(text), F.lit("\nLabel:")))


def preference_pairs(answers: DataFrame, prompt_id: str, answer_id: str, score: str) -> DataFrame:
    """Best against worst rated answer per prompt; prompts whose answers all score alike give none.
    Both come from one combined aggregate, so no list of all pairs exists."""
    best = F.max_by(answer_id, F.struct(F.col(score), -F.col(answer_id)))
    worst = F.min_by(answer_id, F.struct(F.col(score), F.col(answer_id)))
    return (
        answers.groupBy(prompt_id)
        .agg(best.alias("preferred"), worst.alias("rejected"), F.max(score).alias("_hi"), F.min(score).alias("_lo"))
        .where(F.col("_hi") > F.col("_lo"))
        .drop("_hi", "_lo")
    )


def binary_entropy(p: Column) -> Column:
    """Entropy in bits of a two-class prediction; 0 at p = 0 and p = 1."""
    def part(q: Column) -> Column:
        return F.when(q > 0, -q * F.log2(q)).otherwise(F.lit(0.0))

    return part(p) + part(1 - p)


def uncertainty_queue(df: DataFrame, id_col: str, probability: str, n: int) -> DataFrame:
    """The n predictions nearest to 0.5, by entropy and then margin."""
    scored = df.withColumns({
        "entropy": binary_entropy(F.col(probability)), "margin": F.abs(2 * F.col(probability) - 1),
    })
    return scored.orderBy("margin", id_col).limit(n)


def suspect_labels(df: DataFrame, id_col: str, label: str, probability: str) -> DataFrame:
    """Examples whose prediction contradicts the label, most confident first."""
    predicted = (F.col(probability) >= 0.5).cast("int")
    confidence = F.greatest(F.col(probability), 1 - F.col(probability))
    return (
        df.withColumns({"predicted": predicted, "confidence": confidence})
        .where(F.col("predicted") != F.col(label))
        .orderBy(F.desc("confidence"), id_col)
    )
