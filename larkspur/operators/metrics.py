"""Evaluation measures: sets, binary predictions, repeated runs, annotators, tournaments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.scalar import ratio
from larkspur.session import saved


def set_counts(gold: Column, predicted: Column, normalise: Callable[[Column], Column] = F.lower) -> dict[str, Column]:
    """tp, fp, fn of two arrays compared as sets after ``normalise``."""
    g = F.array_distinct(F.transform(gold, normalise))
    p = F.array_distinct(F.transform(predicted, normalise))
    return {
        "tp": F.size(F.array_intersect(g, p)),
        "fp": F.size(F.array_except(p, g)),
        "fn": F.size(F.array_except(g, p)),
    }


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return ratio(2 * precision * recall, precision + recall)


def set_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of one example; an empty prediction for an empty gold set is a hit."""
    return F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(f1(tp, fp, fn))


def micro_precision_recall(df: DataFrame) -> DataFrame:
    """Counts are summed over examples before dividing."""
    s = df.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def binary_metrics(df: DataFrame, label: str, probability: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and log loss (p clipped to [1e-15, 1 - 1e-15]) in one pass."""
    hit, said = F.col(label) == 1, F.col(probability) >= threshold
    p = F.least(F.greatest(F.col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"),
        F.avg(-F.ln(F.when(hit, p).otherwise(1 - p))).alias("log_loss"),
    )
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return counts.select(
        *by, "n", ratio(n - fp - fn, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"), "log_loss",
    )


def throughput(df: DataFrame, run: str, ts: str) -> DataFrame:
    """Items, duration in seconds and items per second of each run."""
    spans = df.groupBy(run).agg(
        F.count("*").alias("items"),
        (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))).alias("us"),
    )
    seconds = F.col("us") / 1e6
    return spans.select(run, "items", seconds.alias("seconds"), ratio(F.col("items"), seconds).alias("per_second"))


def pass_at_k(runs: DataFrame, task: str, passed: Column) -> DataFrame:
    """Over all runs of a task: any passes (pass@k), all pass (pass^k), most pass (majority@k); each
    averaged over tasks."""
    tasks = runs.groupBy(task).agg(
        F.bool_or(passed).alias("any"), F.bool_and(passed).alias("every"),
        (F.avg(passed.cast("int")) > 0.5).alias("most"), F.count("*").alias("k"),
    )
    share = {"any": "pass_at_k", "every": "pass_hat_k", "most": "majority_at_k"}
    return tasks.agg(
        F.count("*").alias("tasks"), F.sum("k").alias("runs"),
        *[F.avg(F.col(c).cast("int")).alias(name) for c, name in share.items()],
    )


def majority_vote(votes: DataFrame, item: str, answer: str) -> DataFrame:
    """Most frequent answer per item, smallest answer on a tie."""
    counts = votes.groupBy(item, answer).agg(F.count("*").alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("v"), F.col(answer).alias("a")))
    return counts.groupBy(item).agg(best.alias("b")).select(item, F.col("b.a").alias(answer), (-F.col("b.v")).alias("votes"))


def annotator_agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """Observed agreement, chance agreement and Cohen's kappa from the confusion counts."""
    cells = df.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n")).scalar()
    rows = cells.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("ra"))
    cols = cells.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, "c").agg(F.try_divide(F.sum(F.col("ra").cast("double") * F.col("rb")), total.cast("double") * total)).scalar()
    observed = F.try_divide(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)), F.sum("n"))
    s = cells.agg(F.sum("n").alias("n"), observed.alias("observed")).withColumn("expected", chance)
    kappa = ratio(F.col("observed") - F.col("expected"), 1 - F.col("expected"))
    return s.withColumn("kappa", kappa)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class, and how many times larger the largest class is than this one."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total, largest = counts.agg(F.sum("n")).scalar(), counts.agg(F.max("n")).scalar()
    return counts.select(label, "n", (F.col("n") / total).alias("share"), (largest / F.col("n")).alias("imbalance"))


def pairwise_wins(matches: DataFrame) -> DataFrame:
    """From matches (competitor_1, competitor_2, attribute, preferred 1 or 2): wins and matches per
    competitor and attribute, and its win rate when it stood first."""
    counts = matches.groupBy("competitor_1", "competitor_2", "attribute").agg(
        F.count_if(F.col("preferred") == 1).alias("w1"), F.count("*").alias("n")
    )
    sides = F.array(
        F.struct(F.col("competitor_1").alias("competitor"), F.col("w1").alias("wins"), "n",
                 F.col("w1").alias("first_wins"), F.col("n").alias("first_n")),
        F.struct(F.col("competitor_2").alias("competitor"), (F.col("n") - F.col("w1")).alias("wins"), "n",
                 F.lit(0).cast("long").alias("first_wins"), F.lit(0).cast("long").alias("first_n")),
    )
    return (
        counts.select("attribute", F.inline(sides))
        .groupBy("competitor", "attribute")
        .agg(
            F.sum("wins").alias("wins"), F.sum("n").alias("matches"),
            ratio(F.sum("first_wins"), F.sum("first_n")).alias("first_win_rate"),
        )
    )


def components(pairs: DataFrame) -> DataFrame:
    """(i, component): the smallest competitor that each one is tied to by pairs (i, j), both ways. Rounds take the smallest
    name among the neighbours and then the name of that name, so long chains take few rounds."""
    name = saved(pairs.groupBy("i").agg(F.least(F.min("j"), F.col("i")).alias("component")), "components")
    while True:
        seen = pairs.join(name.select(F.col("i").alias("j"), "component"), "j").groupBy("i").agg(F.min("component").alias("seen"))
        lower = name.join(seen, "i").select("i", "component", F.least("component", "seen").alias("next"))
        of = name.select(F.col("i").alias("next"), F.col("component").alias("further"))
        found = saved(lower.join(of, "next", "left").select("i", "component", F.least("next", "further").alias("next")), "components")
        name = found.select("i", F.col("next").alias("component"))
        if found.where("next <> component").isEmpty():
            return name


def bradley_terry(matches: DataFrame, tolerance: float = 1e-10, max_steps: int = 500, steps: int = 5) -> DataFrame:
    """Strengths r with P(i beats j) = r_i / (r_i + r_j): competitor, wins, matches, component, strength, log_error.

    Minorise-maximise steps r_i = wins_i / sum_j n_ij / (r_i + r_j) go on until the mean log-likelihood of a match changes by no
    more than ``tolerance`` in ``steps`` steps. Competitors that are tied by no chain of matches cannot be compared: strengths have
    the mean 1 in each component. log_error is the standard error of ln(strength) with the others held fixed; it is null, as
    there is none, without a win or without a loss. Competitors without a win have strength 0; one without a loss has no
    largest likelihood, its strength is what the last step gave.

    Matches are reduced to one row per ordered pair before the first step. The strengths are written every ``steps`` steps,
    which cuts the lineage and survives lost executors."""
    both = F.array(
        F.struct(F.col("competitor_1").alias("i"), F.col("competitor_2").alias("j"), F.col("w1").alias("w"), "n"),
        F.struct(F.col("competitor_2").alias("i"), F.col("competitor_1").alias("j"), (F.col("n") - F.col("w1")).alias("w"), "n"),
    )
    pairs = (
        matches.groupBy("competitor_1", "competitor_2")
        .agg(F.count_if(F.col("preferred") == 1).alias("w1"), F.count("*").alias("n"))
        .select(F.inline(both))
        .groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    )
    pairs = saved(pairs, "pairs")
    wins = saved(pairs.groupBy("i").agg(F.sum("w").alias("wins"), F.sum("n").alias("matches")).join(components(pairs), "i"), "wins")

    def beside(strength: DataFrame) -> DataFrame:
        """The pairs with both strengths."""
        return pairs.join(strength.select("i", "r"), "i").join(strength.select(F.col("i").alias("j"), F.col("r").alias("rj")), "j")

    strength, before = saved(wins.select("i", F.lit(1.0).alias("r")), "strengths"), None
    for _ in range(-(-max_steps // steps)):
        for _ in range(steps):
            shared = beside(strength).groupBy("i").agg(F.sum(F.try_divide("n", F.col("r") + F.col("rj"))).alias("shared"))
            strength = wins.join(shared, "i").select("i", F.coalesce(F.try_divide("wins", "shared"), F.lit(0.0)).alias("r"))
        strength = saved(strength, "strengths")
        chance = F.when(F.col("w") > 0, F.col("w") * F.ln(F.col("r") / (F.col("r") + F.col("rj")))).otherwise(F.lit(0.0))
        likelihood = beside(strength).agg(F.try_divide(F.sum(chance), F.sum("w"))).first()[0] or 0.0
        if before is not None and abs(likelihood - before) <= tolerance:
            break
        before = likelihood
    r, rj = F.col("r"), F.col("rj")
    known = beside(strength).groupBy("i").agg(F.sum(F.try_divide(F.col("n") * r * rj, (r + rj) * (r + rj))).alias("information"))
    means = wins.join(strength, "i").groupBy("component").agg(F.avg("r").alias("mean"))
    error = F.when((F.col("wins") > 0) & (F.col("wins") < F.col("matches")), F.try_divide(F.lit(1.0), F.sqrt("information")))
    return wins.join(strength, "i").join(known, "i").join(means, "component").select(
        F.col("i").alias("competitor"), "wins", "matches", "component", F.try_divide("r", "mean").alias("strength"), error.alias("log_error"))
