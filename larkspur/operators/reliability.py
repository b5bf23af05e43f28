"""How reliable each of several annotators is, and what the items' labels are most likely."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from larkspur.operators.ordering import top_k
from larkspur.session import saved

#: Added to every count, so that an answer that was never seen is unlikely and not impossible.
SMALL = 0.01


@dataclass
class Reliability:
    """``items`` (item, label, probability), ``annotators`` (annotator, answers, accuracy: the expected share of right answers),
    ``errors`` (annotator, label, answer, rate: how often a label gets an answer), ``rounds`` taken."""

    items: DataFrame
    annotators: DataFrame
    errors: DataFrame
    rounds: int


def reliability(answers: DataFrame, item: str, annotator: str, answer: str, tolerance: float = 1e-7, max_rounds: int = 200, small: float = SMALL) -> Reliability:
    """Labels and error tables by expectation and maximisation (after Dawid and Skene).

    Each item has one unknown label, each annotator a table of how often a label gets each answer. The labels' probabilities
    begin as the shares of the answers; tables and shares are estimated from them and they from these, until no probability of
    a pattern changes by more than ``tolerance``. Rows with a null item, annotator or answer are left out; an answer that is given
    twice counts twice. Labels are the answers there are.

    Items with the same answers of the same annotators are one pattern with a number, so rounds work on the patterns; no list
    of items is made, and a pattern holds no more than one item's answers."""
    told = answers.select(F.col(item).alias("item"), F.col(annotator).alias("who"), F.col(answer).alias("answer")).where("item IS NOT NULL AND who IS NOT NULL AND answer IS NOT NULL")
    each = told.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("who", "answer"))).alias("pattern"))
    each = saved(each.withColumn("key", F.sha2(F.to_json("pattern"), 256)), "patterns")
    counts = each.groupBy("key").agg(F.count("*").alias("n"), F.first("pattern").alias("pattern"))
    rows = saved(counts.select("key", "n", F.inline("pattern")), "answers")
    labels = F.broadcast(saved(rows.select(F.col("answer").alias("label")).distinct(), "labels"))  # the answers there are
    n_labels = labels.count()

    given = rows.groupBy("key", F.col("answer").alias("label")).agg(F.count("*").alias("k"), F.first("n").alias("n"))
    size = rows.groupBy("key").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    start = size.crossJoin(labels).join(given.select("key", "label", "k"), ["key", "label"], "left")
    belief = saved(start.select("key", "n", "label", (F.coalesce("k", F.lit(0)) / F.col("size")).alias("p")), "belief")

    def estimated(belief: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Shares of the labels and (who, label, answer, rate)."""
        shares = belief.groupBy("label").agg(F.sum(F.col("n") * F.col("p")).alias("mass"))
        shares = shares.crossJoin(shares.agg(F.sum("mass").alias("all"))).select("label", ((F.col("mass") + small) / (F.col("all") + small * n_labels)).alias("share"))
        met = rows.select("key", "who", "answer").join(belief, "key")
        cells = met.groupBy("who", "label", "answer").agg(F.sum(F.col("n") * F.col("p")).alias("mass"))
        totals = cells.groupBy("who", "label").agg(F.sum("mass").alias("all"))
        rates = cells.join(totals, ["who", "label"]).select("who", "label", "answer", ((F.col("mass") + small) / (F.col("all") + small * n_labels)).alias("rate"))
        return shares, rates

    for number in range(1, max_rounds + 1):
        shares, rates = estimated(belief)
        logs = rows.select("key", "who", "answer").join(rates, ["who", "answer"]).groupBy("key", "label").agg(F.sum(F.ln("rate")).alias("log"))
        weighted = belief.withColumnRenamed("p", "old").join(logs, ["key", "label"]).join(shares, "label").withColumn("log", F.col("log") + F.ln("share"))
        most = weighted.groupBy("key").agg(F.max("log").alias("most"))
        raised = weighted.join(most, "key").withColumn("e", F.exp(F.col("log") - F.col("most")))
        sums = raised.groupBy("key").agg(F.sum("e").alias("sum"))
        belief = saved(raised.join(sums, "key").select("key", "n", "label", (F.col("e") / F.col("sum")).alias("p"), "old"), "belief")
        change = belief.agg(F.max(F.abs(F.col("p") - F.col("old")))).first()[0] or 0.0
        belief = belief.drop("old")
        if change <= tolerance:
            break
    shares, rates = estimated(belief)
    best = top_k(belief, ["key"], [F.desc(F.round("p", 12)), F.col("label")], 1).select("key", "label", "p")
    items = each.select("item", "key").join(best, "key").select(F.col("item").alias(item), "label", F.col("p").alias("probability"))
    errors = saved(rates, "rates")
    known = rows.select("key", "who", "answer").join(belief, "key")
    right = known.groupBy("who").agg(
        F.sum(F.when(F.col("label") == F.col("answer"), F.col("n") * F.col("p")).otherwise(0.0)).alias("right"), F.sum(F.col("n") * F.col("p")).alias("all"))
    annotators = right.select(F.col("who").alias(annotator), F.round("all").cast("long").alias("answers"), (F.col("right") / F.col("all")).alias("accuracy"))
    return Reliability(items, annotators, errors.withColumnRenamed("who", annotator), number)
