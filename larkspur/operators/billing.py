"""Token accounting and prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.ordering import running_sum


@dataclass(frozen=True)
class Price:
    """US dollars per million tokens."""

    # A published price list.
    fresh: float = 5.0
    cached: float = 0.5
    output: float = 30.0

    def cost(self, fresh: Column, cached: Column, output: Column) -> Column:
        return (fresh * F.lit(self.fresh) + cached * F.lit(self.cached) + output * F.lit(self.output)) / F.lit(1e6)


def chat_calls(turns: DataFrame, conversation: str, turn: str, role: str, tokens: str, block_turns: int = 1024) -> DataFrame:
    """One row per model call: fresh input (everything since the last answer), output (the answer) and
    cached input (all earlier calls). Trailing turns without an answer are no call."""
    answer = F.col(role) == "assistant"
    block = F.floor(F.col(turn) / block_turns)
    numbered = running_sum(turns, [conversation], [turn], answer.cast("long"), "call", block, inclusive=False)
    calls = (
        numbered.groupBy(conversation, "call")
        .agg(
            F.sum(F.when(answer, 0).otherwise(F.col(tokens))).alias("fresh"),
            F.sum(F.when(answer, F.col(tokens)).otherwise(0)).alias("output"),
            F.bool_or(answer).alias("_answered"),
        )
        .where("_answered").drop("_answered")
    )
    call_block = F.floor(F.col("call") / block_turns)
    return running_sum(
        calls, [conversation], ["call"], F.col("fresh") + F.col("output"), "cached", call_block, inclusive=False
    )


def chat_billing(calls: DataFrame, price: Price = Price()) -> DataFrame:
    return calls.withColumn("cost", price.cost(F.col("fresh"), F.col("cached"), F.col("output")))


def one_call_comparison(calls: DataFrame, conversation: str, price: Price = Price()) -> DataFrame:
    """Cost of the chat as held, of the same chat without a cache, and of asking all in one call."""
    fresh, cached, output = F.col("fresh"), F.col("cached"), F.col("output")
    sums = calls.groupBy(conversation).agg(
        F.count("*").alias("calls"), F.sum(fresh).alias("fresh"), F.sum(cached).alias("cached"), F.sum(output).alias("output")
    )
    none = F.lit(0)
    return sums.select(
        conversation, "calls",
        price.cost(fresh, cached, output).alias("cost"),
        price.cost(fresh + cached, none, output).alias("cost_uncached"),
        price.cost(fresh, none, output).alias("cost_one_call"),
    )


def blended_price(price: Price, cache: float = 7, fresh: float = 2, output: float = 1) -> float:
    """Price per million tokens at a cache : input : output mix."""
    return (cache * price.cached + fresh * price.fresh + output * price.output) / (cache + fresh + output)


# Both prices and the threshold of a published price list.
def tiered_cost(
    fresh: Column, output: Column, low: Price = Price(5.0, 0.5, 30.0), high: Price = Price(10.0, 1.0, 45.0),
    threshold: int = 272_000, batch: bool = False,
) -> Column:
    """The whole request moves to the high price once its input passes the threshold; batch halves it."""
    none = F.lit(0)
    cost = F.when(fresh > threshold, high.cost(fresh, none, output)).otherwise(low.cost(fresh, none, output))
    return cost * 0.5 if batch else cost


def break_even_reads(regular: Column, write: Column, read: Column, storage: Column) -> Column:
    """Cache reads after which writing (and storing) once plus cheap reads costs no more than sending
    the prefix at the regular price each time."""
    return F.greatest(F.ceil(F.round(F.try_divide(write + storage - regular, regular - read), 9)), F.lit(0)).cast("long")


def cache_savings(requests: DataFrame, text: str, tokens: Column, usd_per_million: float) -> DataFrame:
    """Requests, repeats, their share, and what answering repeats from a store would save."""
    groups = requests.groupBy(F.sha2(text, 256).alias("_h")).agg(
        F.count("*").alias("_n"), F.max(tokens).alias("_tok")
    )
    repeats = F.col("_n") - 1
    return groups.agg(
        F.sum("_n").alias("requests"), F.sum(repeats).alias("repeats"),
        F.try_divide(F.sum(repeats), F.sum("_n")).alias("repeat_share"),
        (F.sum(repeats * F.col("_tok")) * usd_per_million / 1e6).alias("saved"),
    )
