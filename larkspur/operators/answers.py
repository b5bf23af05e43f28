"""Structured model answers: parse, validate, repair, report, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.ordering import computed_once, top_k

# The labels an answer may use.
TOPICS = ["ARTS", "BUSINESS", "ENTERTAINMENT", "HEALTH", "POLITICS", "SCIENCE", "SPORTS", "TECHNOLOGY"]
SENTIMENTS = ["POSITIVE", "NEGATIVE", "NEUTRAL"]
ENTITY_LABELS = ["PERSON", "ORG", "PRODUCT", "LOCATION", "EVENT"]


def _all(items: Column, test) -> Column:
    return F.coalesce(F.forall(items, test), F.lit(False))


def is_valid() -> Column:
    """Schema check on the columns made by ``parse_answers``."""
    return (
        ~F.col("parse_error")
        & _all(F.col("topics"), lambda x: F.coalesce(x.isin(TOPICS), F.lit(False)))
        & F.coalesce(F.col("sentiment").isin(SENTIMENTS), F.lit(False))
        & _all(
            F.col("entities"),
            lambda e: e["text"].isNotNull() & F.coalesce(e["label"].isin(ENTITY_LABELS), F.lit(False)),
        )
    )


def parse_answers(df: DataFrame, answer: str) -> DataFrame:
    """Adds parse_error, topics, sentiment, entities and validation_error. A field of the wrong type
    is null, which fails validation; text that is no JSON is a parse error and not a validation error."""
    v = F.try_parse_json(F.col(answer))
    fields = computed_once(
        df.withColumn("_v", v),
        parse_error=F.col("_v").isNull(),
        topics=F.try_variant_get("_v", "$.topics", "array<string>"),
        sentiment=F.try_variant_get("_v", "$.sentiment", "string"),
        entities=F.try_variant_get("_v", "$.named_entities", "array<struct<text:string,label:string>>"),
    ).drop("_v")
    return fields.withColumn("validation_error", ~F.col("parse_error") & ~is_valid())


def repair_answers(parsed: DataFrame) -> DataFrame:
    """Drop topics and entities outside the allowed labels, then validate again."""
    fixed = parsed.withColumns({
        "topics": F.filter("topics", lambda x: x.isin(TOPICS)),
        "entities": F.filter("entities", lambda e: e["label"].isin(ENTITY_LABELS)),
    })
    return fixed.withColumn("validation_error", ~F.col("parse_error") & ~is_valid())


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) rows; together they are all rows."""
    bad = F.col("parse_error") | F.col("validation_error")
    return parsed.where(~bad), parsed.where(bad)


def coerce_int(raw: Column) -> Column:
    """Unparsable predictions become 0."""
    return F.coalesce(raw.try_cast("int"), F.lit(0))


def polarity_report(df: DataFrame, aspect: str, polarity: str) -> DataFrame:
    """Counts per aspect and polarity, side by side, with the positive share."""
    counts = df.groupBy(aspect).agg(
        F.count("*").alias("mentions"), *[F.count_if(F.col(polarity) == s).alias(s.lower()) for s in SENTIMENTS]
    )
    return counts.withColumn("positive_share", F.col("positive") / F.col("mentions"))


def entity_counts(parsed: DataFrame, k: int = 5) -> DataFrame:
    """How often each entity (text, label) is named, the ``k`` most frequent of each label with their rank; equal counts
    in the order of their texts. Counts are made before the ranking, so a frequent entity is one row."""
    named = parsed.select(F.explode("entities").alias("e")).select("e.text", "e.label")
    counts = named.groupBy("text", "label").agg(F.count("*").alias("n"))
    return top_k(counts, ["label"], [F.desc("n"), F.col("text")], k, "rank")


def route(rule: Column, model: Column, confidence: Column, fallback: Column, threshold: float = 0.7) -> dict[str, Column]:
    """Cheapest tier that can answer: the rule, then the model if it is confident, then the fallback."""
    sure = model.isNotNull() & (confidence >= threshold)
    return {
        "tier": F.when(rule.isNotNull(), "rule").when(sure, "model").otherwise("fallback"),
        "answer": F.coalesce(rule, F.when(sure, model), fallback),
    }
