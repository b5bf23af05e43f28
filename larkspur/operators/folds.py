"""Predictions of rows by models that have not seen them, and the labels these contradict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.scalar import ratio, seeded_hash, words
from larkspur.session import saved


def text_features(text: Column) -> dict[str, Column]:
    """Shares and means that tell texts of different kinds apart, whatever their words."""
    w, n = words(text), F.greatest(F.length(text), F.lit(1))
    lines = F.split(text, "\n")
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""))
    return {
        "symbol_share": symbols / n, "digit_share": F.length(F.regexp_replace(text, r"[^0-9]+", "")) / n,
        "upper_share": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / n, "word_length": ratio(F.length(F.array_join(w, "")), F.size(w)),
        "distinct_share": ratio(F.size(F.array_distinct(w)), F.size(w)), "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "log_words": F.ln(F.size(w) + F.lit(1.0)),
    }


FEATURES = ["symbol_share", "digit_share", "upper_share", "word_length", "distinct_share", "distinct_lines", "log_words"]


def text_vectors(rows: DataFrame, buckets: int = 1 << 11) -> DataFrame:
    """``words`` and ``FEATURES`` of each row as one sparse vector, ``features``: hashed words, then the shares of :func:`text_features`.

    The vector goes without the names of its parts, which would be in the footer of each file it is written to."""
    hashed = HashingTF(inputCol="words", outputCol="hashed", numFeatures=buckets, binary=True).transform(rows)
    put = VectorAssembler(inputCols=["hashed", *FEATURES], outputCol="features").transform(hashed)
    return put.withColumn("features", F.col("features").alias("features", metadata={})).drop("words", "hashed", *FEATURES)


def text_classifier(features: str, label: str) -> Estimator:
    """Logistic regression on the vectors of :func:`text_vectors`."""
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=15, regParam=0.01)


def out_of_fold(
    rows: DataFrame, id_col: str, label: str, text: str, folds: int = 5, seed: str = "fold",
    classifier: Callable[[str, str], Estimator] = text_classifier, vectors: Callable[[DataFrame], DataFrame] = text_vectors,
) -> DataFrame:
    """id, label, fold, p (the probability of label 1), n_known (rows the model has seen).

    Rows are dealt to folds by a hash of their id, so repeated rows of an id share one; each fold is scored by a model that was
    fitted on the others. Labels are 0 and 1; rows with a null id, label or text are left out. Where the rows outside a
    fold have one label only there is no model, and p is their share of 1s.

    ``vectors`` makes of ``words`` and ``FEATURES`` what models read; it learns nothing, so it is done once for all folds and written. What
    learns from the rows belongs in ``classifier``, which is fitted for each fold (a Pipeline may read whatever columns ``vectors`` leaves)."""
    known = rows.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label"), F.col(text).alias("text")).where("id IS NOT NULL AND label IS NOT NULL AND text IS NOT NULL")
    fold = F.conv(F.substring(seeded_hash(seed, "id"), 1, 8), 16, 10).cast("long") % folds
    measured = known.select("id", "label", fold.cast("int").alias("fold"), words(F.col("text")).alias("words"), *[c.alias(n) for n, c in text_features(F.col("text")).items()])
    known = saved(vectors(measured), "folds")
    sizes = {r.fold: (r.n, r.ones) for r in known.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()}
    scored = None
    for k in range(folds):
        n, ones = (sum(v[i] for f, v in sizes.items() if f != k) for i in (0, 1))
        part = known.where(F.col("fold") == k)
        if 0 < ones < n:
            model = classifier("features", "label").fit(known.where(F.col("fold") != k))
            p = vector_to_array("probability")[1]
            part = model.transform(part)
        else:
            p = F.lit(ones / n if n else None).cast("double")
        found = part.select(F.col("id").alias(id_col), F.col("label").cast("int").alias(label), "fold", p.alias("p"), F.lit(int(n)).cast("long").alias("n_known"))
        scored = found if scored is None else scored.unionAll(found)
    return scored


def contradicted(scored: DataFrame, label: str, least: dict[int, float] | float | None = None) -> DataFrame:
    """The rows whose label is contradicted with enough confidence, with ``predicted`` and ``confidence`` (the probability of the
    other label).

    Without a given threshold it is, for each label, the mean probability that rows with the other label get for theirs: who
    is put into another class with more confidence than that class's own rows is suspect."""
    chance = F.when(F.col(label) == 1, 1 - F.col("p")).otherwise(F.col("p"))
    if least is None:
        means = {int(r[label]): r.m for r in scored.groupBy(label).agg(F.avg(F.when(F.col(label) == 1, F.col("p")).otherwise(1 - F.col("p"))).alias("m")).collect()}
        least = {value: means.get(1 - value, 1.0) for value in (0, 1)}
    elif not isinstance(least, dict):
        least = {0: least, 1: least}
    floor = F.when(F.col(label) == 1, F.lit(float(least[1]))).otherwise(F.lit(float(least[0])))
    judged = scored.withColumns({"confidence": chance, "predicted": (1 - F.col(label)).cast("int")})
    return judged.where(F.col("confidence") >= floor)
