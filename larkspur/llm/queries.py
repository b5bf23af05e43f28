"""Queries of the operators for training text, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm import alignment, bigrams, checks, decontamination, html, jaccard, language, licenses, lines, mixing, quality, suffixes, trie, urls
from larkspur.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            CHECK_SQL[key] = sql
        return plan

    return register


@query("op1_license_scan")
def op1_license_scan(t: Tables) -> DataFrame:
    found = licenses.license_scan(t.documents, licenses.all_templates())
    best = F.coalesce(F.array_max("spans.containment"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ", ").alias("licenses"),
        F.size("spans").cast("long").alias("n_spans"), F.round(best, 6).alias("containment"), F.to_json("spans").alias("spans"))


@query("op2_language_id")
def op2_language_id(t: Tables) -> DataFrame:
    return language.language_id(t.documents)


@query("op3_lm_scoring")
def op3_lm_scoring(t: Tables) -> DataFrame:
    return bigrams.cross_entropy_difference(t.documents, t.labels)


@query("op4_html_extraction")
def op4_html_extraction(t: Tables) -> DataFrame:
    return html.extract(t.pages)


@query("op5_line_dedup", checks.LINE_DEDUP)
def op5_line_dedup(t: Tables) -> DataFrame:
    return lines.dedup_lines(t.documents).select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


@query("op6_quality_rules")
def op6_quality_rules(t: Tables) -> DataFrame:
    return quality.quality(t.documents, t.labels)


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(t: Tables) -> DataFrame:
    return jaccard.jaccard_join(t.documents)


#: The rules of the contract, in its order.
URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


@query("op8_url_filters")
def op8_url_filters(t: Tables) -> DataFrame:
    found = urls.url_verdicts(t.pages, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), "block_odds")


@query("op9_mixing", checks.MIXING)
def op9_mixing(t: Tables) -> DataFrame:
    return mixing.mixed(t.documents).select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "shuffle_key", "text")


@query("op10_decontamination", checks.DECONTAMINATION)
def op10_decontamination(t: Tables) -> DataFrame:
    found = decontamination.overlap(t.documents, t.benchmark, matched=False)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


@query("op11_conversation_prefix_trie", checks.PREFIX_TRIE)
def op11_conversation_prefix_trie(t: Tables) -> DataFrame:
    return trie.node_rows(t.conversations)


@query("op12_cross_tokenizer_alignment")
def op12_cross_tokenizer_alignment(t: Tables) -> DataFrame:
    return alignment.aligned_documents(t.documents)


@query("op13_suffix_array_dedup")
def op13_suffix_array_dedup(t: Tables) -> DataFrame:
    return suffixes.cleaned_documents(t.documents)
