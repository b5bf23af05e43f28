"""Work on whole texts: page metadata, terms, mentions, chunks, overlap, augmentation."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.scalar import PHONE, SPACE_WORD, emails, ngrams, ratio, words
from larkspur.operators.ordering import computed_once, join_group_stats, semi_join, top_k
from larkspur.session import saved, shared_root


HREFS = (r'href="([^"]+)"', r"href='([^']+)'")


def page_metadata(pages: DataFrame) -> DataFrame:
    return pages.withColumns({
        "title": F.regexp_extract("html", r"<title>([^<]*)</title>", 1),
        "lang": F.regexp_extract("html", r'<html lang="([^"]*)"', 1),
        "host": F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1),
    })


def split_overlap(
    train: DataFrame, id_col: str, text: str, held_out: DataFrame, held_text: str, n: int = 8,
) -> DataFrame:
    """Rows of ``train`` that share an n-gram of words with a held-out text, or are the same text in words:
    whether the whole normalised text is there, and the number of shared n-grams (0 for a text of
    fewer than ``n`` words). Texts without words are never the same.

    Rows are looked for by 64-bit hashes of their n-grams first; only those that meet one of a held-out text are compared by the
    n-grams themselves. Held-out n-grams are made distinct, so each training n-gram finds at most one partner and
    no pair list is built, however often a passage is repeated."""
    w = words(F.coalesce(F.col(text), F.lit("")))

    def hashes(df: DataFrame, *keep: str) -> DataFrame:
        """A row for the hash of each n-gram and of the whole text, the latter told apart by its length in n-grams."""
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1)))
        grams = F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, n)))
        whole = F.when(F.size("w") > 0, F.array(F.xxhash64("w", F.lit("whole"))))
        empty = F.array().cast("array<bigint>")
        return df.select(*keep, F.explode(F.array_distinct(F.concat(F.coalesce(grams, empty), F.coalesce(whole, empty)))).alias("hash"))

    held = held_out.select(words(F.coalesce(held_text, F.lit(""))).alias("w"))
    rows = train.select(F.xxhash64(id_col, text).alias("row"), id_col, w.alias("w"))
    met = semi_join(hashes(rows, "row"), hashes(held).distinct(), "hash", ["row"]).select("row").distinct()
    few = saved(rows.join(met, "row", "left_semi").drop("row"), "overlap")

    to_grams = NGram(n=n, inputCol="w", outputCol="grams")
    # the whole text goes along as one more gram, told apart by its first letter
    text_gram = F.when(F.size("w") > 0, F.concat(F.lit("="), F.md5(F.array_join("w", " "))))
    marked = F.explode(F.concat(
        F.transform(F.array_distinct("grams"), lambda g: F.concat(F.lit("~"), g)), F.array_compact(F.array(text_gram)))).alias("gram")
    grams = to_grams.transform(few).select(id_col, marked)
    held_grams = to_grams.transform(held).select(marked).distinct()
    return semi_join(grams, held_grams, "gram", [id_col]).groupBy(id_col).agg(
        F.bool_or(F.startswith("gram", F.lit("="))).alias("same_text"), F.count_if(F.startswith("gram", F.lit("~"))).alias("shared_ngrams")
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """One row per link of a page: (page_id, host, path) to (to_host, to_path), in double or single quotes.
    Absolute links and those that begin with ``//`` carry their host; the others stay on the page's,
    relative ones below its folder, with ``.`` and ``..`` resolved. Links to a place in the same page and
    those of other schemes (mailto, javascript) are left out."""
    own = pages.select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)", 1).alias("path"),
        F.explode(F.concat(*[F.regexp_extract_all("html", F.lit(q), F.lit(1)) for q in HREFS])).alias("href"),
    )
    href = F.col("href")
    hosted = href.rlike(r"^(https?:)?//")
    plain = F.regexp_extract("href", r"^([^?#]*)", 1)
    folder = F.regexp_extract("path", r"^(.*/)", 1)
    below = F.when(plain == "", F.col("path")).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), plain))
    target = F.when(hosted, F.regexp_extract("href", r"^(?:https?:)?//([^/?#]+)", 1)).otherwise(F.col("host"))
    path = F.when(hosted, F.regexp_extract("href", r"^(?:https?:)?//[^/?#]+(/[^?#]*)", 1)).when(
        F.startswith("href", F.lit("/")), plain
    ).otherwise(below)
    return own.where(hosted | ~href.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)")).select(
        "page_id", "host", "path", target.alias("to_host"), without_dots(path).alias("to_path")
    )


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` steps taken."""
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    folder_end = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    taken = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))),
    )
    return F.when(F.contains(path, F.lit("/.")), F.array_join(F.concat(taken, folder_end), "/")).otherwise(path)


def parse_labelled_lines(df: DataFrame, answer: str) -> DataFrame:
    """``LABEL: a, b`` lines to one (label, entity) row per entity; blank entities are dropped."""
    line = F.explode(F.split(F.col(answer), "\n")).alias("_line")
    parts = df.select("*", line).select(
        "*", F.regexp_extract("_line", r"^\s*([A-Za-z_]+)\s*:", 1).alias("label"),
        F.split(F.regexp_extract("_line", r"^[^:]*:(.*)$", 1), ",").alias("_entities"),
    )
    return (
        parts.where(F.col("label") != "")
        .withColumn("entity", F.explode("_entities"))
        .withColumn("entity", F.trim("entity"))
        .where(F.col("entity") != "")
        .drop("_line", "_entities")
    )


def parse_labelled_list(df: DataFrame, answer: str) -> DataFrame:
    """``Name (LABEL), Name (LABEL)`` lists to one (label, entity) row per entity."""
    pattern = r"([^,()]+)\(([A-Za-z_]+)\)"
    names = F.regexp_extract_all(F.col(answer), F.lit(pattern), F.lit(1))
    labels = F.regexp_extract_all(F.col(answer), F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(labels.alias("label"), names.alias("entity"))
    return df.select("*", F.inline(pairs)).withColumn("entity", F.trim("entity"))


def build_requests(
    df: DataFrame, text: str, system_message: str, max_words: int, max_tokens: int = 1024, base_prompt: str = "",
    long_text: str = "split",
) -> DataFrame:
    """One JSON request per text. A text above ``max_words`` becomes several requests
    (``long_text='split'``, numbered by ``part``) or is cut (``'truncate'``)."""
    if long_text not in ("split", "truncate"):
        raise ValueError("long_text must be 'split' or 'truncate'")
    all_words = F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))
    rows = df.withColumn("_w", all_words).withColumn("n_words", F.size("_w"))
    last = F.greatest(F.ceil(F.col("n_words") / max_words), F.lit(1)).cast("int") if long_text == "split" else F.lit(1)
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(1), last)))
    content = F.when(F.col("n_words") <= max_words, F.col(text)).otherwise(
        F.array_join(F.slice("_w", (F.col("part") - 1) * max_words + 1, max_words), " ")
    )
    message = F.struct(F.lit("user").alias("role"), F.concat(F.lit(base_prompt), content).alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.lit(system_message).alias("content"))
    request = F.struct(F.array(system, message).alias("messages"), F.lit(max_tokens).alias("max_tokens"))
    return parts.withColumn("request", F.to_json(request)).drop("_w")


def contacts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """E-mail addresses and phone numbers found in a text, one row per hit."""
    def hits(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("contact")))

    phones = F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))
    return df.select(id_col, F.inline(F.concat(hits("email", emails(F.col(text))), hits("phone", phones))))


def term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf): how often each word occurs in each text. The ids are looked at first: where each has one row, words are
    sorted and counted in their row and nothing is shuffled; only rows that share an id have to be counted together."""
    if df.groupBy(id_col).count().where("count > 1").limit(1).count():
        return df.select(id_col, F.explode(words(F.col(text))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    rows = computed_once(df.select(id_col, text), _w=F.sort_array(words(F.col(text))))
    places = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1))
    first = F.filter(places, lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", i - 1)))
    starts = computed_once(rows.select(id_col, "_w"), _starts=first)
    counted = F.transform("_starts", lambda start, i: F.struct(
        F.get("_w", start).alias("term"), (F.coalesce(F.get("_starts", i + 1), F.size("_w")) - start).cast("long").alias("tf")))
    return starts.select(id_col, F.inline(counted))


def dictionary_mentions(counts: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Mentions and texts per dictionary name. Counts are summed per term before the dictionary joins."""
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("mentions"), F.count("*").alias("texts"))
    return per_term.join(names.select(F.col(name).alias("term")).distinct(), "term")


def tf_idf(counts: DataFrame, id_col: str, n_texts: Column) -> DataFrame:
    """tf * ln(N / df). The frequency table has one row per term; terms of very many texts are salted."""
    # Counting by tf keeps that column on both sides, so that Spark computes the counts once.
    df_table = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    joined = join_group_stats(counts, df_table, ["term"], "df", [id_col])
    return joined.withColumn("tf_idf", F.col("tf") * F.ln(n_texts / F.col("df")))


def class_words(counts: DataFrame, classes: DataFrame, id_col: str, label: str, k: int) -> DataFrame:
    """The k words whose share in a class most exceeds their share in all classes together. The counts
    per class and term are used four times; they are checkpointed, far smaller than the texts."""
    shared_root(counts.sparkSession)
    by_class = (
        counts.join(classes.select(id_col, label), id_col).groupBy(label, "term").agg(F.sum("tf").alias("n")).checkpoint()
    )
    class_total = by_class.groupBy(label).agg(F.sum("n").alias("class_n"), F.count("*").alias("_terms"))
    per_term = by_class.groupBy("term").agg(F.sum("n").alias("term_n"))
    total = by_class.agg(F.sum("n")).scalar()
    lift = F.col("n") / F.col("class_n") - F.col("term_n") / F.col("_total")
    in_class = join_group_stats(by_class, class_total, [label], "_terms", ["term"])
    scored = in_class.join(per_term, "term").withColumn("_total", total).withColumn(
        "lift", F.round(lift, 9)
    )
    return top_k(scored, [label], [F.desc("lift"), F.col("term")], k).select(label, "term", "n", "lift", "rn")


def numbered_copies(df: DataFrame, n: str, out: str, run: int = 4096) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``out``. The numbers are made in runs of ``run``, so that many copies of a row are dealt
    to tasks and are never one long list."""
    starts = F.sequence(F.lit(0), F.floor((F.col(n) - 1) / run).cast("int"))
    runs = df.where(F.col(n) > 0).withColumn("_run", F.explode(starts))
    far = runs.where(F.col("_run") > 0).repartition(F.xxhash64("_run", *df.columns))
    spread = runs.where(F.col("_run") == 0).unionByName(far)
    last = F.least(F.col(n) - 1, F.col("_run") * run + (run - 1)).cast("int")
    return spread.withColumn(out, F.explode(F.sequence((F.col("_run") * run).cast("int"), last))).drop("_run")


def augment(df: DataFrame, id_col: str, text: str, copy: str, contractions: dict, synonyms: dict, drop_of_16: int, seed: str) -> DataFrame:
    """Reworded copies: contractions, synonym words, and words dropped at a seeded rate of
    ``drop_of_16`` in 16. Meant for training rows only."""
    short = F.col(text)
    for long_form, contraction in contractions.items():
        short = F.replace(short, F.lit(long_form), F.lit(contraction))
    key = F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"), F.col(copy).cast("string"))

    def dropped(i: Column) -> Column:
        digit = F.substring(F.md5(F.concat_ws("|", key, i.cast("string"))), 1, 1)
        return F.conv(digit, 16, 10).cast("int") < drop_of_16

    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    swapped = F.transform(F.split(short, " "), lambda w: F.coalesce(F.try_element_at(table, w), w))
    return df.withColumn(text, F.array_join(F.filter(swapped, lambda w, i: ~dropped(i)), " "))


def chunks(df: DataFrame, id_col: str, text: str, size: int, overlap: int) -> DataFrame:
    """Consecutive pieces of ``size`` words, each repeating the last ``overlap`` of the one before."""
    step = size - overlap
    rows = computed_once(df.select(id_col, text), _w=F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))).drop(text)
    n = F.greatest(F.ceil((F.size("_w") - overlap) / step), F.lit(1)).cast("int")
    numbered = rows.where(F.size("_w") > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    piece = F.slice("_w", F.col("chunk") * step + 1, size)
    return numbered.select(id_col, "chunk", F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("chunk_text"))


def ngram_overlap(df: DataFrame, ids: list[str], candidate: str, reference: str, n: int) -> DataFrame:
    """Clipped n-gram precision, recall and F1 of a candidate text against its reference text."""
    def counted(text: str, side: str) -> DataFrame:
        grams = df.select(*ids, words(F.col(text)).alias("_w")).select(*ids, F.explode(ngrams(F.col("_w"), n)).alias("gram"))
        return grams.groupBy(*ids, "gram").agg(F.count("*").alias(side))

    both = counted(candidate, "c").join(counted(reference, "r"), [*ids, "gram"], "full").na.fill(0, ["c", "r"])
    sums = both.groupBy(*ids).agg(
        F.sum(F.least("c", "r")).alias("matches"), F.sum("c").alias("n_candidate"), F.sum("r").alias("n_reference")
    )
    m, c, r = F.col("matches"), F.col("n_candidate"), F.col("n_reference")
    return sums.select(*ids, "matches", ratio(m, c).alias("precision"), ratio(m, r).alias("recall"), ratio(2 * m, c + r).alias("f1"))


def quality_measures(df: DataFrame, text: str) -> DataFrame:
    """Length, share of symbols and share of distinct words of a text."""
    w = words(F.col(text))
    symbols = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""))
    return computed_once(
        df.withColumn("_w", w), n_words=F.size("_w"), symbol_share=ratio(symbols, F.length(text)),
        distinct_share=ratio(F.size(F.array_distinct("_w")), F.size("_w")),
    ).drop("_w")


def quality_filter(measured: DataFrame, min_words: int = 20, max_symbols: float = 0.1, min_distinct: float = 0.2) -> DataFrame:
    return measured.where(
        (F.col("n_words") >= min_words) & (F.col("symbol_share") <= max_symbols) & (F.col("distinct_share") >= min_distinct)
    )


def search(postings: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """Texts that hold all terms, best first. ``postings`` are (id, term, tf) rows: a list of one row
    per text and term, so that a frequent term is many rows and not one huge array."""
    wanted = sorted({t.lower() for t in terms})
    return (
        postings.where(F.col("term").isin(wanted))
        .groupBy(id_col).agg(F.count("*").alias("_terms"), F.sum("tf").alias("hits"))
        .where(F.col("_terms") == len(wanted)).drop("_terms")
        .orderBy(F.desc("hits"), id_col)
    )


def link_report(edges: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(backlinks, orphans): links between known pages counted per target page, and the pages no known
    page links to. ``pages`` has page_id, host, path."""
    known = pages.select(F.col("page_id").alias("to_page"), F.col("host").alias("to_host"), F.col("path").alias("to_path"))
    counted = edges.groupBy("page_id", "to_host", "to_path").agg(F.count("*").alias("n"))
    backlinks = (
        counted.join(known, ["to_host", "to_path"]).where(F.col("page_id") != F.col("to_page"))
        .groupBy("to_page").agg(F.count("*").alias("linking_pages"), F.sum("n").alias("links"))
    )
    orphans = pages.join(backlinks.select(F.col("to_page").alias("page_id")), "page_id", "left_anti")
    return backlinks, orphans
