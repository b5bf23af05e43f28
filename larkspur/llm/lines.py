"""Line dedup with a tree of line templates, in DataFrame functions only.

A line is parsed through a tree of fixed depth: its number of tokens, then its first ``DEPTH`` tokens, where tokens with a
digit or @ count as a variable field ``<*>``. A leaf holds the different masked lines (variants) with these in common, and as many
templates as it takes: the variant in most documents leads, and variants that agree with it in at least ``SIMILARITY`` of
the tokens, place by place, belong to its template, in which the other tokens are variable. Templates that recur across
documents are dropped.

Leaders are found in rounds. Two variants alike enough differ in at most d tokens, so of d + 1 runs of their tokens at least one is
equal: variants meet in buckets of equal runs. Short lines, where d is 1 and runs would be of a token or two, meet in
buckets of lines that are equal but for one place. One that is the best in all its buckets leads; the others join the best leader of
the round that they meet and are like enough; who is left goes on to the next round. No pairs are listed: a variant is only
compared with the best of each of its buckets. Only hashes of lines are shuffled; tokens are hashed for one line of each variant
of leaves with several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.session import saved

DEPTH = 3
SIMILARITY = 0.8
#: A template recurs when it is in two documents or more and documents * words reaches this: a line of ten words is
#: enough in two documents, a line of one word only in twenty. Two characters of a script without blanks count as a word.
MASS = 20
#: Bits of the marks that tell which documents are read again: 4 MB in all.
MARKS = 1 << 24

BLANKS = "[ \\t\\x0B\\f\\r]"


def masked(line: Column) -> Column:
    """The line with single blanks and with variable fields in place of tokens that hold a digit or @."""
    untidy = F.lit(False)
    for mark in ("  ", "\t", "\x0B", "\f", "\r"):
        untidy = untidy | F.contains(line, F.lit(mark))
    plain = F.trim(F.when(untidy, F.regexp_replace(line, f" {BLANKS}+|[\\t\\x0B\\f\\r]{BLANKS}*", " ")).otherwise(line))
    return F.when(plain.rlike("[0-9@]"), F.regexp_replace(plain, "[^ ]*[0-9@][^ ]*", "<*>")).otherwise(plain)


# Letters of Thai and Lao, Myanmar, Khmer, kana and Han, which are written without blanks; all lie beyond the first.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


def words_in(masked_line: Column, n: Column) -> Column:
    """Tokens, and half the characters of scripts without blanks."""
    pattern = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNSPACED) + "]"
    unspaced = F.length(masked_line) - F.length(F.regexp_replace(masked_line, pattern, ""))
    return n + F.when(masked_line.rlike(rf"[\x{{{UNSPACED[0][0]:X}}}-\x{{10FFFF}}]"), F.floor(unspaced / 2)).otherwise(F.lit(0)).cast("int")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a token: doc_id, k (tells texts of one id apart), line_no, masked."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "k", "line_no", masked(F.col("line")).alias("masked")).where("masked <> ''")


def in_leaves(lines: DataFrame, depth: int) -> DataFrame:
    """Add tokens, n, leaf and line_key."""
    split = lines.withColumn("tokens", F.split("masked", " ")).withColumn("n", F.size("tokens"))
    return split.withColumns({"leaf": F.xxhash64("n", F.slice("tokens", 1, depth)), "line_key": F.xxhash64("masked")})


def most_changes(n: Column, similarity: float) -> Column:
    """In how many tokens two lines of n tokens may differ."""
    return (n - F.ceil(n * F.lit(similarity) - F.lit(1e-9))).cast("int")


def marked_only(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The documents whose ``k`` may be a ``key`` of ``picked``, so that few texts are shuffled where few are wanted. The marks are one bit for
    each of ``MARKS`` values, in words of 64: at most MARKS / 64 rows are broadcast, however many documents there are."""
    def place(key: str) -> tuple[Column, Column]:
        spot = F.pmod(F.col(key), F.lit(MARKS))
        return F.floor(spot / 64).cast("int"), (spot % 64).cast("int")

    word, bit = place("key")
    marks = picked.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    word, bit = place("k")
    kept = docs.withColumns({"word": word, "bit": bit}).join(F.broadcast(marks), "word")
    return kept.where(F.call_function("shiftright", F.col("bits"), F.col("bit")).bitwiseAND(F.lit(1)) == 1).select("doc_id", "text", "k")


def variants_of(docs: DataFrame, lines: DataFrame, depth: int) -> DataFrame:
    """leaf, line_key, n, v (a number, less for the better), tokens (hashes) of the different lines of ``lines``."""
    per_doc = lines.groupBy("leaf", "line_key", "doc_id", "k").agg(F.min("n").alias("n"), F.min("line_no").alias("line_no"))
    found = per_doc.groupBy("leaf", "line_key").agg(F.min("n").alias("n"), F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "k", "line_no")).alias("first"))
    ranked = found.orderBy(F.desc("n_docs"), "first.doc_id", "first.line_no", "line_key")
    found = saved(ranked.withColumn("v", F.monotonically_increasing_id()), "variants")  # numbers follow the order
    picked = found.groupBy(F.col("first.doc_id").alias("id"), F.col("first.k").alias("k")).agg(F.collect_set("first.line_no").alias("wanted"))
    picked = saved(picked.withColumnRenamed("k", "key"), "picked")
    texts = marked_only(docs.withColumn("k", F.xxhash64("doc_id", "text")), picked).join(picked, (F.col("k") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    own = texts.select(F.explode(F.transform("wanted", lambda i: F.get(F.split("text", "\n"), i))).alias("line")).select(masked(F.col("line")).alias("masked"))
    spelled = in_leaves(own, depth).select("leaf", "line_key", F.transform("tokens", lambda x: F.hash(x)).alias("tokens")).dropDuplicates(["leaf", "line_key"])
    return saved(found.join(spelled, ["leaf", "line_key"]).select("leaf", "line_key", "n", "v", "tokens"), "spelled")


def buckets_of(variants: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(bucket, v): variants of a leaf that are alike enough share a bucket."""
    d = most_changes(F.col("n"), similarity)
    rest = F.col("n") - depth
    parts = F.least(d + 1, rest)

    def bucket(part: Column, *what: Column) -> Column:
        return F.xxhash64("leaf", part, *what)

    runs = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda p: bucket(p, F.slice("tokens", (F.lit(depth + 1) + F.floor(p * rest / parts)).cast("int"), (F.floor((p + 1) * rest / parts) - F.floor(p * rest / parts)).cast("int"))))
    hashes = F.transform("tokens", lambda x, i: F.xxhash64(i, x))
    whole = F.aggregate(hashes, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    but_one = F.transform(F.sequence(F.lit(depth), F.col("n") - 1), lambda i: bucket(i, whole.bitwiseXOR(F.get(hashes, i))))
    # more changes than tokens after the first ones: all of the leaf meet
    met = F.when(d >= rest, F.array(bucket(F.lit(0)))).when(d == 1, but_one).otherwise(runs)
    return variants.select(F.explode(met).alias("bucket"), "v")


def generalised(docs: DataFrame, lines: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, line_key, template) for the variants that belong to the template of another one."""
    least = F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9))
    variants = variants_of(docs, lines.where(F.col("several") & (F.col("n") > depth) & (least < F.col("n"))), depth)
    tokens = variants.select("v", "tokens")
    buckets, found = buckets_of(variants, depth, similarity), None
    while True:
        # who shares no bucket (any more) has its own template and is left out here
        best = buckets.groupBy("bucket").agg(F.min("v").alias("top"), F.max("v").alias("last")).where("top < last").drop("last")
        seen = saved(buckets.join(best, "bucket").select("bucket", "v", "top"), "seen")
        if seen.isEmpty():
            break
        leads = saved(seen.groupBy("v").agg(F.min("top").alias("top")).where("top = v").select("v"), "leads")
        others = seen.where("top < v").select("v", "top").distinct().join(leads.select(F.col("v").alias("top")), "top", "left_semi")
        beside = others.join(tokens, "v").join(tokens.select(F.col("v").alias("top"), F.col("tokens").alias("own")), "top")
        same = F.aggregate(F.zip_with("tokens", "own", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        alike = beside.where(same >= F.ceil(F.size("tokens") * F.lit(similarity) - F.lit(1e-9)))
        joined = saved(alike.groupBy("v").agg(F.min("top").alias("top")), "joined")
        found = joined if found is None else found.unionAll(joined)
        buckets = saved(seen.select("bucket", "v").join(leads.unionAll(joined.select("v")), "v", "left_anti"), "left")
        tokens = saved(tokens.join(buckets.select("v").distinct(), "v", "left_semi"), "tokens")  # mostly few are left after the first round
    if found is None:
        return variants.limit(0).select("leaf", "line_key", F.col("line_key").alias("template"))
    led = found.join(variants.select("v", "leaf", "line_key"), "v")
    return led.join(variants.select(F.col("v").alias("top"), F.col("line_key").alias("template")), "top").select("leaf", "line_key", "template")


def recurring_lines(docs: DataFrame, keep_first: bool, depth: int = DEPTH, similarity: float = SIMILARITY, mass: int = MASS) -> DataFrame:
    """(doc_id, k, dropped): the numbers of the lines of a text that are dropped."""
    lines = in_leaves(numbered_lines(docs), depth)
    lines = saved(lines.select("doc_id", "k", "line_no", "n", words_in(F.col("masked"), F.col("n")).alias("words"), "leaf", "line_key"), "lines")
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n_lines"), F.min("line_key").alias("low"), F.max("line_key").alias("high"))
    leaves = saved(leaves.where("n_lines > 1").select("leaf", (F.col("low") != F.col("high")).alias("several")), "leaves")
    lines = saved(lines.join(leaves, "leaf"), "shared")
    joined = saved(generalised(docs, lines, depth, similarity), "templates")
    lines = lines.join(joined, ["leaf", "line_key"], "left").select("doc_id", "k", "line_no", "words", "leaf", F.coalesce("template", "line_key").alias("template"))
    per_doc = lines.groupBy("leaf", "template", "doc_id", "k").agg(F.min("words").alias("words"))
    totals = per_doc.groupBy("leaf", "template").agg(F.min("words").alias("words"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    recurring = saved(totals.where(f"n_docs > 1 AND n_docs * words >= {int(mass)}").select("leaf", "template", "first_doc"), "recurring")
    hit = lines.join(recurring, ["leaf", "template"])
    if keep_first:
        hit = hit.where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return hit.groupBy("doc_id", "k").agg(F.collect_set("line_no").alias("dropped"))


def dedup_lines(docs: DataFrame, keep_first: bool = False, depth: int = DEPTH, similarity: float = SIMILARITY, mass: int = MASS) -> DataFrame:
    """The documents with shortened text, all other columns as they were, and two more columns at the end: n_lines and n_dropped.

    Lines end at line feeds. Lines without a token are never dropped. With ``keep_first`` the document with the smallest
    doc_id that has a template keeps its lines. A document is a distinct (doc_id, text); repeated rows count once and
    get the same result; two texts under one id are two documents. A null text stays null with 0 lines; the empty text
    has one line. Extra columns with the same names as the two new ones are replaced.
    """
    text = F.col("text").cast("string")
    drops = recurring_lines(docs.select("doc_id", text.alias("text")), keep_first, depth, similarity, mass)
    names = {c.lower() for c in docs.columns}
    k, other, lines_ = (next(x for x in (stem + "_" * i for i in range(1, 99)) if x not in names) for stem in ("k", "id", "drop"))
    drops = drops.toDF(other, k, lines_)
    hashed = docs.withColumn(k + "t", F.xxhash64("doc_id", text))
    joined = hashed.join(drops, (hashed[k + "t"] == drops[k]) & hashed["doc_id"].eqNullSafe(drops[other]), "left")
    parts = F.split(text, "\n")
    kept = F.when(F.col(lines_).isNull(), text).otherwise(
        F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col(lines_), i)), "\n"))
    columns = [kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*columns, F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"), F.coalesce(F.size(lines_), F.lit(0)).alias("n_dropped"))


def has_token(text: Column) -> Column:
    """Whether any line of the text has a token."""
    return F.coalesce(text.rlike("[^ \\t\\x0B\\f\\r\\n]"), F.lit(False))
