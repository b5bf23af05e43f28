"""Text, search, link, quality, vector and token-cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import billing as B, quality as Q, text as X, vectors as V
from larkspur.operators.names import name_hits, name_mentions
from larkspur.operators.overlap import rouge_l, with_bleu
from larkspur.operators.search_index import SearchIndex
from larkspur.operators.tokens import ratio_by_group
from larkspur.operators.vector_index import VectorIndex
from larkspur.plans.registry import query
from larkspur.plans.sqltext import tokens, words
from larkspur.operators.ordering import join_group_stats, range_block
from larkspur.operators.relational import foreign_key_violations
from larkspur.session import saved, work_path
from larkspur.sources.files import inline_table

# ---- requests and tokens ---------------------------------------------------------------------

SYSTEM = "Label the text. Use the allowed labels only."


@query("build_requests", rf"""
    WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \n\t]+') AS w FROM documents),
    p AS (SELECT doc_id, text, w, unnest(range(1, greatest(ceil(len(w) / 500), 1)::bigint + 1)) AS part FROM w),
    c AS (SELECT doc_id, part, len(w) AS n_words, CASE WHEN len(w) <= 500 THEN text ELSE array_to_string(w[(part - 1) * 500 + 1:part * 500], ' ') END AS content FROM p)
    SELECT doc_id, part::int AS part, n_words::int AS n_words, md5('{{"messages":[{{"role":"system","content":"{SYSTEM}"}},{{"role":"user","content":' || to_json('Text: ' || content)
           || '}}],"max_tokens":1024}}') AS request_md5 FROM c""")
def build_requests(t):
    requests = X.build_requests(t.spread("documents", "doc_id").select("doc_id", "text"), "text", SYSTEM, 500, 1024, "Text: ")
    return requests.select("doc_id", "part", "n_words", F.md5("request").alias("request_md5"))


@query("estimate_tokens", f"""
    WITH e AS (SELECT doc_id, {tokens('text')} AS tokens FROM documents)
    SELECT doc_id, tokens, ceil(tokens / 665)::bigint AS pages, tokens > 4096 AS too_long FROM e""")
def estimate_tokens(t):
    counted = t.spread("documents", "doc_id").select("doc_id", S.estimated_tokens(F.col("text")).alias("tokens"))
    return counted.select(
        "doc_id", "tokens", F.ceil(F.col("tokens") / 665).alias("pages"), (F.col("tokens") > 4096).alias("too_long")
    )


@query("token_ratio_by_language", f"""
    WITH l AS (SELECT lang, avg({tokens('text')}) AS tokens, sum(strlen(text)) / sum(length(text)) AS bytes_per_char FROM documents GROUP BY lang)
    SELECT lang, round(tokens, 4) AS mean_tokens, round(tokens / (SELECT tokens FROM l WHERE lang = 'en'), 6) AS token_ratio,
           round(bytes_per_char / (SELECT bytes_per_char FROM l WHERE lang = 'en'), 6) AS byte_ratio FROM l""")
def token_ratio_by_language(t):
    stats = t.spread("documents", "doc_id").groupBy("lang").agg(
        F.avg(S.estimated_tokens(F.col("text"))).alias("tokens"),
        (F.sum(F.octet_length("text")) / F.sum(F.length("text"))).alias("bytes_per_char"),
    )
    english = stats.agg(F.max(F.when(F.col("lang") == "en", F.struct("tokens", "bytes_per_char")))).scalar()
    return stats.select(
        "lang", F.round("tokens", 4).alias("mean_tokens"), F.round(F.col("tokens") / english["tokens"], 6).alias("token_ratio"),
        F.round(F.col("bytes_per_char") / english["bytes_per_char"], 6).alias("byte_ratio"),
    )


@query("vocabulary_tokens_by_language")
def vocabulary_tokens_by_language(t):
    """Tokens of all texts by a published vocabulary, a character and relative to English."""
    found = ratio_by_group(t.spread("documents", "doc_id"), "lang", "en", "text")
    return found.withColumns({c: F.round(c, 6) for c in ("tokens_per_char", "ratio")})


# ---- words and passages ----------------------------------------------------------------------


@query("regex_contacts", r"""
    SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS contact FROM documents
    UNION ALL SELECT doc_id, 'phone', trim(unnest(regexp_extract_all(text, '\+?[0-9]{0,2} ?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}'))) FROM documents""")
def regex_contacts(t):
    return X.contacts(t.spread("documents", "doc_id"), "doc_id", "text")


COUNTS_SQL = f"""
    WITH k AS (SELECT doc_id, unnest({words('text')}) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY ALL)"""


#: Names of one to three words: every run of words of the benchmark texts.
NAME_WORDS = 3


@query("dictionary_mentions", f"""
    WITH b AS (SELECT {words('text')} AS w FROM benchmark),
    names AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS name, n FROM b, unnest(range(1, {NAME_WORDS + 1})) AS s(n), unnest(range(1, len(w) - n + 2)) AS r(i)),
    d AS (SELECT doc_id, {words('text')} AS w FROM documents),
    hits AS (SELECT doc_id, i AS a, i + n AS z, name, n FROM (
        SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS name FROM d, unnest(range(1, {NAME_WORDS + 1})) AS s(n), unnest(range(1, len(w) - n + 2)) AS r(i))
        JOIN names USING (name, n)),
    kept AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits)
    SELECT name, n::int AS n_words, count(*) AS mentions, count(DISTINCT doc_id) AS texts FROM kept WHERE reach IS NULL OR z > reach GROUP BY ALL""")
def dictionary_mentions(t):
    """Mentions of names of one to three words; a name inside a longer one that is found there does not count."""
    w = S.words(F.col("text"))
    names = t.benchmark.select(F.explode(F.flatten(F.array(*[S.ngrams(w, n) for n in range(1, NAME_WORDS + 1)]))).alias("name"))
    return name_mentions(name_hits(t.spread("documents", "doc_id"), "doc_id", "text", names, "name"))


@query("tf_idf", COUNTS_SQL + """,
    f AS (SELECT term, count(*) AS df FROM c GROUP BY term)
    SELECT doc_id, term, tf, df, round(tf * ln((SELECT count(*) FROM documents) / df), 6) + 0.0 AS tf_idf FROM c JOIN f USING (term)""")
def tf_idf(t):
    n_texts = t.documents.agg(F.count("*")).scalar()
    scored = X.tf_idf(X.term_counts(t.spread("documents", "doc_id"), "doc_id", "text"), "doc_id", n_texts)
    return scored.select("doc_id", "term", "tf", "df", S.rounded(F.col("tf_idf"), 6).alias("tf_idf"))


@query("class_typical_words", COUNTS_SQL + """,
    n AS (SELECT quality, term, sum(tf) AS n FROM c JOIN labels USING (doc_id) GROUP BY ALL),
    s AS (SELECT quality, term, n, round(n / sum(n) OVER (PARTITION BY quality) - sum(n) OVER (PARTITION BY term) / sum(n) OVER (), 9) AS lift FROM n)
    SELECT quality, term, n::bigint AS n, lift, row_number() OVER (PARTITION BY quality ORDER BY lift DESC, term)::int AS rn FROM s QUALIFY rn <= 20""")
def class_typical_words(t):
    labels = t.labels.select("doc_id", "quality")
    counts = X.term_counts(t.spread("documents", "doc_id").join(labels, "doc_id", "left_semi"), "doc_id", "text")
    return X.class_words(counts, labels, "doc_id", "quality", 20)


CONTRACTIONS = {"is not": "isn't", "do not": "don't", "it is": "it's", "I am": "I'm", "we are": "we're"}
SYNONYMS = {"the": "that", "and": "plus", "le": "ce", "der": "jener", "que": "lo que"}


@query("augment_text", """
    WITH s AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
    r AS (SELECT doc_id, text, unnest(range(((SELECT max(n) FROM s) // n)::bigint)) AS copy FROM documents JOIN labels USING (doc_id) JOIN s USING (quality)),
    w AS (SELECT doc_id, copy, string_split(replace(replace(replace(replace(replace(text, 'is not', 'isn''t'), 'do not', 'don''t'), 'it is', 'it''s'),
                 'I am', 'I''m'), 'we are', 'we''re'), ' ') AS w FROM r),
    m AS (SELECT doc_id, copy, list_transform(w, lambda x: CASE x WHEN 'the' THEN 'that' WHEN 'and' THEN 'plus' WHEN 'le' THEN 'ce' WHEN 'der' THEN 'jener'
                 WHEN 'que' THEN 'lo que' ELSE x END) AS w FROM w)
    SELECT doc_id, copy::int AS copy, md5(array_to_string(list_filter(w, lambda x, i: ('0x' || substr(md5(concat_ws('|', 'aug', doc_id::varchar, copy::varchar,
           (i - 1)::varchar)), 1, 1))::int >= 2), ' ')) AS text_md5 FROM m""")
def augment_text(t):
    """Labelled texts with as many copies per class as the largest class allows."""
    sizes = t.labels.groupBy("quality").agg(F.count("*").alias("n"))
    copies = sizes.withColumn("copies", F.floor(sizes.agg(F.max("n")).scalar() / F.col("n")).cast("int"))
    train = t.spread("documents", "doc_id").select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id")
    copied = join_group_stats(train, copies, ["quality"], "n", ["doc_id"])
    rows = X.numbered_copies(copied, "copies", "copy")
    made = X.augment(rows, "doc_id", "text", "copy", CONTRACTIONS, SYNONYMS, 2, "aug")
    return made.select("doc_id", "copy", F.md5("text").alias("text_md5"))


@query("chunk_documents", r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \n\t]+') AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(greatest(ceil((len(w) - 20) / 80), 1)::bigint)) AS chunk FROM w WHERE len(w) > 0)
    SELECT doc_id, chunk::int AS chunk, len(w[chunk * 80 + 1:chunk * 80 + 100])::int AS n_words, md5(array_to_string(w[chunk * 80 + 1:chunk * 80 + 100], ' ')) AS chunk_md5 FROM c""")
def chunk_documents(t):
    pieces = X.chunks(t.spread("documents", "doc_id"), "doc_id", "text", 100, 20)
    return pieces.select("doc_id", "chunk", "n_words", F.md5("chunk_text").alias("chunk_md5"))


@query("ngram_overlap", f"""
    WITH p AS (SELECT a.conv_id, a.turn, {words('a.text')} AS c, {words('u.text')} AS r FROM conversations a
               JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
    g AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])) AS g, 1 AS c, 0 AS r FROM p
          UNION ALL SELECT conv_id, turn, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])), 0, 1 FROM p),
    k AS (SELECT conv_id, turn, g, sum(c) AS c, sum(r) AS r FROM g GROUP BY ALL),
    s AS (SELECT conv_id, turn, sum(least(c, r)) AS m, sum(c) AS c, sum(r) AS r FROM k GROUP BY ALL)
    SELECT conv_id, turn, m::bigint AS matches, CASE WHEN c = 0 THEN 0 ELSE round(m / c, 6) END AS precision, CASE WHEN r = 0 THEN 0 ELSE round(m / r, 6) END AS recall,
           round(2 * m / (c + r), 6) AS f1 FROM s""")
def ngram_overlap(t):
    """Bigrams of each answer against those of the question right before it."""
    turns = t.spread("conversations", "conv_id", "turn")
    questions = turns.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    pairs = turns.where(F.col("role") == "assistant").join(questions, ["conv_id", "turn"])
    scored = X.ngram_overlap(pairs, ["conv_id", "turn"], "text", "question", 2)
    return scored.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("answer_similarity", f"""
    WITH p AS MATERIALIZED (SELECT a.conv_id, a.turn, 'question' AS kind, {words('a.text')} AS c, {words('u.text')} AS r FROM conversations a
               JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'
        UNION ALL SELECT conv_id, turn, 'reworded', flatten(list_transform(w, lambda x, i: CASE s[i] WHEN '0' THEN []::VARCHAR[] WHEN '1' THEN ['x'] WHEN '2' THEN [x, x] ELSE [x] END)), w
               FROM (SELECT conv_id, turn, w, list_transform(range(1, len(w) + 1), lambda i: substr(md5(concat_ws('|', 'word', conv_id::varchar, turn::varchar, i::varchar)), 1, 1)) AS s
                     FROM (SELECT conv_id, turn, {words('text')} AS w FROM conversations WHERE role = 'assistant'))),
    g AS (SELECT conv_id, turn, kind, k, unnest(list_transform(range(1, len(c) - k + 2), lambda i: array_to_string(c[i:i + k - 1], ' '))) AS g, 1 AS c, 0 AS r FROM p, unnest(range(1, 5)) AS s(k)
          UNION ALL SELECT conv_id, turn, kind, k, unnest(list_transform(range(1, len(r) - k + 2), lambda i: array_to_string(r[i:i + k - 1], ' '))), 0, 1 FROM p, unnest(range(1, 5)) AS s(k)),
    n AS (SELECT conv_id, turn, kind, k, g, sum(c) AS c, sum(r) AS r FROM g GROUP BY ALL),
    m AS (SELECT conv_id, turn, kind, k, sum(least(c, r)) / sum(c) AS p FROM n GROUP BY ALL HAVING sum(c) > 0),
    b AS (SELECT conv_id, turn, kind, count(*) = 4 AND min(p) > 0 AS full_, exp(sum(CASE WHEN p > 0 THEN ln(p) END) / 4) AS mean FROM m GROUP BY ALL),
    t AS (SELECT conv_id, turn, kind, len(c) AS n_c, len(r) AS n_r, list_last(list_reduce(
              list_prepend(list_transform(range(len(r) + 1), lambda i: 0), list_transform(c, lambda x: list_prepend(0, list_transform(r, lambda y: (x = y)::INT)))),
              lambda row, hit: list_reduce(list_transform(range(1, len(row) + 1), lambda j: [j::INT]),
                  lambda done, j: list_append(done, CASE WHEN len(done) = 0 OR j[1] = 1 THEN 0 WHEN hit[j[1]] = 1 THEN row[j[1] - 1] + 1 ELSE greatest(row[j[1]], done[len(done)]) END), []::INT[]))) AS lcs FROM p)
    SELECT conv_id, turn, kind, round(CASE WHEN full_ THEN mean * CASE WHEN n_c >= n_r THEN 1 ELSE exp(1 - n_r / n_c) END ELSE 0 END, 6) + 0.0 AS bleu, lcs::int AS lcs,
           CASE WHEN n_c + n_r = 0 THEN 0 ELSE round(2 * lcs / (n_c + n_r), 6) END AS rouge_l FROM t LEFT JOIN b USING (conv_id, turn, kind)""")
def answer_similarity(t):
    """BLEU and ROUGE-L of each answer against the question right before it, and of a reworded answer against itself."""
    turns = t.spread("conversations", "conv_id", "turn")
    questions = turns.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    answers = turns.where(F.col("role") == "assistant")
    asked = answers.join(questions, ["conv_id", "turn"]).select("conv_id", "turn", F.lit("question").alias("kind"), F.col("text").alias("candidate"), "reference")

    def reworded(word, i):
        digit = F.substring(S.seeded_hash("word", "conv_id", "turn", i + 1), 1, 1)
        return F.when(digit == "0", F.array().cast("array<string>")).when(digit == "1", F.array(F.lit("x"))).when(digit == "2", F.array(word, word)).otherwise(F.array(word))

    copy = F.array_join(F.flatten(F.transform(S.words(F.col("text")), reworded)), " ")
    pairs = asked.unionAll(answers.select("conv_id", "turn", F.lit("reworded").alias("kind"), copy.alias("candidate"), F.col("text").alias("reference")))
    scored = rouge_l(with_bleu(pairs, "candidate", "reference"), "candidate", "reference")
    return scored.select("conv_id", "turn", "kind", S.rounded(F.col("bleu"), 6).alias("bleu"), "lcs", F.round("lcs_f1", 6).alias("rouge_l"))


@query("quality_filter", rf"""
    WITH m AS (SELECT doc_id, {words('text')} AS w, length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(text) AS s FROM documents),
    q AS (SELECT doc_id, len(w) AS n_words, round(s, 6) AS symbol_share, round(len(list_distinct(w)) / len(w), 6) AS distinct_share FROM m)
    SELECT doc_id, n_words::int AS n_words, symbol_share, distinct_share FROM q WHERE n_words >= 20 AND symbol_share <= 0.1 AND distinct_share >= 0.2""")
def quality_filter(t):
    measured = X.quality_measures(t.spread("documents", "doc_id").select("doc_id", "text"), "text").drop("text")
    measured = measured.withColumns({c: F.round(c, 6) for c in ("symbol_share", "distinct_share")})
    return X.quality_filter(measured)


# ---- search and links ------------------------------------------------------------------------


#: The list of searches: words 1 to 3, 4 to 8 and 10 of every benchmark text, 120 on the smallest tables.
SEARCHES = [(1, 3), (4, 5), (10, 1)]
SEARCHES_SQL = f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {words('text')} AS w FROM documents WHERE doc_id IS NOT NULL),
    q AS MATERIALIZED (SELECT item_id * {len(SEARCHES)} + s AS query_id, list_slice({words('text')}, a, a + n - 1) AS w
        FROM benchmark, (VALUES {', '.join(f"({s}, {a}, {n})" for s, (a, n) in enumerate(SEARCHES))}) v(s, a, n))"""


def searches(t):
    w = S.words(F.col("text"))
    asked = F.array(*[F.struct(F.lit(s).alias("s"), F.array_join(F.slice(w, a, n), " ").alias("query")) for s, (a, n) in enumerate(SEARCHES)])
    return t.benchmark.select("item_id", F.inline(asked)).select((F.col("item_id") * len(SEARCHES) + F.col("s")).alias("query_id"), "query")


def kept_index(t) -> SearchIndex:
    """The index of all documents, written as one segment."""
    index = SearchIndex(t.spark, work_path(t.spark, "search"))
    index.add(t.spread("documents", "doc_id"), "doc_id", "text", 0)
    return index


@query("search_index", COUNTS_SQL + """
    SELECT doc_id, sum(tf)::bigint AS hits FROM c WHERE term IN ('the', 'and', 'erth') GROUP BY doc_id HAVING count(*) = 3""")
def search_index(t):
    """Documents with three terms, from counts made for this one search."""
    postings = X.term_counts(t.spread("documents", "doc_id"), "doc_id", "text")
    return X.search(postings, "doc_id", ["the", "and", "Erth"])


@query("ranked_search", SEARCHES_SQL + """,
    c AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    l AS (SELECT doc_id, len(w) AS n_words FROM d WHERE len(w) > 0),
    a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(w) AS term FROM q) GROUP BY ALL),
    s AS (SELECT query_id, doc_id, round(sum(times * ln(1 + ((SELECT count(*) FROM l) - df + 0.5::double) / (df + 0.5::double))
              * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n_words / (SELECT avg(n_words) FROM l))))), 9) AS score
          FROM a JOIN c USING (term) JOIN f USING (term) JOIN l USING (doc_id) GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::int AS rank FROM s QUALIFY rank <= 10""")
def ranked_search(t):
    """The ten best documents of every search of the list, from a kept index."""
    found = kept_index(t).ranked(searches(t), 10)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("phrase_search", SEARCHES_SQL + """,
    h AS (SELECT query_id, doc_id, q.w AS w, d.w[i:i + len(q.w) - 1] AS here FROM q, d, unnest(range(1, len(d.w) - len(q.w) + 2)) AS r(i) WHERE len(q.w) > 0 AND d.w[i] = q.w[1])
    SELECT query_id, doc_id, count(*) AS hits FROM h WHERE here = w GROUP BY ALL""")
def phrase_search(t):
    """Documents that hold the words of a search one after the other."""
    return kept_index(t).phrases(searches(t)).withColumnRenamed("id", "doc_id")


PAGES_SQL = r"""
    WITH p AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path FROM pages),
    l AS (SELECT page_id, host, path, unnest(list_concat(regexp_extract_all(html, 'href="([^"]+)"', 1), regexp_extract_all(html, 'href=''([^'']+)''', 1))) AS href FROM p),
    f AS (SELECT page_id, CASE WHEN regexp_matches(href, '^(https?:)?//') THEN regexp_extract(href, '^(?:https?:)?//([^/?#]+)', 1) ELSE host END AS to_host,
                 CASE WHEN regexp_matches(href, '^(https?:)?//') THEN regexp_extract(href, '^(?:https?:)?//[^/?#]+(/[^?#]*)', 1)
                      WHEN href[1] = '/' THEN regexp_extract(href, '^([^?#]*)', 1)
                      WHEN regexp_matches(href, '^[?]') THEN path
                      ELSE CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)', 1) ELSE '/' END || regexp_extract(href, '^([^?#]*)', 1) END AS raw
          FROM l WHERE regexp_matches(href, '^(https?:)?//') OR NOT regexp_matches(href, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)')),
    e AS (SELECT page_id, to_host, CASE WHEN NOT contains(raw, '/.') THEN raw ELSE
                 array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(raw, '/'), lambda s: [s])),
                     lambda done, x: CASE x[1] WHEN '.' THEN done WHEN '..' THEN done[1:greatest(len(done) - 1, 1)] ELSE list_concat(done, x) END), '/')
                 || CASE WHEN regexp_matches(raw, '/[.][.]?$') THEN '/' ELSE '' END END AS to_path FROM f)"""


@query("link_graph", PAGES_SQL + """
    SELECT page_id, to_host, to_path, count(*) AS n FROM e GROUP BY ALL""")
def link_graph(t):
    return X.link_edges(t.pages).groupBy("page_id", "to_host", "to_path").agg(F.count("*").alias("n"))


@query("backlinks", PAGES_SQL + """
    SELECT p.page_id AS to_page, count(DISTINCT e.page_id) AS linking_pages, count(*) AS links
    FROM e JOIN p ON p.host = to_host AND p.path = to_path AND p.page_id <> e.page_id GROUP BY p.page_id""")
def backlinks(t):
    """Links between the pages, counted at their target."""
    return X.link_report(X.link_edges(t.pages), page_places(t))[0]


def page_places(t):
    return t.pages.select(
        "page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)", 1).alias("path"),
    )


@query("link_orphans", PAGES_SQL + """,
    b AS (SELECT DISTINCT p.page_id FROM e JOIN p ON p.host = to_host AND p.path = to_path AND p.page_id <> e.page_id)
    SELECT page_id, host FROM p WHERE page_id NOT IN (SELECT page_id FROM b)""")
def link_orphans(t):
    """Pages that no other page links to."""
    return X.link_report(X.link_edges(t.pages), page_places(t))[1].select("page_id", "host")


# ---- quality rules ---------------------------------------------------------------------------


@query("dq_rules", r"""
    SELECT 'documents' AS table_name, rule, v::bigint AS violations, n AS n_rows FROM (SELECT count(*) AS n, sum((text IS NULL OR text = '')::int) AS text_present,
        sum((n_chars <> length(text))::int) AS length_matches, sum((lang NOT IN ('en', 'fr', 'de', 'es'))::int) AS known_language FROM documents)
        UNPIVOT (v FOR rule IN (text_present, length_matches, known_language))
    UNION ALL SELECT 'lineitem', rule, v::bigint, n FROM (SELECT count(*) AS n, sum((NOT (l_discount BETWEEN 0 AND 0.1))::int) AS discount_in_range,
        sum((NOT (l_quantity > 0))::int) AS quantity_positive, sum((NOT (l_quantity <= 45))::int) AS quantity_usual FROM lineitem)
        UNPIVOT (v FOR rule IN (discount_in_range, quantity_positive, quantity_usual))
    UNION ALL SELECT 'customer', rule, v::bigint, n FROM (SELECT count(*) AS n, sum((NOT regexp_matches(c_name, '^Customer#[0-9]{9}$'))::int) AS name_format,
        sum((c_acctbal < 0)::int) AS not_in_debt FROM customer) UNPIVOT (v FOR rule IN (name_format, not_in_debt))
    UNION ALL SELECT 'documents', 'has_label', count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)), count(*) FROM documents""")
def dq_rules(t):
    documents = Q.rule_violations(t.documents, "documents", {
        "text_present": F.col("text") != "", "length_matches": F.col("n_chars") == F.length("text"),
        "known_language": F.col("lang").isin("en", "fr", "de", "es"),
    })
    lines = Q.rule_violations(t.lineitem, "lineitem", {
        "discount_in_range": F.col("l_discount").between(0, 0.1), "quantity_positive": F.col("l_quantity") > 0,
        "quantity_usual": F.col("l_quantity") <= 45,
    })
    customers = Q.rule_violations(t.customer, "customer", {
        "name_format": F.col("c_name").rlike("^Customer#[0-9]{9}$"), "not_in_debt": F.col("c_acctbal") >= 0,
    })
    missing = foreign_key_violations(t.documents, "doc_id", t.labels, "doc_id")
    unlabelled = missing.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("violations")).select(
        F.lit("documents").alias("table_name"), F.lit("has_label").alias("rule"), "violations",
        t.documents.agg(F.count("*")).scalar().alias("n_rows"),
    )
    return documents.unionByName(lines).unionByName(customers).unionByName(unlabelled)


# ---- vectors ---------------------------------------------------------------------------------


def first_of_each_label(t):
    """The query vectors: the first vector of every label."""
    firsts = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("query_id"))
    return firsts.join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("query_id", "embedding")


@query("vector_topk", """
    WITH q AS (SELECT min(vec_id) AS query_id FROM embeddings GROUP BY label),
    d AS (SELECT query_id, e.vec_id AS id, list_distance(e.embedding::double[], v.embedding::double[]) AS d FROM q JOIN embeddings v ON v.vec_id = query_id, embeddings e)
    SELECT query_id, id, round(d, 5) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::int AS rank FROM d QUALIFY rank <= 5""")
def vector_topk(t):
    near = V.vector_topk(t.embeddings, first_of_each_label(t), "vec_id", "embedding", 5)
    return near.withColumn("distance", F.round("distance", 5))


#: Every twentieth vector is a query; nine of ten exact neighbours are to be found.
ONE_IN, RECALL = 20, 0.9


def tuned_index(t):
    """The index of all vectors, the queries, and the number of cells that finds enough of a bounded set's neighbours."""
    index = VectorIndex.build(t.embeddings, "vec_id", "embedding", work_path(t.spark, "vectors"))
    queries = t.embeddings.where(F.col("vec_id") % ONE_IN == 0).select("vec_id", "embedding")
    probes, share = index.tune(queries, "vec_id", "embedding", 5, RECALL)
    return index, queries, probes, share


@query("vector_ann")
def vector_ann(t):
    """Approximate nearest five of every twentieth vector, from a kept index of cells; a test measures the recall on all of them."""
    index, queries, probes, _ = tuned_index(t)
    near = index.search(queries, "vec_id", "embedding", 5, probes)
    return near.select("query_id", "id", F.round("distance", 5).alias("distance"), "rank")


@query("vector_ann_recall", f"""
    SELECT vec_id AS query_id, true AS itself_first, true AS reached FROM embeddings WHERE vec_id % {ONE_IN} = 0 AND embedding IS NOT NULL""")
def vector_ann_recall(t):
    """For each query whether a vector at distance 0 comes first, and whether the search as a whole finds nine of ten exact neighbours, all
    queries counted."""
    index, queries, probes, _ = tuned_index(t)
    near = saved(index.search(queries, "vec_id", "embedding", 5, probes), "near")
    asked = queries.where("embedding IS NOT NULL").withColumnRenamed("vec_id", "query_id")
    exact = V.vector_topk(t.embeddings, asked, "vec_id", "embedding", 5).select("query_id", "id", F.lit(1).alias("exact"))
    hit, wanted = exact.join(near.select("query_id", "id", F.lit(1).alias("near")), ["query_id", "id"], "left").agg(F.count("near"), F.count("*")).first()
    first = near.where("rank = 1").select("query_id", (F.col("distance") < 1e-9).alias("itself_first"))
    return asked.select("query_id").join(first, "query_id", "left").withColumn("reached", F.lit(hit >= RECALL * wanted))


@query("novelty_similarity", """
    WITH p AS (SELECT a.vec_id, a.label, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS s
               FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id)
    SELECT vec_id, label, count(s) AS earlier, round(avg(s), 5) + 0.0 AS similarity FROM p GROUP BY ALL""")
def novelty_similarity(t):
    block = range_block(t.embeddings, "vec_id", max(1, min(65_536, t.embeddings.count() // 4096)))
    scored = V.mean_similarity_to_earlier(t.embeddings, "label", "vec_id", "embedding", 64, block)
    return scored.withColumn("similarity", S.rounded(F.col("similarity"), 5))


# ---- token costs -----------------------------------------------------------------------------

CALLS_SQL = f"""
    WITH c AS (SELECT conv_id, turn, role, {tokens('text')} AS tokens FROM conversations),
    n AS (SELECT *, coalesce(sum((role = 'assistant')::int) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS call FROM c),
    g AS (SELECT conv_id, call, sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END) AS fresh, sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END) AS output
          FROM n GROUP BY ALL HAVING bool_or(role = 'assistant')),
    k AS (SELECT *, coalesce(sum(fresh + output) OVER (PARTITION BY conv_id ORDER BY call ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cached FROM g)"""


def calls(t):
    turns = t.conversations.select("conv_id", "turn", "role", S.estimated_tokens(F.col("text")).alias("tokens"))
    return B.chat_calls(turns, "conv_id", "turn", "role", "tokens")


@query("chat_billing", CALLS_SQL + """
    SELECT conv_id, call::bigint AS call, fresh::bigint AS fresh, cached::bigint AS cached, output::bigint AS output,
           round((fresh * 5.0::double + cached * 0.5::double + output * 30.0::double) / 1e6::double, 7) AS cost FROM k""")
def chat_billing(t):
    return B.chat_billing(calls(t)).withColumn("cost", F.round("cost", 7))


@query("chat_billing_comparison", CALLS_SQL + """
    SELECT conv_id, count(*) AS calls, round((sum(fresh) * 5.0::double + sum(cached) * 0.5::double + sum(output) * 30.0::double) / 1e6::double, 7) AS cost,
           round((sum(fresh + cached) * 5.0::double + sum(output) * 30.0::double) / 1e6::double, 7) AS cost_uncached,
           round((sum(fresh) * 5.0::double + sum(output) * 30.0::double) / 1e6::double, 7) AS cost_one_call FROM k GROUP BY conv_id""")
def chat_billing_comparison(t):
    compared = B.one_call_comparison(calls(t), "conv_id")
    return compared.withColumns({c: F.round(c, 7) for c in ("cost", "cost_uncached", "cost_one_call")})


@query("blended_and_tiered_price", CALLS_SQL + """,
    s AS (SELECT conv_id, sum(fresh + cached) AS fresh, sum(output) AS output FROM k GROUP BY conv_id),
    p AS (SELECT *, (fresh * 10.0::double + output * 45.0::double) / 1e6::double AS high, (fresh * 5.0::double + output * 30.0::double) / 1e6::double AS low FROM s),
    steps AS (SELECT *, CASE WHEN fresh > 272000 THEN high ELSE low END AS cost, CASE WHEN fresh > 2720 THEN high ELSE low END AS low_step FROM p)
    SELECT conv_id, round(cost, 7) AS cost, round(low_step, 7) AS cost_low_step, round(cost * 0.5::double, 7) AS batch_cost, round((fresh + output) * ((7 * 0.5::double + 2 * 5 + 1 * 30) / 10) / 1e6::double, 9) AS blended_cost FROM steps""")
def blended_and_tiered_price(t):
    """Prices per conversation without a cache; the step to the high price is at 272,000 input tokens
    and, because these conversations are short, once more at 2,720."""
    sums = calls(t).groupBy("conv_id").agg(F.sum(F.col("fresh") + F.col("cached")).alias("fresh"), F.sum("output").alias("output"))
    fresh, output = F.col("fresh"), F.col("output")
    return sums.select(
        "conv_id", F.round(B.tiered_cost(fresh, output), 7).alias("cost"),
        F.round(B.tiered_cost(fresh, output, threshold=2720), 7).alias("cost_low_step"),
        F.round(B.tiered_cost(fresh, output, batch=True), 7).alias("batch_cost"),
        F.round((fresh + output) * F.lit(B.blended_price(B.Price())) / 1e6, 9).alias("blended_cost"),
    )


@query("cache_savings", f"""
    WITH g AS (SELECT text, count(*) AS n, max({tokens('text')}) AS tok FROM documents GROUP BY text)
    SELECT sum(n)::bigint AS requests, sum(n - 1)::bigint AS repeats, round(sum(n - 1) / sum(n), 6) AS repeat_share, round(sum((n - 1) * tok) * 5.0::double / 1e6::double, 6) AS saved FROM g""")
def cache_savings(t):
    cached = B.cache_savings(t.spread("documents", "doc_id"), "text", S.estimated_tokens(F.col("text")), 5.0)
    return cached.withColumns({c: F.round(c, 6) for c in ("repeat_share", "saved")})


@query("image_tokens", """
    SELECT p_partkey, (85 + 170 * ceil(p_size * 64 / 512) * ceil(p_retailprice / 512))::bigint AS high, 85::bigint AS low FROM part""")
def image_tokens(t):
    width, height = F.col("p_size") * 64, F.col("p_retailprice")
    return t.part.select("p_partkey", S.image_tokens(width, height).alias("high"), S.image_tokens(width, height, "low").alias("low"))


# US dollars per million tokens of three published prompt-cache price models.
CACHE_PLANS = [("read_discount", 0.14, 0.14, 0.014, 0.0), ("paid_write", 3.0, 3.75, 0.3, 0.0), ("paid_storage", 3.5, 3.5, 0.0, 4.5)]


@query("cache_break_even", CALLS_SQL + """,
    r AS (SELECT conv_id, count(*) - 1 AS reads FROM k GROUP BY conv_id),
    p(plan, regular, write, read, storage) AS (VALUES ('read_discount', 0.14::double, 0.14::double, 0.014::double, 0.0::double), ('paid_write', 3.0, 3.75, 0.3, 0.0), ('paid_storage', 3.5, 3.5, 0.0, 4.5)),
    b AS (SELECT plan, greatest(ceil(round((write + storage - regular) / (regular - read), 9)), 0)::bigint AS break_even FROM p)
    SELECT plan, break_even, (SELECT count(*) FROM r) AS conversations, (SELECT count(*) FROM r WHERE reads >= break_even) AS worth_caching FROM b""")
def cache_break_even(t):
    """Conversations are counted per number of reads, and those few counts meet the price plans."""
    plans = inline_table(t.spark, CACHE_PLANS, "plan STRING, regular DOUBLE, write DOUBLE, read DOUBLE, storage DOUBLE")
    needed = B.break_even_reads(*[F.col(c) for c in ("regular", "write", "read", "storage")])
    reads = calls(t).groupBy("conv_id").agg((F.count("*") - 1).alias("reads"))
    thresholds = plans.select("plan", needed.alias("break_even"))
    tags = F.array(*[F.lit(p[0]) for p in CACHE_PLANS])
    counts = reads.groupBy("reads").agg(F.count("*").alias("n")).select("reads", "n", F.explode(tags).alias("plan"))
    return counts.join(F.broadcast(thresholds), "plan").groupBy("plan", "break_even").agg(
        F.sum("n").alias("conversations"),
        F.coalesce(F.sum(F.when(F.col("reads") >= F.col("break_even"), F.col("n"))), F.lit(0)).alias("worth_caching"),
    )
