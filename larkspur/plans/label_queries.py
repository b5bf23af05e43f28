"""Labelled-text queries: sampling, splits, noise, answers, demos, review."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Window, functions as F

from larkspur.functions import scalar as S
from larkspur.operators import answers as N, labels as L
from larkspur.operators.folds import contradicted, out_of_fold
from larkspur.plans.registry import query
from larkspur.plans.sqltext import score, shuffle, tokens
from larkspur.session import saved

# ---- structured answers ----------------------------------------------------------------------

# Labels of the derived answers; the last ones are outside the allowed set.
RAW_TOPICS = [*N.TOPICS, "WEATHER", "LOCAL"]
RAW_SENTIMENTS = ["POSITIVE", "NEUTRAL", "NEGATIVE"]
RAW_ENTITIES = [*N.ENTITY_LABELS, "MONEY"]

ANSWERS_SQL = f"""
    WITH raw AS (SELECT doc_id, {score('fault', 'doc_id')} % 20 AS fault,
        CASE WHEN {score('none', 'doc_id')} % 11 = 0 THEN '[]' ELSE '["' || ({RAW_TOPICS!r})[{score('topic1', 'doc_id')} % 10 + 1] || '","'
            || ({RAW_TOPICS!r})[{score('topic2', 'doc_id')} % 10 + 1] || '"]' END AS topics,
        ({RAW_SENTIMENTS!r})[{score('mood', 'doc_id')} % 3 + 1] AS mood,
        CASE WHEN {score('names', 'doc_id')} % 7 = 0 THEN 'null' ELSE '[{{"text":"' || source || '","label":"'
            || ({RAW_ENTITIES!r})[{score('names', 'doc_id')} % 6 + 1] || '"}},{{"text":"' || lang || '","label":"LOCATION"}}]' END AS names
        FROM documents),
    built AS (SELECT doc_id, '{{"topics":' || CASE WHEN fault = 3 THEN '"ARTS"' ELSE topics END
        || CASE WHEN fault = 2 THEN '' ELSE ',"sentiment":"' || CASE WHEN fault = 1 THEN 'MIXED' ELSE mood END || '"' END
        || ',"named_entities":' || names || '}}' AS j, fault FROM raw),
    answers AS (SELECT doc_id, CASE WHEN fault = 0 THEN substr(j, 1, length(j) - 5) ELSE j END AS answer FROM built),
    checked AS (SELECT *, NOT json_valid(answer) AS parse_error FROM answers),
    parsed AS (SELECT doc_id, parse_error,
        CASE WHEN parse_error THEN NULL WHEN json_type(answer, '$.topics') = 'ARRAY' THEN from_json(json_extract(answer, '$.topics'), '["VARCHAR"]') END AS topics,
        CASE WHEN parse_error THEN NULL ELSE json_extract_string(answer, '$.sentiment') END AS sentiment,
        CASE WHEN parse_error THEN NULL WHEN json_type(answer, '$.named_entities') = 'ARRAY'
             THEN from_json(json_extract(answer, '$.named_entities'), '[{{"text":"VARCHAR","label":"VARCHAR"}}]') END AS entities FROM checked),
    fixed AS (SELECT doc_id, parse_error, list_filter(topics, lambda x: list_contains({N.TOPICS!r}, x)) AS topics, sentiment,
        list_filter(entities, lambda e: list_contains({N.ENTITY_LABELS!r}, e.label)) AS entities FROM parsed)"""
_VALID = f"""(topics IS NOT NULL AND len(list_filter(topics, lambda x: NOT list_contains({N.TOPICS!r}, x))) = 0
        AND coalesce(list_contains({N.SENTIMENTS!r}, sentiment), false) AND entities IS NOT NULL
        AND len(list_filter(entities, lambda e: NOT list_contains({N.ENTITY_LABELS!r}, e.label))) = 0)"""


def model_answers(t):
    """JSON answers derived from the documents: some cut short, some outside the schema."""
    def pick(values, seed, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), S.seeded_score(seed, "doc_id") % n + 1)

    fault = S.seeded_score("fault", "doc_id") % 20
    names = S.seeded_score("names", "doc_id")
    topics = F.when(S.seeded_score("none", "doc_id") % 11 == 0, "[]").otherwise(F.concat(
        F.lit('["'), pick(RAW_TOPICS, "topic1", 10), F.lit('","'), pick(RAW_TOPICS, "topic2", 10), F.lit('"]')
    ))
    entities = F.when(names % 7 == 0, "null").otherwise(F.concat(
        F.lit('[{"text":"'), "source", F.lit('","label":"'), pick(RAW_ENTITIES, "names", 6),
        F.lit('"},{"text":"'), "lang", F.lit('","label":"LOCATION"}]'),
    ))
    mood = F.when(fault == 1, "MIXED").otherwise(pick(RAW_SENTIMENTS, "mood", 3))
    text = F.concat(
        F.lit('{"topics":'), F.when(fault == 3, '"ARTS"').otherwise(topics),
        F.when(fault == 2, "").otherwise(F.concat(F.lit(',"sentiment":"'), mood, F.lit('"'))),
        F.lit(',"named_entities":'), entities, F.lit("}"),
    )
    cut = F.when(fault == 0, F.expr("substr(j, 1, length(j) - 5)")).otherwise(F.col("j"))
    return t.documents.select("doc_id", "lang", "source", text.alias("j")).withColumn("answer", cut).drop("j")


def usable_answers(t):
    return N.split_valid(N.repair_answers(N.parse_answers(model_answers(t), "answer")))[0]


@query("parse_validate_json", ANSWERS_SQL + f"""
    SELECT doc_id, parse_error, NOT parse_error AND NOT {_VALID} AS validation_error FROM parsed""")
def parse_validate_json(t):
    return N.parse_answers(model_answers(t), "answer").select("doc_id", "parse_error", "validation_error")


@query("repair_labels", ANSWERS_SQL + f"""
    SELECT doc_id, NOT parse_error AND NOT {_VALID} AS validation_error, array_to_string(topics, ',') AS topics,
           array_to_string(list_transform(entities, lambda e: e.text || '/' || e.label), ',') AS entities FROM fixed""")
def repair_labels(t):
    fixed = N.repair_answers(N.parse_answers(model_answers(t), "answer"))
    names = F.transform("entities", lambda e: F.concat_ws("/", e["text"], e["label"]))
    return fixed.select(
        "doc_id", "validation_error", F.array_join("topics", ",").alias("topics"), F.array_join(names, ",").alias("entities")
    )


@query("grouped_histogram", ANSWERS_SQL + f""",
    u AS (SELECT sentiment, unnest(topics) AS topic FROM fixed WHERE NOT parse_error AND {_VALID})
    SELECT topic, sentiment, count(*) AS n FROM u GROUP BY ALL""")
def grouped_histogram(t):
    topics = usable_answers(t).select("sentiment", F.explode_outer("topics").alias("topic"))
    return topics.na.drop().groupBy("topic", "sentiment").agg(F.count("*").alias("n"))


@query("entity_counts", ANSWERS_SQL + f""",
    e AS (SELECT unnest(entities) AS e FROM fixed WHERE NOT parse_error AND {_VALID}),
    c AS (SELECT e.text AS text, e.label AS label, count(*) AS n FROM e GROUP BY ALL)
    SELECT text, label, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, text NULLS FIRST)::int AS rank FROM c QUALIFY rank <= 5""")
def entity_counts(t):
    return N.entity_counts(usable_answers(t))


@query("aspect_sentiment_report", ANSWERS_SQL + f""",
    u AS (SELECT sentiment, unnest(topics) AS topic FROM fixed WHERE NOT parse_error AND {_VALID})
    SELECT topic, count(*) AS mentions, count(*) FILTER (sentiment = 'POSITIVE') AS positive, count(*) FILTER (sentiment = 'NEGATIVE') AS negative,
           count(*) FILTER (sentiment = 'NEUTRAL') AS neutral, round(count(*) FILTER (sentiment = 'POSITIVE') / count(*), 6) AS positive_share
    FROM u GROUP BY topic""")
def aspect_sentiment_report(t):
    aspects = usable_answers(t).select("sentiment", F.explode("topics").alias("topic"))
    return N.polarity_report(aspects, "topic", "sentiment").withColumn("positive_share", F.round("positive_share", 6))


@query("coerce_prediction", f"""
    WITH p AS (SELECT doc_id, quality, {score('say', 'doc_id')} % 8 AS s FROM labels),
    r AS (SELECT doc_id, quality, CASE WHEN s = 0 THEN 'label: ' || quality::varchar WHEN s = 1 THEN '' ELSE quality::varchar END AS raw FROM p)
    SELECT coalesce(try_cast(raw AS INTEGER), 0) AS predicted, quality, count(*) AS n,
           count(*) FILTER (try_cast(raw AS INTEGER) IS NULL) AS errors FROM r GROUP BY ALL""")
def coerce_prediction(t):
    s = S.seeded_score("say", "doc_id") % 8
    label = F.col("quality").cast("string")
    raw = F.when(s == 0, F.concat(F.lit("label: "), label)).when(s == 1, "").otherwise(label)
    said = t.labels.select("quality", raw.alias("raw"))
    return said.groupBy(N.coerce_int(F.col("raw")).alias("predicted"), "quality").agg(
        F.count("*").alias("n"), F.count_if(F.col("raw").try_cast("int").isNull()).alias("errors")
    )


# ---- sampling and splitting ------------------------------------------------------------------


def ranked_sql(seed: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {shuffle(seed, 'doc_id')}, doc_id) AS rn,
        count(*) OVER (PARTITION BY quality) AS n, count(*) OVER () AS total FROM labels"""


@query("stratified_subsample", f"WITH r AS ({ranked_sql('42')}) SELECT doc_id, quality FROM r WHERE rn <= 40")
def stratified_subsample(t):
    return L.stratified_subsample(t.labels, "quality", "doc_id", 80, "42").select("doc_id", "quality")


@query("balance_classes", f"""
    WITH r AS ({ranked_sql('11')}) SELECT doc_id, quality FROM r WHERE rn <= (SELECT min(n) FROM r)""")
def balance_classes(t):
    return L.balance_classes(t.labels, "quality", "doc_id", "11").select("doc_id", "quality")


@query("stratified_split", f"""
    WITH r AS ({ranked_sql('12')})
    SELECT doc_id, quality, CASE WHEN rn <= floor(0.6::double * n) THEN 'train' WHEN rn <= floor(0.6::double * n) + floor(0.2::double * n) THEN 'test'
           ELSE 'valid' END AS split FROM r""")
def stratified_split(t):
    return L.stratified_split(t.labels, "quality", "doc_id", "12").select("doc_id", "quality", "split")


@query("label_noise", f"""
    WITH r AS ({ranked_sql('13')}), f AS (SELECT *, rn <= floor(floor(total * 0.1::double) / 2) AS flipped FROM r)
    SELECT doc_id, quality, CASE WHEN flipped THEN 1 - quality ELSE quality END AS noisy, flipped FROM f""")
def label_noise(t):
    return L.label_noise(t.labels, "quality", "doc_id", 0.1, "13").select("doc_id", "quality", "noisy", "flipped")


GRID_SIZES, GRID_NOISES = [40, 80, 160, 320], [0.0, 0.05, 0.1, 0.25]


@query("noise_size_grid", f"""
    WITH r AS ({ranked_sql('14')}), g AS (SELECT * FROM (VALUES (40), (80), (160), (320)) s(size), (VALUES (0.0::double), (0.05), (0.1), (0.25)) z(noise)),
    c AS (SELECT size, noise, quality, rn, count(*) OVER (PARTITION BY size, noise) AS cell_n FROM r JOIN g ON rn <= size // 2),
    f AS (SELECT *, rn <= floor(floor(cell_n * noise) / 2) AS flipped FROM c)
    SELECT size, noise, count(*) AS n, count(*) FILTER (flipped) AS flipped, sum(CASE WHEN flipped THEN 1 - quality ELSE quality END)::bigint AS positives
    FROM f GROUP BY ALL""")
def noise_size_grid(t):
    cells = L.noise_size_grid(t.labels, "quality", "doc_id", GRID_SIZES, GRID_NOISES, "14")
    return cells.groupBy("size", "noise").agg(
        F.count("*").alias("n"), F.count_if("flipped").alias("flipped"), F.sum("noisy").alias("positives")
    )


# ---- chats, demos, pairs ---------------------------------------------------------------------


@query("to_chat_format", """
    SELECT doc_id, md5('{"dialogue":[{"from":"human","value":' || to_json(text) || '},{"from":"gpt","value":"' || quality::varchar || '"}]}') AS chat_md5,
           'user,assistant' AS roles, length(text) AS human_chars FROM documents JOIN labels USING (doc_id)""")
def to_chat_format(t):
    chats = t.documents.join(t.labels, "doc_id").select("doc_id", L.to_chat(F.col("text"), F.col("quality")).alias("chat"))
    back = chats.withColumn("turns", L.from_chat(F.col("chat")))
    return back.select(
        "doc_id", F.md5("chat").alias("chat_md5"), F.array_join(F.col("turns")["role"], ",").alias("roles"),
        F.length(F.col("turns")[0]["content"]).cast("long").alias("human_chars"),
    )


@query("few_shot_demos", f"""
    WITH p AS (SELECT doc_id, text, quality, row_number() OVER (PARTITION BY quality ORDER BY {shuffle('demo', 'doc_id')}, doc_id) AS rn
               FROM documents JOIN labels USING (doc_id)),
    d AS (SELECT string_agg('Text: ' || text || E'\\nLabel: ' || quality::varchar || E'\\n\\n', '' ORDER BY quality, rn) AS shots FROM p WHERE rn <= 2)
    SELECT doc_id, md5(shots || 'Text: ' || text || E'\\nLabel:') AS prompt_md5 FROM documents, d""")
def few_shot_demos(t):
    pool = t.documents.join(t.labels, "doc_id")
    prompts = L.few_shot_prompts(t.documents, pool, "doc_id", "text", "quality", 2, "demo")
    return prompts.select("doc_id", F.md5("prompt").alias("prompt_md5"))


@query("preference_pairs", f"""
    WITH a AS (SELECT conv_id, turn, {score('rate', 'conv_id', 'turn')} AS s FROM conversations WHERE role = 'assistant')
    SELECT conv_id, arg_max(turn, (s, -turn)) AS preferred, arg_min(turn, (s, turn)) AS rejected FROM a GROUP BY conv_id HAVING max(s) > min(s)""")
def preference_pairs(t):
    answers = t.conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", S.seeded_score("rate", "conv_id", "turn").alias("score")
    )
    return L.preference_pairs(answers, "conv_id", "turn", "score")


@query("preference_records", f"""
    WITH a AS (SELECT conv_id, turn, text, {score('rate', 'conv_id', 'turn')} AS s FROM conversations WHERE role = 'assistant'),
    p AS (SELECT conv_id, arg_max(text, (s, -turn)) AS good, arg_min(text, (s, turn)) AS bad FROM a GROUP BY conv_id HAVING max(s) > min(s)),
    q AS (SELECT conv_id, arg_min(text, turn) AS ask FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, md5('{{"input":{{"messages":[{{"role":"user","content":' || to_json(ask) || '}}]}},"preferred_output":[{{"role":"assistant","content":'
           || to_json(good) || '}}],"non_preferred_output":[{{"role":"assistant","content":' || to_json(bad) || '}}]}}') AS record_md5
    FROM p JOIN q USING (conv_id)""")
def preference_records(t):
    """The pairs with their texts as JSON records; texts join by (conversation, turn)."""
    pairs = preference_pairs(t)
    texts = t.conversations.select("conv_id", "turn", "text")
    ask = t.conversations.where(F.col("role") == "user").groupBy("conv_id").agg(F.min("turn").alias("asked"))

    def with_text(df, turn, out):
        return df.join(texts.select("conv_id", F.col("turn").alias(turn), F.col("text").alias(out)), ["conv_id", turn])

    full = pairs.join(ask, "conv_id")
    for turn, out in (("asked", "ask"), ("preferred", "good"), ("rejected", "bad")):
        full = with_text(full, turn, out)

    def said(role, text):
        return F.array(F.struct(F.lit(role).alias("role"), F.col(text).alias("content")))

    record = F.to_json(F.struct(
        F.struct(said("user", "ask").alias("messages")).alias("input"), said("assistant", "good").alias("preferred_output"),
        said("assistant", "bad").alias("non_preferred_output"),
    ))
    return full.select("conv_id", F.md5(record).alias("record_md5"))


# ---- review queues ---------------------------------------------------------------------------


@query("uncertainty_queue", f"""
    WITH p AS (SELECT doc_id, {score('prob', 'doc_id')} / 65535 AS p FROM labels)
    SELECT doc_id, round(CASE WHEN p IN (0, 1) THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END, 6) + 0.0 AS entropy, round(abs(2 * p - 1), 9) AS margin
    FROM p ORDER BY abs(2 * p - 1), doc_id LIMIT 100""")
def uncertainty_queue(t):
    scored = t.labels.select("doc_id", (S.seeded_score("prob", "doc_id") / 65535.0).alias("p"))
    queue = L.uncertainty_queue(scored, "doc_id", "p", 100)
    return queue.select("doc_id", S.rounded(F.col("entropy"), 6).alias("entropy"), F.round("margin", 9).alias("margin"))


@query("suspect_labels", f"""
    WITH p AS (SELECT doc_id, quality, {score('prob', 'doc_id')} / 65535 AS p FROM labels)
    SELECT doc_id, quality, (p >= 0.5)::int AS predicted, round(greatest(p, 1 - p), 9) AS confidence FROM p WHERE (p >= 0.5)::int <> quality""")
def suspect_labels(t):
    scored = t.labels.select("doc_id", "quality", (S.seeded_score("prob", "doc_id") / 65535.0).alias("p"))
    return L.suspect_labels(scored, "doc_id", "quality", "p").select(
        "doc_id", "quality", "predicted", F.round("confidence", 9).alias("confidence")
    )


@query("out_of_fold_labels")
def out_of_fold_labels(t):
    """Labels that are contradicted by a model which has not seen them; planted wrong labels are looked for in a test."""
    rows = t.spread("documents", "doc_id").select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id")
    scored = saved(out_of_fold(rows, "doc_id", "quality", "text"), "scored")
    return contradicted(scored, "quality").select("doc_id", "quality", "predicted", "fold", F.round("confidence", 6).alias("confidence"))


@query("natural_labels", """
    SELECT CASE WHEN value >= 40 THEN 'positive' WHEN value < 5 THEN 'negative' ELSE 'neutral' END AS label, event_type, count(*) AS n
    FROM events GROUP BY ALL""")
def natural_labels(t):
    label = F.when(F.col("value") >= 40, "positive").when(F.col("value") < 5, "negative").otherwise("neutral")
    return t.events.groupBy(label.alias("label"), "event_type").agg(F.count("*").alias("n"))


@query("routing_cascade", rf"""
    WITH d AS (SELECT doc_id, {score('conf', 'doc_id')} / 65535 AS conf, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') AS mail, lang FROM documents)
    SELECT CASE WHEN mail THEN 'rule' WHEN conf >= 0.7 THEN 'model' ELSE 'fallback' END AS tier,
           CASE WHEN mail THEN 'contact' WHEN conf >= 0.7 THEN 'text-' || lang ELSE 'review' END AS answer, count(*) AS n FROM d GROUP BY ALL""")
def routing_cascade(t):
    tiers = N.route(
        F.when(F.size(S.emails(F.col("text"))) > 0, "contact"), F.concat(F.lit("text-"), "lang"),
        S.seeded_score("conf", "doc_id") / 65535.0, F.lit("review"),
    )
    return t.spread("documents", "doc_id").select(*[c.alias(n) for n, c in tiers.items()]).groupBy("tier", "answer").agg(F.count("*").alias("n"))


@query("logreg_text", f"""
    WITH r AS ({ranked_sql('12')}),
    s AS (SELECT quality, CASE WHEN rn <= floor(0.6::double * n) THEN 'train' WHEN rn <= floor(0.6::double * n) + floor(0.2::double * n) THEN 'test'
          ELSE 'valid' END AS split FROM r JOIN documents USING (doc_id))
    SELECT split, quality, count(*) AS n, true AS as_good_as_majority FROM s WHERE split <> 'train' GROUP BY split, quality""")
def logreg_text(t):
    """Logistic regression on hashed tf-idf words; rows of each class in the held-out parts of a split, and whether
    the model is right there at least as often as the answer that is always the most frequent class."""
    counts = logreg_confusion(t)
    n, right = F.sum("n").alias("n"), F.sum(F.when(F.col("quality") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right")
    classes = counts.groupBy("split", "quality").agg(n, right)
    part = Window.partitionBy("split")
    return classes.select("split", "quality", "n", (F.sum("right").over(part) >= F.max("n").over(part)).alias("as_good_as_majority"))


def logreg_confusion(t):
    """(split, quality, predicted, n) outside the train part."""
    rows = L.stratified_split(t.labels, "quality", "doc_id", "12").select("doc_id", "quality", "split")
    data = t.spread("documents", "doc_id").select("doc_id", S.words(F.col("text")).alias("words")).join(rows, "doc_id").withColumn(
        "label", F.col("quality").cast("double")
    )
    stages = [
        HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=20, regParam=0.1),
    ]
    model = Pipeline(stages=stages).fit(data.where(F.col("split") == "train"))
    scored = model.transform(data.where(F.col("split") != "train"))
    return scored.groupBy("split", "quality", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query("results_leaderboard", """
    WITH r AS (SELECT s_name, n_name, s_acctbal, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT replace(s_name, 'Supplier#', '') AS name, CASE WHEN contains(n_name, '_1') THEN 'Manual' ELSE 'Automatic' END AS method,
           CASE WHEN s_nationkey = 0 THEN '0' ELSE s_nationkey::varchar || ' + 1' END AS demos, CASE WHEN s_acctbal > 0 THEN 'yes' ELSE 'no' END AS in_credit,
           round(s_acctbal / 100, 2) + 0.0 AS score FROM r ORDER BY score DESC, name""")
def results_leaderboard(t):
    runs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_nationkey").cast("string")
    return runs.select(
        F.replace(F.col("s_name"), F.lit("Supplier#"), F.lit("")).alias("name"),
        F.when(F.contains("n_name", F.lit("_1")), "Manual").otherwise("Automatic").alias("method"),
        F.when(F.col("s_nationkey") == 0, key).otherwise(F.concat(key, F.lit(" + 1"))).alias("demos"),
        F.when(F.col("s_acctbal") > 0, "yes").otherwise("no").alias("in_credit"),
        S.rounded(F.col("s_acctbal") / 100, 2).alias("score"),
    ).orderBy(F.desc("score"), "name")
