"""Queries over answers, responses, statistics, samples, names and texts, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import answers as A
from quillon.functions import names as N
from quillon.operators import abstraction as B
from quillon.operators import benchmark as K
from quillon.operators import questions as U
from quillon.operators import reports as P
from quillon.operators import scoring as S
from quillon.operators import stats as T
from quillon.operators import tags as G
from quillon.operators import verbalize as V
from quillon.operators.star import core_graph, kg_sql
from quillon.sources import text as X

QUERIES: dict = {}
SQL: dict[str, str] = {}
SAMPLES = 200


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- responses: assistant turns with a made-up head --------------------------------------------------------------------

_RESPONSES = """responses AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 4 = 3 THEN 'MC' ELSE 'BIN' END AS answer_type, CASE conv_id % 5
  WHEN 0 THEN 'ANSWER: TRUE' || chr(10) || 'CONFIDENCE: 0.9' || chr(10) || 'REASONING_STEPS: 3' || chr(10) || 'REASONING: because ' || text
  WHEN 1 THEN 'Answer: <http://x.org/o#Foo>, ns1:bar_1840, rdf:type' || chr(10) || 'confidence: 7'
  WHEN 2 THEN '  It is false. ' || text WHEN 3 THEN '[ERROR] ' || text
  ELSE 'ANSWER: ' || text || chr(10) || 'Confidence: .25' || chr(10) || 'REASONING_STEPS: 42' END AS response,
  CASE WHEN turn % 3 = 0 THEN 'TRUE' ELSE 'foo_1840; Bar (x), ' || substr(text, 1, 12) END AS expected, text FROM conversations WHERE role = 'assistant')"""


def responses(spark, d) -> DataFrame:
    c = read(spark, d, "conversations").where("role = 'assistant'")
    text, k = F.col("text"), F.col("conv_id") % 5
    response = (
        F.when(k == 0, F.concat(F.lit("ANSWER: TRUE\nCONFIDENCE: 0.9\nREASONING_STEPS: 3\nREASONING: because "), text))
        .when(k == 1, F.lit("Answer: <http://x.org/o#Foo>, ns1:bar_1840, rdf:type\nconfidence: 7"))
        .when(k == 2, F.concat(F.lit("  It is false. "), text))
        .when(k == 3, F.concat(F.lit("[ERROR] "), text))
        .otherwise(F.concat(F.lit("ANSWER: "), text, F.lit("\nConfidence: .25\nREASONING_STEPS: 42")))
    )
    expected = F.when(F.col("turn") % 3 == 0, "TRUE").otherwise(F.concat(F.lit("foo_1840; Bar (x), "), F.substring(text, 1, 12)))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("turn") % 4 == 3, "MC").otherwise("BIN").alias("answer_type"), response.alias("response"), expected.alias("expected"), "text")


_ANSWER = "trim(regexp_extract(response, '(?i)ANSWER:\\s*([^\\n\\r]+)', 1))"
_FINAL = f"""(CASE WHEN contains(response, '[ERROR]') THEN 'ERROR' WHEN answer_type = 'MC' THEN
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '<[^#]*#([^>]+)>', '\\1', 'g'), '[^#]*#([^,\\s]+)', '\\1', 'g'), 'ns1:([^,\\s]+)', '\\1', 'g'), 'rdf:([^,\\s]+)', '\\1', 'g'), 'rdfs:([^,\\s]+)', '\\1', 'g'), 'owl:([^,\\s]+)', '\\1', 'g'))
  WHEN contains(lower(a), 'true') THEN 'TRUE' WHEN contains(lower(a), 'false') THEN 'FALSE' ELSE a END)"""
_PARSED = f"{_RESPONSES}, first AS (SELECT *, CASE WHEN {_ANSWER} <> '' THEN {_ANSWER} ELSE trim(string_split(ltrim(response), chr(10))[1]) END AS a FROM responses), parsed AS (SELECT *, {_FINAL} AS final FROM first)"


@query("parse_answer", f"WITH {_PARSED} SELECT id, final AS final_answer FROM parsed")
def parse_answer(spark, d):
    return responses(spark, d).select("id", A.final_answer(F.col("response"), F.col("answer_type")).alias("final_answer"))


_CONF = "least(1.0, coalesce(try_cast(regexp_extract(response, '(?i)CONFIDENCE:\\s*([0-9]*\\.?[0-9]+)', 1) AS DOUBLE), 0.5))"


@query("parse_confidence", f"WITH {_RESPONSES} SELECT id, CAST({_CONF} AS DOUBLE) AS confidence FROM responses")
def parse_confidence(spark, d):
    return responses(spark, d).select("id", A.confidence(F.col("response")).alias("confidence"))


@query("parse_steps", f"WITH {_RESPONSES} SELECT id, greatest(1, least(10, coalesce(try_cast(regexp_extract(response, '(?i)REASONING_STEPS:\\s*([0-9]+)', 1) AS INTEGER), 1))) AS steps FROM responses")
def parse_steps(spark, d):
    return responses(spark, d).select("id", A.reasoning_steps(F.col("response")).alias("steps"))


_TERMS = lambda c: f"list_distinct(regexp_extract_all(replace({c}, ',', ' '), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))"
_W = "len(string_split(trim(regexp_replace(response, '\\s+', ' ', 'g')), ' '))"


@query(
    "response_quality",
    f"""WITH {_PARSED}, q AS (SELECT *, trim(lower(expected)) AS e, trim(lower(final)) AS x FROM parsed), t AS (SELECT *, {_TERMS("e")} AS et, {_TERMS("x")} AS xt FROM q)
SELECT id, round(CASE WHEN answer_type = 'BIN' THEN CASE WHEN e = x THEN 1.0 ELSE 0.0 END WHEN contains(x, e) OR contains(e, x) THEN 1.0 WHEN len(et) > 0 AND len(xt) > 0 THEN len(list_intersect(et, xt)) / len(list_distinct(list_concat(et, xt))) ELSE 0.0 END, 6)::DOUBLE AS correctness,
CAST(CASE WHEN {_W} BETWEEN 20 AND 50 THEN 1.0 WHEN {_W} BETWEEN 10 AND 19 THEN 0.8 WHEN {_W} > 50 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS completeness,
CAST((CASE WHEN regexp_matches(response, '(?i)ANSWER:\\s*[^\\n]+') THEN 0.5 ELSE 0 END) + (CASE WHEN regexp_matches(response, '(?i)REASONING:\\s*[^\\n]+') THEN 0.5 ELSE 0 END) AS DOUBLE) AS structure,
round(least(1.0, 0.3 * list_sum([CAST(contains(response, w) AS INTEGER) FOR w IN ['•', '-', '*', '1.', '2.', '3.']]) + 0.2 * list_sum([CAST(contains(lower(response), w) AS INTEGER) FOR w IN ['because', 'therefore', 'since', 'thus', 'shows', 'indicates']])), 6)::DOUBLE AS reasoning FROM t""",
)
def response_quality(spark, d):
    r = responses(spark, d).withColumn("final", A.final_answer(F.col("response"), F.col("answer_type")))
    x = F.col("response")
    return r.select("id", F.round(A.correctness(F.col("expected"), F.col("final"), F.col("answer_type")), 6).alias("correctness"), A.completeness(x).alias("completeness"), A.structure(x).alias("structure"), F.round(A.reasoning_quality(x), 6).alias("reasoning"))


@query("prompt_build", "SELECT doc_id, md5('Answer the question from the statements below; infer what follows from them.' || chr(10) || 'Reply in exactly three lines:' || chr(10) || 'ANSWER: [' || CASE WHEN doc_id % 2 = 0 THEN 'all local names that answer it, separated by commas' ELSE 'TRUE or FALSE, nothing else' END || ']' || chr(10) || 'CONFIDENCE: [0.0 to 1.0]' || chr(10) || 'REASONING_STEPS: [1 to 10]' || chr(10) || chr(10) || 'Question: ' || source || chr(10) || 'Context: ' || CASE WHEN length(text) > 10000 THEN substr(text, 1, 10000) || chr(10) || '... [truncated for memory efficiency]' ELSE text END) AS prompt_md5 FROM documents")
def prompt_build(spark, d):
    docs = read(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "Multi Choice").otherwise("Binary")
    return docs.select("doc_id", F.md5(A.prompt(F.col("source"), F.col("text"), kind, "json")).alias("prompt_md5"))


@query("response_metrics", f"WITH {_RESPONSES} SELECT id, substr(md5(text), 1, 8) AS query_hash, CAST(length(response) AS INTEGER) AS response_chars, round(length(text) / 7.0, 3)::DOUBLE AS response_time, substr(response, 1, 500) AS response FROM responses")
def response_metrics(spark, d):
    m = A.metrics(F.col("text"), F.col("response"), F.length("text") / 7.0, F.length("response"))
    return responses(spark, d).select("id", m.alias("m")).select("id", "m.query_hash", "m.response_chars", "m.response_time", "m.response")


# -- scores ------------------------------------------------------------------------------------------------------------

_CLEAN = lambda c: f"""list_distinct(list_filter([trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(trim(i), '[_*#@$%^&()+=\\[\\]{{}}|\\\\:";''<>?/~`]', '', 'g'), '\\s+', ' ', 'g')), '\\s+[0-9]{{4}}$', ''), '\\s+[0-9]{{4}}\\s+', ' ', 'g'), '^[0-9]+$', ''), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) FOR i IN string_split({c}, CASE WHEN contains({c}, ';') THEN ';' WHEN contains({c}, ',') THEN ',' ELSE chr(1) END)], lambda z: z <> ''))"""
_LOW = lambda c: f"regexp_replace(trim(lower({c})), '\\s+', ' ', 'g')"
_SCORED = f"""{_PARSED}, low AS (SELECT *, {_LOW("expected")} AS le, {_LOW("final")} AS lx, CAST({_CONF} AS DOUBLE) AS confidence FROM parsed WHERE final <> '' AND final NOT LIKE 'ERROR%'),
sets AS (SELECT *, {_CLEAN("le")} AS es, {_CLEAN("lx")} AS xs FROM low),
jac AS (SELECT *, CASE WHEN len(list_distinct(list_concat(es, xs))) = 0 THEN 1.0 ELSE len(list_intersect(es, xs)) / len(list_distinct(list_concat(es, xs))) END AS j0 FROM sets),
scored AS (SELECT id, answer_type, expected, final, text, confidence, CAST(CASE WHEN answer_type = 'BIN' AND j0 < 1 THEN 0 ELSE j0 END AS DOUBLE) AS jaccard, 'm' || (id % 3) AS model, length(text) / 7.0 AS response_time, length(response) AS token_count, id % 5 AS inference_count FROM jac),
cal AS (SELECT *, 1.0 - abs(confidence - CASE WHEN jaccard >= 1 THEN 1.0 ELSE 0.0 END) AS calibration FROM scored)"""
_ITEMS = lambda c: f"list_filter([trim(regexp_replace(regexp_replace(i, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) FOR i IN string_split(trim(lower({c})), CASE WHEN contains({c}, ';') THEN ';' WHEN contains({c}, ',') THEN ',' WHEN contains(trim({c}), chr(10)) THEN chr(10) ELSE chr(1) END)], lambda z: z <> '')"
_NORM = lambda v: f"trim(regexp_replace(regexp_replace(replace(trim(lower({v})), '_', ' '), '\\s*[0-9]{{4}}$', ''), '\\s+', ' ', 'g'))"
_HALL = f"""{_SCORED}, parts AS (SELECT *, {_ITEMS("final")} AS mine, list_distinct(list_concat({_ITEMS("expected")}, list_concat(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: regexp_full_match(w, '[a-z]+(_[a-z]+)*_[0-9]{{4}}')), [lower(w) FOR w IN list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]+'))]))) AS valid FROM cal),
normal AS (SELECT * EXCLUDE (mine, valid), [{_NORM("i")} FOR i IN mine] AS mine, [{_NORM("i")} FOR i IN valid] AS valid FROM parts),
hall AS (SELECT * EXCLUDE (mine, valid), CASE WHEN answer_type = 'BIN' THEN NULL WHEN len(mine) = 0 THEN 1.0 ELSE len(list_filter(mine, lambda a: len(list_filter(valid, lambda v: contains(a, v) OR contains(v, a) OR replace(a, ' ', '') = replace(v, ' ', ''))) = 0)) / len(mine) END AS hallucination FROM normal)"""


def scored(spark, d) -> DataFrame:
    r = responses(spark, d)
    x = F.col("response")
    r = r.select("id", "answer_type", "expected", A.final_answer(x, F.col("answer_type")).alias("actual"), A.confidence(x).alias("confidence"), F.col("text").alias("context"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), (F.length("text") / 7.0).alias("response_time"), F.length(x).alias("token_count"), (F.col("id") % 5).alias("inference_count"))
    return S.score(r)


@query("jaccard_accuracy", f"WITH {_SCORED} SELECT id, round(jaccard, 6) AS jaccard FROM scored")
def jaccard_accuracy(spark, d):
    return scored(spark, d).select("id", F.round("jaccard", 6).alias("jaccard"))


@query("calibration", f"WITH {_SCORED} SELECT id, round(calibration, 6) AS calibration FROM cal")
def calibration(spark, d):
    return scored(spark, d).select("id", F.round("calibration", 6).alias("calibration"))


@query("hallucination", f"WITH {_HALL} SELECT id, round(hallucination, 6)::DOUBLE AS hallucination FROM hall")
def hallucination(spark, d):
    return scored(spark, d).select("id", F.round("hallucination", 6).alias("hallucination"))


_PART = "(answer_type <> 'BIN' AND jaccard > 0 AND jaccard < 1)"
_SPREAD = lambda name, c: f"round(avg({c}), 6)::DOUBLE AS {name}, round(stddev_pop({c}), 6)::DOUBLE AS {name}_std"
_RATE = lambda c: f"round(avg(CAST({c} AS INTEGER)), 6)::DOUBLE"
_SUM = f"""count(*) AS n, {_SPREAD("accuracy", "jaccard")}, count(*) FILTER (jaccard >= 1) AS perfect, count(*) FILTER ({_PART}) AS partial, count(*) FILTER (jaccard < 1 AND NOT {_PART}) AS wrong,
{_RATE("jaccard >= 1")} AS perfect_rate, {_RATE(_PART)} AS partial_rate, {_RATE(f"(jaccard < 1 AND NOT {_PART})")} AS wrong_rate, {_SPREAD("calibration", "calibration")}, count(*) FILTER (calibration >= 0.7) AS well_calibrated,
{_SPREAD("hallucination", "hallucination")}, count(*) FILTER (hallucination >= 0.7) AS clean, count(*) FILTER (hallucination < 0.3) AS severe, {_RATE("(hallucination < 0.7)")} AS hallucination_rate,
{_SPREAD("response_time", "response_time")}, {_SPREAD("token_count", "token_count")}, round(avg(inference_count), 6)::DOUBLE AS inference_count"""


@query("eval_summary", f"WITH {_HALL}, k AS (SELECT answer_type, count(*) AS q FROM responses GROUP BY answer_type UNION ALL SELECT 'ALL', count(*) FROM responses), z AS (SELECT model, answer_type, {_SUM} FROM hall GROUP BY model, answer_type UNION ALL SELECT model, 'ALL', {_SUM} FROM hall GROUP BY model) SELECT z.*, round(100.0 * n / q, 4)::DOUBLE AS coverage FROM z JOIN k USING (answer_type)")
def eval_summary(spark, d):
    return S.summary(scored(spark, d), responses(spark, d))


@query("dataset_composition", f"WITH {_RESPONSES} SELECT count(*) AS total, count(*) FILTER (answer_type = 'BIN') AS bin, count(*) FILTER (answer_type = 'MC') AS mc, round(100.0 * count(*) FILTER (answer_type = 'BIN') / count(*), 4)::DOUBLE AS bin_percent, round(100.0 * count(*) FILTER (answer_type = 'MC') / count(*), 4)::DOUBLE AS mc_percent FROM responses")
def dataset_composition(spark, d):
    return S.composition(responses(spark, d))


_TG = "CASE id % 4 WHEN 0 THEN ['Basic_Hierarchy'] WHEN 1 THEN ['Basic_Hierarchy', 'Domain_Range'] WHEN 2 THEN ['Functional'] ELSE CAST([] AS VARCHAR[]) END"
_GS = f"WITH {_HALL}, g AS (SELECT *, unnest({_TG}) AS tag_group FROM hall) SELECT model, tag_group, {_SUM}, count(*) FILTER (answer_type = 'BIN') AS n_bin, count(*) FILTER (answer_type = 'MC') AS n_mc FROM g GROUP BY model, tag_group HAVING count(*) >= 3"


def _grouped(spark, d):
    k = F.col("id") % 4
    g = F.when(k == 0, F.array(F.lit("Basic_Hierarchy"))).when(k == 1, F.array(F.lit("Basic_Hierarchy"), F.lit("Domain_Range"))).when(k == 2, F.array(F.lit("Functional"))).otherwise(F.array().cast("array<string>"))
    return S.group_summary(scored(spark, d).withColumn("tag_groups", g))


@query("tag_group_summary", _GS)
def tag_group_summary(spark, d):
    return _grouped(spark, d)


@query("top3_groups", f"SELECT model, tag_group, accuracy, rank FROM (SELECT model, tag_group, accuracy, CAST(row_number() OVER (PARTITION BY model ORDER BY accuracy DESC, tag_group) AS INTEGER) AS rank FROM ({_GS})) WHERE rank <= 3")
def top3_groups(spark, d):
    return S.top_groups(_grouped(spark, d)).select("model", "tag_group", "accuracy", "rank")


@query(
    "key_findings",
    f"""WITH {_HALL}, g AS (SELECT *, unnest({_TG}) AS tag_group FROM hall), w AS (SELECT model, round(avg(jaccard), 6) AS a, count(*) FILTER (answer_type = 'MC') AS n, round(avg(jaccard) FILTER (answer_type = 'MC'), 6) AS m FROM hall GROUP BY model), q AS (SELECT count(*) AS q FROM responses WHERE answer_type = 'MC'),
t AS (SELECT model, round(avg(jaccard), 6) AS b FROM g WHERE tag_group = 'Basic_Hierarchy' GROUP BY model) SELECT model, printf('%.1f%%', a * 100) AS accuracy, printf('%d (%.1f%%)', n, round(100.0 * n / q, 4)) AS mc_evaluated, printf('%.1f%%', m * 100) AS mc_accuracy, printf('%.1f%%', b * 100) AS hierarchy_accuracy FROM w JOIN t USING (model), q""",
)
def key_findings(spark, d):
    """Some figures of the summary file of each model, read back from its JSON."""
    shares = spark.createDataFrame([("Basic_Hierarchy", 50.0), ("Domain_Range", 25.0)], "tag_group string, share double")
    found = S.key_findings(eval_summary(spark, d), _grouped(spark, d), shares)
    at = lambda path: F.get_json_object("json", f"$.{path}")
    return found.select("model", at("overall_metrics.average_accuracy").alias("accuracy"), at("performance_by_answer_type.mc.successfully_evaluated").alias("mc_evaluated"), at("performance_by_answer_type.mc.average_accuracy").alias("mc_accuracy"), at("tag_group_analysis.Basic_Hierarchy.accuracy").alias("hierarchy_accuracy"))


@query("perf_summary", "SELECT model, count(*) FILTER (NOT error) AS successes, count(*) FILTER (error) AS errors, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS least, max(v) AS most, round(quantile_cont(v, 0.5), 6) AS median FROM (SELECT event_type AS model, user_id % 7 = 0 AS error, CASE WHEN value > 0 THEN value END AS v FROM events) GROUP BY model")
def perf_summary(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 7 == 0).alias("error"), F.col("value").alias("response_time"))
    return S.performance(e)


@query("checkpoint_stats", "SELECT event_type AS model, count(*) FILTER (user_id % 7 <> 0) AS responses, count(*) FILTER (user_id % 7 = 0) AS errors, count(*) FILTER (value > 0.5) AS correct, round(100.0 * count(*) FILTER (value > 0.5) / count(*) FILTER (user_id % 7 <> 0), 4)::DOUBLE AS accuracy FROM events GROUP BY event_type")
def checkpoint_stats(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 7 == 0).alias("error"), F.col("value").alias("correctness"))
    return S.checkpoint_stats(e)


@query("pattern_counts", "WITH w AS (SELECT text, CASE turn % 3 WHEN 0 THEN 'Membership' WHEN 1 THEN 'Property Assertion' ELSE 'Other' END AS k, CASE WHEN turn % 4 = 3 THEN 'MC' ELSE 'BIN' END AS t, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS n FROM conversations) SELECT count(*) FILTER (k = 'Membership') AS membership, count(*) FILTER (k = 'Property Assertion') AS property, count(*) AS total, count(*) FILTER (t = 'BIN') AS bin, count(*) FILTER (t = 'MC') AS mc, count(*) FILTER (n <= 5) AS short, count(*) FILTER (n > 5 AND n <= 10) AS middle, count(*) FILTER (n > 10) AS long, count(*) FILTER (contains(text, '.')) AS complex FROM w")
def pattern_counts(spark, d):
    c = read(spark, d, "conversations").withColumn("t", F.when(F.col("turn") % 4 == 3, "MC").otherwise("BIN"))
    c = c.withColumn("k", F.when(F.col("turn") % 3 == 0, "Membership").when(F.col("turn") % 3 == 1, "Property Assertion").otherwise("Other"))
    return S.pattern_counts(c, "text", "t", "k")


@query("sampled_tasks", "SELECT DISTINCT conv_id, CASE turn % 3 WHEN 0 THEN 'Membership' ELSE 'Property Assertion' END AS task_type, regexp_replace('1hop-' || conv_id || CASE WHEN turn % 2 = 0 THEN '-BIN' ELSE '-MC' END, '-(BIN|MC)$', '') AS task_group FROM conversations WHERE turn % 3 < 2")
def sampled_tasks(spark, d):
    """FLT-9, PRJ-13: questions of the two task types, less the answer kind in their ids."""
    t = F.col("turn")
    kind = F.when(t % 3 == 0, "Membership").when(t % 3 == 1, "Property Assertion").otherwise("Other")
    q = read(spark, d, "conversations").select("conv_id", kind.alias("Task Type"), F.concat(F.lit("1hop-"), F.col("conv_id").cast("string"), F.when(t % 2 == 0, "-BIN").otherwise("-MC")).alias("Task ID"))
    return T.sampled_tasks(q).select("conv_id", F.col("Task Type").alias("task_type"), "task_group").distinct()


@query("available_contexts", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE n_chars > 20000)")
def available_contexts(spark, d):
    """SRC-14: documents as questions whose root entity is their source; sources with a long text have a context."""
    docs = read(spark, d, "documents").withColumnRenamed("source", "root_entity")
    return S.with_available_context(docs, docs.where("n_chars > 20000")).select("doc_id")


@query("context_sizes", "SELECT CAST(sum(strlen(html)) AS BIGINT) AS total, round(avg(strlen(html)), 4) AS mean, count(*) FILTER (strlen(html) > 100000) AS above_100k, count(*) FILTER (strlen(html) > 500000) AS above_500k FROM pages")
def context_sizes(spark, d):
    return S.context_sizes(read(spark, d, "pages"), "html")


# -- joins -------------------------------------------------------------------------------------------------------------


@query("sparql_equi_join", "WITH q AS (SELECT item_id AS question_id, 'ASK  WHERE { ' || text || ' } . ' AS q FROM benchmark), e AS (SELECT doc_id AS explanation_id, doc_id AS pos, 'ASK WHERE {  ' || text || ' }' AS q FROM documents UNION ALL SELECT item_id + 1000000, item_id + 1000000, 'ASK WHERE { ' || text || ' } .' FROM benchmark), n AS (SELECT *, regexp_replace(trim(regexp_replace(q, '\\s+', ' ', 'g')), '[. ]+$', '') AS norm FROM e) SELECT question_id, min_by(explanation_id, pos) AS explanation_id FROM (SELECT question_id, regexp_replace(trim(regexp_replace(q, '\\s+', ' ', 'g')), '[. ]+$', '') AS norm FROM q) a JOIN n USING (norm) GROUP BY question_id")
def sparql_equi_join(spark, d):
    b = read(spark, d, "benchmark")
    head = F.col("text")
    q = b.select(F.col("item_id").alias("question_id"), F.concat(F.lit("ASK  WHERE { "), head, F.lit(" } . ")).alias("query"))
    e = read(spark, d, "documents").select(F.col("doc_id").alias("explanation_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("ASK WHERE {  "), head, F.lit(" }")).alias("query"))
    more = b.select((F.col("item_id") + 1000000).alias("explanation_id"), (F.col("item_id") + 1000000).alias("pos"), F.concat(F.lit("ASK WHERE { "), head, F.lit(" } .")).alias("query"))
    return S.by_query(q, e.unionByName(more))


_TOK = lambda c: f"list_distinct(string_split(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '[. ]+$', ''), ' '))"


@query("similarity_join", f"WITH q AS (SELECT item_id AS question_id, {_TOK('text')} AS x FROM benchmark), e AS (SELECT item_id AS explanation_id, CASE WHEN item_id % 3 = 0 THEN 0 ELSE item_id END AS pos, {_TOK(chr(39) + 'extra ' + chr(39) + ' || text')} AS y FROM benchmark) SELECT question_id, min_by(explanation_id, {{'p': pos, 'e': explanation_id}}) AS explanation_id FROM q, e WHERE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.9 GROUP BY question_id")
def similarity_join(spark, d):
    b = read(spark, d, "benchmark")
    q = b.select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    e = b.select(F.col("item_id").alias("explanation_id"), F.when(F.col("item_id") % 3 == 0, 0).otherwise(F.col("item_id")).alias("pos"), F.concat(F.lit("extra "), "text").alias("query"))
    return S.by_similarity(q, e)


@query("questions_x_models", "SELECT o_orderkey, model FROM orders, (VALUES ('a'), ('b'), ('c')) m(model)")
def questions_x_models(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("model"))


@query("resume_anti_join", "SELECT o_orderkey, model FROM orders, (VALUES ('a'), ('b')) m(model) WHERE NOT (model = 'a' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45))")
def resume_anti_join(spark, d):
    """Tasks still to run: those without a finished (task, model)."""
    tasks = read(spark, d, "orders").select("o_orderkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"))
    done = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("a").alias("model"))
    return tasks.join(done, ["o_orderkey", "model"], "left_anti")


@query("test_mode_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def test_mode_limit(spark, d):
    return read(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(50)


@query("model_pairs", "WITH m AS (SELECT DISTINCT event_type AS m FROM events) SELECT a.m AS a, b.m AS b FROM m a JOIN m b ON a.m < b.m")
def model_pairs(spark, d):
    m = read(spark, d, "events").select(F.col("event_type").alias("a")).distinct()
    b = m.select(F.col("a").alias("b"))
    return m.join(F.broadcast(b), F.col("a") < F.col("b"))


# -- statistics and samples --------------------------------------------------------------------------------------------

_BINS = lambda c, t: f"SELECT count({c}) AS n, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {t}"
_NB = "CASE WHEN most > least THEN CAST(greatest(1, ceil((most - least) / CASE WHEN iqr > 0 THEN least((most - least) / (log2(n) + 1), 2 * iqr * pow(n, -1.0 / 3)) ELSE (most - least) / (log2(n) + 1) END)) AS INTEGER) ELSE 1 END"
_EDGES = lambda c, t: f"SELECT n, least, most, {_NB} AS bins FROM ({_BINS(c, t)})"
_CUT = lambda c, e: f"CAST(CASE WHEN {e}.most > {e}.least THEN LEAST(greatest(ceil(({c} - {e}.least) / (({e}.most - {e}.least) / {e}.bins)) - 1, 0), {e}.bins - 1) ELSE 0 END AS INTEGER)"


@query("sample_bins", f"WITH e AS ({_EDGES('o_totalprice', 'orders')}) SELECT o_orderkey, {_CUT('o_totalprice', 'e')} AS bin FROM orders, e")
def sample_bins(spark, d):
    return T.cut(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "bin").select("o_orderkey", "bin")


_STRATA = f"a AS ({_EDGES('c_acctbal', 'customer')}), b AS ({_EDGES('c_nationkey', 'customer')}), s AS (SELECT c_custkey, {_CUT('c_acctbal', 'a')} || '_' || {_CUT('c_nationkey', 'b')} AS strata FROM customer, a, b)"


@query("sample_strata", f"WITH {_STRATA} SELECT c_custkey, strata FROM s")
def sample_strata(spark, d):
    return T.strata(read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_acctbal", "c_nationkey").select("c_custkey", "strata")


@query(
    "sample_split",
    """WITH s AS (SELECT o_orderkey, o_orderstatus || o_orderpriority AS strata FROM orders), c AS (SELECT strata, count(*) AS c FROM s GROUP BY strata HAVING count(*) >= 2), t AS (SELECT sum(c) AS n, count(*) AS k FROM c),
u AS (SELECT n - LEAST(greatest(round_even(0.95 * n, 0), k), n - k) AS train, n FROM t), a AS (SELECT strata, floor(train * c / n) AS w, train * c / n - floor(train * c / n) AS f, train FROM c, u),
r AS (SELECT strata, w + CASE WHEN row_number() OVER (ORDER BY f DESC, strata) <= train - sum(w) OVER () THEN 1 ELSE 0 END AS take FROM a)
SELECT o_orderkey, strata FROM (SELECT o_orderkey, s.strata, take, row_number() OVER (PARTITION BY s.strata ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k FROM s JOIN r ON s.strata = r.strata) WHERE k <= take""",
)
def sample_split(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("strata"))
    return T.stratified_keep(o, "o_orderkey").select("o_orderkey", "strata")


_POISSON = " + ".join(f"CAST(u >= {x!r} AS INTEGER)" for x in T._POISSON)


@query(
    "bootstrap_ci",
    f"""WITH r AS (SELECT c_nationkey % 3 AS g, c_acctbal AS v, ('0x' || substr(md5('42:' || c_custkey), 1, 8))::BIGINT % 2147483647 AS h1, ('0x' || substr(md5('42:' || c_custkey), 9, 8))::BIGINT % 2147483647 AS h2 FROM customer),
k AS (SELECT g, v, b, ((h1 + b * h2) % 2147483647) / 2147483647.0::DOUBLE AS u FROM r, (SELECT unnest(range(1, {SAMPLES} + 1)) AS b) q), w AS (SELECT g, v, b, {_POISSON} AS k FROM k), m AS (SELECT g, b, sum(k * v) / sum(k) AS m FROM w GROUP BY g, b)
SELECT g, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY g""",
)
def bootstrap_ci(spark, d):
    s = read(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("g"), "c_custkey", "c_acctbal")
    return T.bootstrap_ci(s, "g", "c_custkey", "c_acctbal", SAMPLES)


_MW = """WITH v AS (SELECT c_mktsegment AS g, round(c_acctbal / 100) AS x FROM customer), p AS (SELECT a.g AS a, b.g AS b FROM (SELECT g FROM v GROUP BY g HAVING count(*) > 30) a JOIN (SELECT g FROM v GROUP BY g HAVING count(*) > 30) b ON a.g < b.g),
j AS (SELECT a, b, g, x, rank() OVER w + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY a, b, x) AS t FROM p JOIN v ON g IN (a, b) WINDOW w AS (PARTITION BY a, b ORDER BY x)),
s AS (SELECT a, b, CAST(count(*) FILTER (g = a) AS DOUBLE) AS n1, CAST(count(*) FILTER (g = b) AS DOUBLE) AS n2, sum(r) FILTER (g = a) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties, avg(x) FILTER (g = a) - avg(x) FILTER (g = b) AS diff FROM j GROUP BY a, b),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s) SELECT a, b, CAST(u AS DOUBLE) AS u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z, round(diff, 6) AS difference FROM u"""


@query("mann_whitney_u", _MW)
def mann_whitney_u(spark, d):
    c = read(spark, d, "customer").select("c_mktsegment", F.round(F.col("c_acctbal") / 100).alias("x"))
    return T.mann_whitney(c, "c_mktsegment", "x")


# The complementary error function by the series of its exponentially scaled form, whose terms are all positive.
_ERF = "list_sum([exp(-y * y + 2 * k * ln(2) + (2 * k + 1) * ln(y) - lgamma(2 * k + 2) + lgamma(k + 1)) FOR k IN range(0, 400)]) * 2 / sqrt(pi())"


@query("mann_whitney_p", f"SELECT a, b, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance FROM (SELECT a, b, CASE WHEN z <= 0 THEN 1.0 WHEN z > 12 THEN 0.0 ELSE greatest(0, 1 - {_ERF}) END::DOUBLE AS p FROM (SELECT *, z / sqrt(2) AS y FROM ({_MW})))")
def mann_whitney_p(spark, d):
    m = mann_whitney_u(spark, d).withColumn("p", T.two_sided_p(F.col("z")))
    return m.select("a", "b", F.round("p", 6).alias("p"), T.stars(F.col("p")).alias("significance"))


# -- names and texts ---------------------------------------------------------------------------------------------------


@query("local_name", "SELECT page_id, CASE WHEN contains(url, '#') THEN split_part(url, '#', -1) ELSE split_part(url, '/', -1) END AS short_form, CASE WHEN regexp_extract(url, '[^#/]*$') = '' THEN url ELSE regexp_extract(url, '[^#/]*$') END AS local_name, regexp_extract(url, '^(.*[#/])', 1) AS namespace FROM pages")
def local_name(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", N.short_form(u).alias("short_form"), N.local_name(u).alias("local_name"), N.namespace(u).alias("namespace"))


@query("full_uri", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'http://www.w3.org/2000/01/rdf-schema#' || p_name WHEN p_partkey % 3 = 1 THEN 'http://example.org/kg#' || p_name ELSE 'https://x.org/' || p_name END AS iri FROM part")
def full_uri(spark, d):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("rdfs:"), "p_name")).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("https://x.org/"), "p_name"))
    return read(spark, d, "part").select("p_partkey", N.full_iri(name, "http://example.org/kg#").alias("iri"))


@query("namespace_mode", "WITH n AS (SELECT regexp_extract(url, '^(.*[#/])', 1) AS ns, count(*) AS n FROM pages GROUP BY 1) SELECT CASE WHEN max(n) > 5 THEN 'uri' ELSE 'unknown' END AS mode, CASE WHEN max(n) > 5 THEN min_by(ns, {'n': -n, 'ns': ns}) END AS namespace, max(n) AS n FROM n")
def namespace_mode(spark, d):
    return B.namespace_mode(read(spark, d, "pages").select(F.col("url").alias("iri")))


@query("entity_label", "WITH a AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name || 'NameOf_x1840_' || (1000 + p_partkey % 900), '_[0-9]{4}$', ''), '_[A-Za-z0-9]{2,3}$', ''), '([a-z])([A-Z])', '\\1 \\2', 'g') AS n FROM part) SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(trim(regexp_replace(n, '[_\\-\\s]+', ' ', 'g')), ' ')], ' ') AS label FROM a")
def entity_label(spark, d):
    name = F.concat("p_name", F.lit("NameOf_x1840_"), (1000 + F.col("p_partkey") % 900).cast("string"))
    return read(spark, d, "part").select("p_partkey", N.entity_label(name).alias("label"))


_TERM = "SELECT DISTINCT term, cat FROM (SELECT p_brand AS term, 'class' AS cat FROM part UNION ALL SELECT n_name, 'individual' FROM nation UNION ALL SELECT r_name, 'object_property' FROM region UNION ALL SELECT p_brand, 'individual' FROM part WHERE p_partkey % 2 = 0)"
_MAP = f"WITH t AS ({_TERM}), k AS (SELECT term, min(CASE cat WHEN 'class' THEN 1 WHEN 'object_property' THEN 2 WHEN 'data_property' THEN 3 ELSE 4 END) AS r FROM t GROUP BY term), m AS (SELECT term AS original, CASE r WHEN 1 THEN 'Class' WHEN 2 THEN 'Property' WHEN 3 THEN 'DataProperty' ELSE 'Individual' END || row_number() OVER (PARTITION BY r ORDER BY term) AS abstract_name FROM k)"


@query("abstract_mapping", f"{_MAP} SELECT original, abstract_name FROM m")
def abstract_mapping(spark, d):
    return B.mapping(_terms(spark, d)).select("original", "abstract_name")


def _terms(spark, d):
    part, nation, region = (read(spark, d, t) for t in ("part", "nation", "region"))
    rows = [part.select(F.col("p_brand").alias("term"), F.lit("class").alias("category")), nation.select(F.col("n_name"), F.lit("individual")), region.select(F.col("r_name"), F.lit("object_property")), part.where("p_partkey % 2 = 0").select("p_brand", F.lit("individual"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.distinct()


@query("abstract_text", f"{_MAP} SELECT c_custkey, 'Is ' || c_name || ' in ' || a.abstract_name || ' of ' || b.abstract_name || ', not ' || n_name || 'X?' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN m a ON n_name = a.original JOIN m b ON r_name = b.original")
def abstract_text(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    q = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    q = q.select("c_custkey", F.concat(F.lit("Is "), "c_name", F.lit(" in "), "n_name", F.lit(" of "), "r_name", F.lit(", not "), "n_name", F.lit("X?")).alias("text"))
    return B.rewrite(q, "text", B.mapping(_terms(spark, d)))


@query("abstract_names_with_marks", f"{_MAP} SELECT p_partkey, 'Is ' || p_name || ' of ' || abstract_name || ', has-part foo; not ' || p_brand || 'Z or x' || p_brand || '?' AS text FROM part JOIN m ON p_brand = original")
def abstract_names_with_marks(spark, d):
    """ABS-11 for names with marks inside: Brand#12 is a name, Brand#12Z and xBrand#12 are not."""
    q = read(spark, d, "part").select("p_partkey", F.concat(F.lit("Is "), "p_name", F.lit(" of "), "p_brand", F.lit(", has-part foo; not "), "p_brand", F.lit("Z or x"), "p_brand", F.lit("?")).alias("text"))
    return B.rewrite(q, "text", B.mapping(_terms(spark, d)))


_TTL = "'<http://x.org/o#' || {0} || '> a <http://x.org/o#Nation> . ' || chr(10) || '###  http://x.org/o#' || {0} || chr(10) || ':' || {0} || ' <http://y.org/o#' || {0} || '> .'"


@query("abstract_turtle", f"{_MAP} SELECT n_nationkey, '<http://www.example.com/abstracted.owl#' || abstract_name || '> a <http://x.org/o#Nation> . ' || chr(10) || '###  http://www.example.com/abstracted.owl#' || abstract_name || chr(10) || ':' || n_name || ' <http://y.org/o#' || n_name || '> .' AS text FROM nation JOIN m ON n_name = original")
def abstract_turtle(spark, d):
    """ABS-9, ABS-10: a Turtle text for each nation; names of other namespaces and without a mapping stay."""
    n = F.col("n_name")
    text = F.concat(F.lit("<http://x.org/o#"), n, F.lit("> a <http://x.org/o#Nation> . \n###  http://x.org/o#"), n, F.lit("\n:"), n, F.lit(" <http://y.org/o#"), n, F.lit("> ."))
    return B.rewrite_turtle(read(spark, d, "nation").select("n_nationkey", text.alias("text")), "text", B.mapping(_terms(spark, d)), "uri", "http://x.org/o")


_SIGNS = ["x rdfs:subClassOf y", "x ⊑ y", "x ≡ y", "r⁻ s", "r ∘ s", "∃ r", "∀ r", "x ∩ y", "x ∪ y", "¬ x", "is a thing", "transitive r", "disjoint x", "max 2 r", "nothing"]
_LETTERS = ["H", "H", "Q", "I", "N", "E", "L", "∩", "U", "¬", "D", "T", "J", "C", ""]


@query("tag_texts", f"SELECT p_partkey, coalesce([{', '.join(repr(x) for x in _LETTERS)}][CAST(p_partkey % 15 AS INTEGER) + 1], '') AS letter FROM part")
def tag_texts(spark, d):
    """TAG-3: the letter of a justification's text, by words or signs."""
    said = F.get(F.array(*[F.lit(x) for x in _SIGNS]), (F.col("p_partkey") % 15).cast("int"))
    return read(spark, d, "part").select("p_partkey", F.coalesce(G.text_letter(said), F.lit("")).alias("letter"))


@query("structural_type", "SELECT n_nationkey, CASE WHEN n_nationkey > 10 THEN 'hierarchical' WHEN n_nationkey * 3 > 20 THEN 'relational' WHEN count(c_custkey) > 50 THEN 'instance_heavy' ELSE 'general' END AS kind FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def structural_type(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))
    return n.select("n_nationkey", V.structural_type(F.col("n_nationkey"), F.col("n_nationkey") * 3, F.col("n")).alias("kind"))


@query("entity_labels", "SELECT 'c/' || c_custkey AS entity, CASE WHEN c_custkey % 2 = 0 THEN 'b ' || c_name WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS text FROM customer")
def entity_labels(spark, d):
    """JN-15: rdfs:label of every second customer (two of them), title of every third, foaf:name of all."""
    from quillon.sources import rdf

    c = read(spark, d, "customer").select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("s"), "c_custkey", "c_name", "c_mktsegment")
    row = lambda df, p, o: df.select("s", F.lit(rdf.LABELS[p]).alias("p"), o.alias("o"), F.lit(None).cast("string").alias("_error"))
    even = c.where("c_custkey % 2 = 0")
    rows = [row(c, 3, F.col("c_name")), row(c.where("c_custkey % 3 = 0"), 2, F.col("c_mktsegment")), row(even, 0, F.concat(F.lit("b "), "c_name")), row(even, 0, F.concat(F.lit("c "), "c_name"))]
    return rdf.labels_of(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]))


# -- verbalisation -----------------------------------------------------------------------------------------------------

_LIST = "CASE WHEN len({0}) = 1 THEN {0}[1] ELSE array_to_string({0}[:-2], ', ') || ' and ' || {0}[-1] END"
_SAID = "CASE p WHEN 'placedBy' THEN {0} || ' has exactly one placed by ' || {1} WHEN 'compatriotOf' THEN {0} || ' and ' || {1} || ' are mutually compatriot' ELSE {0} || ' ' || trim(lower(regexp_replace(p, '([a-z])([A-Z])', '\\1 \\2', 'g'))) || ' ' || {1} END"
_VI = f""", types AS (SELECT s, '0' AS k, s || ' is an instance of ' || string_agg(c, ' and ' ORDER BY c) AS t FROM asserted_type GROUP BY s),
outg AS (SELECT s, '1' || p AS k, {_SAID.format("s", "(" + _LIST.format("os") + ")")} AS t FROM (SELECT s, p, list(o ORDER BY o) AS os FROM asserted_rel GROUP BY s, p)),
inc AS (SELECT s, '2' || p AS k, CASE WHEN len(ys) = 1 THEN {_SAID.format("ys[1]", "s")} ELSE {_LIST.format("ys")} || ' are related to ' || s || ' through ' || trim(lower(regexp_replace(p, '([a-z])([A-Z])', '\\1 \\2', 'g'))) END AS t
  FROM (SELECT r.o AS s, r.p, list(r.s ORDER BY r.s) AS ys FROM asserted_rel r WHERE NOT EXISTS (SELECT 1 FROM asserted_rel z WHERE z.s = r.o AND z.p = r.p) GROUP BY r.o, r.p HAVING count(*) <= 5))"""


@query("verbalize_individual", kg_sql("@@SELECT s, string_agg(t, '. ' ORDER BY k) || '.' AS description FROM (SELECT * FROM types UNION ALL SELECT * FROM outg UNION ALL SELECT * FROM inc) GROUP BY s").replace("\n@@", _VI + "\n"))
def verbalize_individual(spark, d):
    g = core_graph(spark, d)
    return V.individuals(g.types, g.relations, g.schema, label=lambda c: c).select("s", "description")


# -- final benchmark and JSON ------------------------------------------------------------------------------------------


@query("nest_benchmark", "SELECT o_orderstatus AS task_type, o_orderpriority AS answer_type, count(*) AS n, md5(string_agg(o_orderkey || ':' || q, ',' ORDER BY o_orderkey)) AS qas FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ' ' ORDER BY l_linenumber), '') AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_orderstatus, o_orderpriority")
def nest_benchmark(spark, d):
    line = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), " ").alias("q"))
    rows = read(spark, d, "orders").join(line, "o_orderkey", "left").select(F.col("o_orderstatus").alias("task_type"), F.col("o_orderpriority").alias("answer_type"), "o_orderkey", F.coalesce("q", F.lit("")).alias("q"))
    nested = K.nest(rows, ["task_type", "answer_type"], ["o_orderkey", "q"])
    text = F.array_join(F.transform("qas", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["q"])), ",")
    return nested.select("task_type", "answer_type", F.size("qas").cast("bigint").alias("n"), F.md5(text).alias("qas"))


@query("min_explanation", "SELECT l_orderkey AS id, min_by(l_linenumber || ':' || l_partkey, {'n': length(l_linenumber || ':' || l_partkey), 'p': l_linenumber, 't': l_linenumber || ':' || l_partkey}) AS explanation FROM lineitem GROUP BY l_orderkey")
def min_explanation(spark, d):
    line = read(spark, d, "lineitem")
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))
    return K.minimum(line.select(F.col("l_orderkey").alias("id"), text.alias("explanation"), F.length(text).alias("n"), F.col("l_linenumber").alias("pos")), ["id"])


_BAD = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN replace(props, '}', ',') || chr(10) || '}' WHEN 2 THEN replace(props, '}', '') ELSE replace(props, '}', ',' || chr(10) || ',' || chr(10) || '}') END"


def _bad(spark, d):
    k, p = F.col("event_id") % 4, F.col("props")
    text = F.when(k == 0, p).when(k == 1, F.concat(F.replace(p, F.lit("}"), F.lit(",")), F.lit("\n}"))).when(k == 2, F.replace(p, F.lit("}"), F.lit(""))).otherwise(F.replace(p, F.lit("}"), F.lit(",\n,\n}")))
    return read(spark, d, "events").select("event_id", text.alias("text"))


@query("json_repair", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, true AS valid FROM events")
def json_repair(spark, d):
    r = _bad(spark, d).select("event_id", X.repair_json(F.col("text")).alias("j"))
    return r.select("event_id", F.from_json("j", "k int")["k"].alias("k"), X.is_json(F.col("j")).alias("valid"))


@query("json_partial", "SELECT event_id, name, CASE name WHEN 'k' THEN CAST(json_extract(props, '$.k') AS VARCHAR) ELSE '{\"n\": ' || event_id || '}' END AS value FROM events, (VALUES ('k', 1), ('m', 2)) v(name, i) WHERE i <= event_id % 3")
def json_partial(spark, d):
    """The whole key and value pairs before the first error of each text: none, one or two."""
    k, n = F.col("event_id") % 3, F.col("event_id").cast("string")
    first = F.concat(F.replace("props", F.lit("}"), F.lit("")))
    text = F.when(k == 0, F.lit('{"k": ')).when(k == 1, F.concat(first, F.lit(', "m": {"n": '), n)).otherwise(F.concat(first, F.lit(', "m": {"n": '), n, F.lit('}, "z": [1, ')))
    return X.partial_json(read(spark, d, "events").select("event_id", text.alias("text")), "event_id", "text")


@query("explanation_file", "SELECT CAST(row_number() OVER (ORDER BY k, key) AS INTEGER) AS n, value FROM (SELECT 0 AS k, '' AS key, '{' AS value UNION ALL SELECT 2, '', '}' UNION ALL SELECT 1, key, '\"' || key || '\": {\"inferred\":{\"subject\":\"' || s || '\",\"predicate\":\"inRegion\",\"object\":\"' || o || '\"},\"explanations\":[[\"' || s || ' \\\"in\\\" ' || o || '\"]],\"size\":{\"min\":1,\"max\":2},\"explanationCount\":1,\"taskIds\":[\"t\"],\"sparqlQueries\":[\"q\"]}' || CASE WHEN key = max(key) OVER () THEN '' ELSE ',' END FROM (SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS o, 'nation/' || n_nationkey || '|inRegion|region/' || n_regionkey AS key FROM nation))")
def explanation_file(spark, d):
    """SNK-3: the lines of one valid JSON object."""
    s, o = F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string"))
    one = lambda x: F.array(F.lit(x))
    rows = read(spark, d, "nation").select(s.alias("s"), F.lit("inRegion").alias("p"), o.alias("o"), F.array(F.array(F.concat(s, F.lit(' "in" '), o))).alias("explanations"), F.lit(1).alias("min_size"), F.lit(2).alias("max_size"), F.lit(1).alias("explanation_count"), one("t").alias("task_ids"), one("q").alias("sparql_queries"))
    lines = X.explanation_lines(X.explanation_json(rows))
    from pyspark.sql.window import Window

    return lines.withColumn("i", F.monotonically_increasing_id()).select(F.row_number().over(Window.orderBy("i")).alias("n"), "value")


# -- runs, reports and parts of the final data set ---------------------------------------------------------------------


@query("run_counters", "SELECT (SELECT count(*) FROM pages WHERE page_id % 7 <> 0) AS ontologies, (SELECT count(*) FROM pages WHERE page_id % 7 = 0) AS errors, (SELECT count(*) FROM documents) AS inferences, count(*) AS questions, count(*) FILTER (turn % 4 <> 3) AS bin, count(*) FILTER (turn % 4 = 3) AS mc FROM conversations")
def run_counters(spark, d):
    """AGG-7 over pages as files, some of them broken, documents as inferences and turns as questions."""
    files = read(spark, d, "pages").select(F.col("page_id").alias("graph_id"), F.when(F.col("page_id") % 7 == 0, "bad").alias("_error"))
    asked = read(spark, d, "conversations").select(F.when(F.col("turn") % 4 == 3, "MC").otherwise("BIN").alias("answer_type"))
    return P.run_counters(asked, files, read(spark, d, "documents"))


@query("durations", "WITH s AS (SELECT event_type AS step, CAST(sum(user_id) AS BIGINT) AS ms FROM events GROUP BY event_type) SELECT CAST(row_number() OVER (ORDER BY ms DESC, step) AS INTEGER) AS rank, step, ms FROM s UNION ALL SELECT 0, 'total', CAST(sum(ms) AS BIGINT) FROM s")
def durations(spark, d):
    return P.durations(read(spark, d, "events").select(F.col("event_type").alias("step"), F.col("user_id").alias("ms")))


@query("first_present", "SELECT o_custkey, min_by(o_totalprice, o_orderkey) FILTER (o_totalprice > 200000) AS price FROM orders GROUP BY o_custkey")
def first_present(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("price"))
    return P.first_present(o, ["o_custkey"], "price", "o_orderkey")


@query("last_results", "SELECT model, event_id FROM (SELECT event_type AS model, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def last_results(spark, d):
    return P.last_results(read(spark, d, "events").select(F.col("event_type").alias("model"), "event_id"), "event_id")


@query("text_statistics", "WITH s AS (SELECT count(*) AS n, count(*) FILTER (turn % 5 <> 0) AS ok FROM conversations) SELECT CAST(k AS INTEGER) AS n, CASE k WHEN 0 THEN 'Processing Statistics' WHEN 1 THEN '====================' WHEN 2 THEN 'Total questions: ' || n WHEN 3 THEN 'Successfully processed: ' || ok WHEN 4 THEN 'Errors: ' || (n - ok) WHEN 5 THEN printf('Success rate: %.1f%%', 100.0 * ok / n) WHEN 6 THEN 'Total processing time: 64.00 seconds' ELSE printf('Average time per question: %.2f seconds', 64.0 / n) END AS line FROM s, range(0, 8) r(k)")
def text_statistics(spark, d):
    return P.text_statistics(read(spark, d, "conversations"), F.col("turn") % 5 != 0, 64.0)


@query("experiment_summary", "WITH r AS (SELECT event_type AS model, event_id, user_id % 7 = 0 AS error, value FROM events) SELECT 'nl' AS mode, CAST((SELECT count(DISTINCT event_id) FROM events) AS VARCHAR) AS asked, CAST((SELECT count(*) FROM events) AS VARCHAR) AS calls, CAST((SELECT count(*) FROM r WHERE model = 'click') AS VARCHAR) AS clicks, (SELECT round(avg(CASE WHEN error THEN 0.0 ELSE 1.0 END), 6) FROM r WHERE model = 'click')::DOUBLE AS rate, (SELECT round(avg(value) FILTER (NOT error), 6) FROM r WHERE model = 'click')::DOUBLE AS seconds")
def experiment_summary(spark, d):
    """SNK-9: some figures of the summary, read back from its JSON."""
    r = read(spark, d, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("model"), (F.col("user_id") % 7 == 0).alias("error"), F.col("value").alias("seconds"), F.lit(1.0).alias("correctness"))
    at = lambda path: F.get_json_object("json", f"$.{path}")
    one = "performance_summary.click"
    return P.experiment_summary(r, P.Config(), 5.0).select(at("config.mode").alias("mode"), at("total_questions_processed").alias("asked"), at("total_api_calls").alias("calls"), at(f"{one}.calls").alias("clicks"), at(f"{one}.success_rate").cast("double").alias("rate"), at(f"{one}.response_time").cast("double").alias("seconds"))


@query("zip_sides", "WITH a AS (SELECT o_custkey AS task_id, o_orderstatus AS sparql_query, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders), b AS (SELECT *, pos * 10 AS question FROM a WHERE n < 3) SELECT a.task_id, a.sparql_query, a.pos, b.question AS abs_question FROM a LEFT JOIN b USING (task_id, sparql_query, n)")
def zip_sides(spark, d):
    """JN-9: orders of a customer and status meet those of a list that holds the first two of each."""
    nl = read(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("sparql_query"), F.col("o_orderkey").alias("pos"))
    from quillon.plans.skew import running

    some = running(nl, ["task_id", "sparql_query"], ["pos"], "k").where("k < 3").select("task_id", "sparql_query", "pos", (F.col("pos") * 10).alias("question"))
    return K.zip_sides(nl, some)


@query("attach_explanations", "WITH e AS (SELECT l_orderkey AS triple_key, CAST(min(l_linenumber) AS INTEGER) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey) SELECT o_orderkey AS triple_key, 'line ' || n AS explanation FROM orders LEFT JOIN e ON o_orderkey = triple_key")
def attach_explanations(spark, d):
    """JN-8: orders as questions with the first of their large lines as explanation."""
    e = read(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("triple_key"), F.col("l_linenumber").alias("n"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("explanation"))
    return K.attach(read(spark, d, "orders").select(F.col("o_orderkey").alias("triple_key")), e)


@query("contexts_of_questions", "SELECT c_custkey, coalesce(n_name, 'File not found: ' || c_custkey % 40) AS context FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40")
def contexts_of_questions(spark, d):
    """JN-10: customers with the nation of a number as context; some numbers have none."""
    q = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 40).cast("string").alias("root_entity"))
    c = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("root_entity"), F.col("n_name").alias("context"))
    return K.with_context(q, c, "context").select("c_custkey", "context")


@query("time_estimate", "SELECT event_type, count(*) * 3.0 / 8 AS nl, count(*) * 3.5 / 4 AS ttl FROM events GROUP BY event_type")
def time_estimate(spark, d):
    n = F.count("*")
    return read(spark, d, "events").groupBy("event_type").agg(S.time_estimate(n, 8).alias("nl"), S.time_estimate(n, 4, "ttl").alias("ttl"))


@query("distinct_questions", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_questions(spark, d):
    """AGG-9"""
    return read(spark, d, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


@query("abstract_categories", "WITH n AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_brand WHEN 1 THEN 'has' || p_name WHEN 2 THEN 'U' || p_partkey || 'x' WHEN 3 THEN '_Plain' WHEN 4 THEN 'Éclair' WHEN 5 THEN 'C9' || p_name WHEN 6 THEN '_partOf' ELSE p_name END AS term FROM part) SELECT p_partkey, CASE WHEN regexp_matches(term, '^[UPC][0-9]|[0-9]+$') THEN 'individual' WHEN regexp_matches(term, '^[A-Za-z]|(Of|For|By|To|From|With)$') THEN 'object_property' WHEN regexp_matches(term, '^\\p{Lu}') THEN 'class' ELSE 'object_property' END AS category FROM n")
def abstract_categories(spark, d):
    """ABS-4 by names alone."""
    k, p = F.col("p_partkey") % 8, F.col("p_name")
    term = F.when(k == 0, F.col("p_brand")).when(k == 1, F.concat(F.lit("has"), p)).when(k == 2, F.concat(F.lit("U"), F.col("p_partkey").cast("string"), F.lit("x"))).when(k == 3, "_Plain").when(k == 4, "Éclair").when(k == 5, F.concat(F.lit("C9"), p)).when(k == 6, "_partOf").otherwise(p)
    return read(spark, d, "part").select("p_partkey", B.heuristic(term).alias("category"))


@query("missed_terms", "SELECT DISTINCT p_brand AS term FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1)")
def missed_terms(spark, d):
    """JN-12: brands that no part of size one declares."""
    p = read(spark, d, "part")
    return B.missed(p.select(F.col("p_brand").alias("term")).distinct(), p.where("p_size = 1").select(F.col("p_brand").alias("term")).distinct())


@query("root_of_file", "SELECT page_id, 'Thing_' || page_id || CASE WHEN page_id % 4 = 3 THEN '.txt' ELSE '' END AS root_entity FROM pages")
def root_of_file(spark, d):
    k = F.col("page_id")
    name = F.concat(F.lit("Thing_"), k.cast("string"), F.when(k % 4 == 0, ".ttl").when(k % 4 == 1, ".OWL").when(k % 4 == 2, ".n3").otherwise(".txt"))
    return read(spark, d, "pages").select("page_id", U.root_of_file(name).alias("root_entity"))


@query("formats", "SELECT p_partkey, printf('%.1f%%', p_size * 2.0) AS rate, printf('%+.1f%%', (p_size - 25) * 4.0) AS difference, printf('%.6f', p_size / 64.0) AS p, printf('%d (%.1f%%)', p_size, p_size * 2.0) AS share FROM part")
def formats(spark, d):
    """STAT-8"""
    n = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", T.percent(n / 50.0).alias("rate"), T.signed_percent((n - 25) / 25.0).alias("difference"), T.p_text(n / 64.0).alias("p"), T.count_percent(n, F.lit(50)).alias("share"))


@query("question_prompts", "SELECT c_custkey, 'Write ' || CASE WHEN c_custkey % 3 = 0 THEN 'a yes-or-no question' WHEN c_custkey % 2 = 0 THEN 'a question for all classes of the individual' ELSE 'a question for all individuals so related' END || ' in English for this SPARQL query, and nothing else.' || chr(10) || 'Query: ' || c_name AS prompt FROM customer")
def question_prompts(spark, d):
    """SCR-16"""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", A.question_prompt(F.col("c_name"), F.when(k % 3 == 0, "BIN").otherwise("MC"), F.when(k % 2 == 0, "Membership").otherwise("Property Assertion")).alias("prompt"))


@query("file_names", "SELECT p_partkey, substr(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN 'Thing' ELSE array_to_string(list_sort([p_brand, p_type])[1:2], '_') END || '_' || p_name, '[^a-zA-Z0-9._-]', '_', 'g'), 1, 100) AS f FROM part")
def file_names(spark, d):
    """SNK-1, LIM-3: names of module files from types and individuals."""
    types = F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    return read(spark, d, "part").select("p_partkey", N.file_name(types, F.col("p_name")).alias("f"))
