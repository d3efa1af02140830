"""Queries over the test tables, one for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions import values as V
from accordant.operators import errors as E
from accordant.operators import facts as A
from accordant.operators import lookup as L
from accordant.operators import statistics as S
from accordant.operators import templates as T
from accordant.plans import orders_view as O
from accordant.sources import records as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str, side: str = "experiment") -> DataFrame:
    pred = A.legacy_side() if side == "legacy" else A.run(side)
    return A.field_facts(O.records(spark, sf_dir), O.schema(spark), pred)


def assays(spark: SparkSession) -> DataFrame:
    return R.assay_table(spark, O.ASSAYS)


def rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


WITH = f"WITH {O.sql_cells()} "
ACC3 = ("ontology_constrained_field_accuracy", "non_ontology_constrained_field_accuracy", "all_field_accuracy")
POOL3 = ("ontology_constrained_accuracy", "non_ontology_constrained_accuracy", "all_field_accuracy")


def _places(names: tuple, places: int = 2) -> str:
    return ", ".join(f"round_even({n} * {10**places}, 0) / {10.0**places} {n}" for n in names)


def _share(ok: str, kind: str | None) -> str:
    of = "" if kind is None else f" FILTER (WHERE field_type = '{kind}')"
    return f"coalesce(CAST(count_if({ok}){of} AS DOUBLE) / nullif(count(*){of}, 0), 0.0)"


def _accuracies(ok: str, names: tuple) -> str:
    return ", ".join(f"{_share(ok, kind)} {n}" for kind, n in zip(("ontology", "non_ontology", None), names))


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 9) {name}"


@query("field_results", WITH + "SELECT assay, record, field, field_type, e_ok is_correct FROM experiment")
def _(spark, sf_dir):
    return A.field_results(facts(spark, sf_dir))


RECORD_SQL = f"SELECT assay, record, {_accuracies('e_ok', ACC3)} FROM experiment GROUP BY assay, record"


@query("record_accuracy", WITH + f"SELECT assay, record, {', '.join(_r(n, n) for n in ACC3)} FROM ({RECORD_SQL})")
def _(spark, sf_dir):
    return rounded(A.record_accuracy(facts(spark, sf_dir)), *ACC3)


@query("raw_counts", WITH + "SELECT assay, count_if(field_type='ontology' AND e_ok) ontology_correct, count_if(field_type='ontology') ontology_total, count_if(field_type<>'ontology' AND e_ok) non_ontology_correct, count_if(field_type<>'ontology') non_ontology_total FROM experiment GROUP BY assay")
def _(spark, sf_dir):
    return A.field_counts(facts(spark, sf_dir), "assay")


LABELS = "(VALUES " + ", ".join(f"('{k}', '{n}')" for k, n in O.ASSAYS) + ") labels(key, label)"


@query("assay_summary", WITH + f"SELECT label assay, {', '.join(_r(f'avg({n})', n) for n in ACC3)} FROM ({RECORD_SQL}) r JOIN {LABELS} ON key = r.assay GROUP BY label")
def _(spark, sf_dir):
    return rounded(A.assay_summary(facts(spark, sf_dir), assays(spark), None), *ACC3)


@query("overall_summary", WITH + f"SELECT {_accuracies('e_ok', POOL3)} FROM experiment")
def overall_summary(spark, sf_dir):
    return A.overall_summary(facts(spark, sf_dir), None)


@query("assay_summary_rounded", WITH + f"SELECT label assay, {_places(ACC3)} FROM (SELECT assay, {', '.join(f'avg({n}) {n}' for n in ACC3)} FROM ({RECORD_SQL}) GROUP BY assay) r JOIN {LABELS} ON key = r.assay")
def _(spark, sf_dir):
    return A.assay_summary(facts(spark, sf_dir), assays(spark))


@query("overall_summary_rounded", WITH + f"SELECT {_places(POOL3)} FROM (SELECT {_accuracies('e_ok', POOL3)} FROM experiment)")
def _(spark, sf_dir):
    return A.overall_summary(facts(spark, sf_dir))


@query("uncorrected_summary", WITH + f"SELECT {_accuracies('l_ok', POOL3)} FROM uncorrected")
def _(spark, sf_dir):
    return A.overall_summary(facts(spark, sf_dir, "legacy"), None)


@query("uncorrected_populated", WITH + f"SELECT {_accuracies('l_ok', POOL3)} FROM uncorrected WHERE g_text IS NOT NULL")
def _(spark, sf_dir):
    return A.overall_summary(A.populated(facts(spark, sf_dir, "legacy")), None)


def _dedup(where: str = "") -> str:
    of = lambda kind: f" FILTER (WHERE field_type='{kind}')"
    return (
        f"SELECT round(coalesce(avg(share){of('ontology')}, 0), 9) {POOL3[0]}, round(coalesce(avg(share){of('non_ontology')}, 0), 9) {POOL3[1]}, round(coalesce(avg(share), 0), 9) {POOL3[2]}, "
        f"count(*){of('ontology')} n_ontology_pairs, count(*){of('non_ontology')} n_non_ontology_pairs, count(*) n_unique_pairs "
        f"FROM (SELECT field_type, avg(CAST(e_ok AS INT)) share FROM experiment {where} GROUP BY assay, field, value_key, field_type)"
    )


@query("dedup_summary", WITH + _dedup())
def _(spark, sf_dir):
    return rounded(A.dedup_summary(facts(spark, sf_dir)), *POOL3)


@query("dedup_populated", WITH + _dedup("WHERE g_text IS NOT NULL"))
def _(spark, sf_dir):
    return rounded(A.dedup_summary(A.populated(facts(spark, sf_dir))), *POOL3)


def _frequency(kind: str | None) -> None:
    where = "" if kind is None else f"WHERE field_type = '{kind}'"
    sql = WITH + (
        f", often AS (SELECT assay, field, value_key, count(*) n FROM marked GROUP BY ALL), each_one AS (SELECT CASE WHEN n = 1 THEN 'singleton' ELSE 'recurring' END bucket, e_ok FROM experiment JOIN often USING (assay, field, value_key) {where}) "
        "SELECT bucket, round(coalesce(avg(CAST(e_ok AS INT)), 0), 9) accuracy, count(e_ok) n_instances FROM (VALUES ('singleton'), ('recurring')) b(bucket) LEFT JOIN each_one USING (bucket) GROUP BY bucket"
    )

    @query("frequency_split" + ("" if kind is None else f"_{kind}"), sql)
    def _(spark, sf_dir):
        records = O.records(spark, sf_dir)
        found = A.field_facts(records, O.schema(spark), A.run("experiment"))
        gold = records.where(A.gold_side()).select("assay", "field", F.col("value").alias("gold"))
        return rounded(A.frequency_split(found, gold, kind), "accuracy")


for _kind in (None, "ontology", "non_ontology"):
    _frequency(_kind)

ERRORS = """, classified AS (SELECT *, CASE WHEN g_text IS NULL AND e_text IS NULL THEN NULL WHEN g_text IS NULL THEN 'hallucinated_non_null' WHEN e_text IS NULL THEN 'missed_non_null' WHEN e_ok THEN NULL
 WHEN g_tag <> e_tag THEN 'type_mismatch' WHEN g_tag <> 'str' THEN 'value_mismatch'
 WHEN lower(trim(g_text)) IN ('yes','no','true','false') AND lower(trim(e_text)) IN ('yes','no','true','false') THEN 'boolean_representation'
 WHEN ends_with(field, '_doi') AND regexp_matches(g_text, '^https?://(dx\\.)?doi\\.org/') <> regexp_matches(e_text, '^https?://(dx\\.)?doi\\.org/') THEN 'doi_format'
 WHEN lower(regexp_replace(g_text, '[\\s_\\-]+', '', 'g')) = lower(regexp_replace(e_text, '[\\s_\\-]+', '', 'g')) THEN 'delimiter_or_case'
 WHEN len(regexp_extract_all(g_text, '[0-9]+')) > 0 AND regexp_extract_all(g_text, '[0-9]+') = regexp_extract_all(e_text, '[0-9]+') THEN 'numeric_format_in_string' ELSE 'wrong_value' END error_type FROM experiment),
 wrong AS (SELECT *, CASE WHEN field_type = 'ontology' THEN 'ontology-constrained' ELSE 'non-ontology-constrained' END kind FROM classified WHERE error_type IS NOT NULL)"""


def flat(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"gold_value": F.col("gold_value.text"), "predicted_value": F.col("predicted_value.text")})


@query("error_rows", WITH + ERRORS + " SELECT assay, record file, field, error_type, kind field_type, required, g_text gold_value, e_text predicted_value FROM wrong")
def _(spark, sf_dir):
    return flat(E.error_rows(facts(spark, sf_dir)))


@query("error_report", WITH + ERRORS + " SELECT error_type, kind field_type, field || ': ' || coalesce(g_text, 'None') expected_value, field || ': ' || coalesce(e_text, 'None') predicted_value, count(*) frequency, string_agg(DISTINCT assay, ', ' ORDER BY assay) assays FROM wrong GROUP BY ALL")
def _(spark, sf_dir):
    return E.error_report(E.error_rows(facts(spark, sf_dir)))


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = O.records(spark, sf_dir)
    rows = E.error_rows(A.field_facts(records, O.schema(spark), A.run("experiment")))
    terms = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, O.EMPTY_TERMS))).alias("term"))
    return E.error_detail(rows, E.legacy_maps(records), terms)


CAUSES = ERRORS + """, old AS (SELECT record, list(coalesce(lower(trim(l_text)), '')) || [CASE WHEN min(k) % 2 = 0 THEN 'x' ELSE 'y' END] held FROM marked WHERE k % 23 <> 0 AND field NOT IN ('price', 'note') GROUP BY record),
 asked AS (SELECT w.*, coalesce(lower(trim(g_text)), '') g, coalesce(lower(trim(e_text)), '') p, CASE WHEN k % 23 <> 0 THEN coalesce(lower(trim(l_text)), '') ELSE '' END own, coalesce(held, []) held FROM wrong w LEFT JOIN old USING (record)),
 caused AS (SELECT *, CASE WHEN own IN ('1-urgent', '5-low') AND field_type = 'ontology' AND p = own THEN 'missing_ontology_result'
 WHEN error_type IN ('boolean_representation', 'delimiter_or_case', 'doi_format', 'numeric_format_in_string') THEN 'format_or_variant'
 WHEN p <> '' AND list_contains(held, p) AND own <> p THEN 'field_mapping_confusion'
 WHEN g <> '' AND field_type <> 'ontology' AND len(list_filter(held, lambda v: v <> '' AND contains(v, g))) = 0 THEN 'external_information_required' ELSE 'other' END cause FROM asked)"""


@query("error_detail", WITH + CAUSES + " SELECT assay, record file, field, error_type, kind field_type, required, g_text gold_value, e_text predicted_value, cause FROM caused")
def _(spark, sf_dir):
    return flat(detail(spark, sf_dir))


for _key, _sql in (("error_type", ERRORS + " SELECT kind field_type, error_type, count(*) count FROM wrong GROUP BY ALL"), ("cause", CAUSES + " SELECT kind field_type, cause, count(*) count FROM caused GROUP BY ALL")):

    def _summary(spark, sf_dir, key=_key):
        return E.summarise(detail(spark, sf_dir), key)

    query(f"{_key}_summary", WITH + _sql.replace(" SELECT kind", " SELECT *, round(100.0 * count / sum(count) OVER (), 1) pct_of_all_errors FROM (SELECT kind") + ")")(_summary)


@query("missed_required", WITH + ERRORS + " SELECT kind field_type, count(*) n_missed, count_if(required) n_required FROM wrong WHERE error_type = 'missed_non_null' GROUP BY kind")
def _(spark, sf_dir):
    return E.missed_required(E.error_rows(facts(spark, sf_dir)))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = {"gold": A.gold_side(), "base": A.run("baseline"), "arms": A.run("experiment")}
    cells = A.with_schema(A.aligned(O.records(spark, sf_dir), sides, ["base", "arms"]), O.schema(spark))
    return S.paired_counts(A.with_outcomes(cells))


PAIRED = ", cats AS (SELECT *, unnest([field_type, 'all']) category FROM both_runs), pairs AS (SELECT assay, record, category, count_if(b_ok) base_correct, count_if(e_ok) arms_correct, count(*) total, count_if(b_ok AND NOT e_ok) base_only, count_if(e_ok AND NOT b_ok) arms_only FROM cats GROUP BY assay, record, category)"


@query("paired_counts", WITH + PAIRED + " SELECT * FROM pairs")
def _(spark, sf_dir):
    return paired(spark, sf_dir)


@query("record_means", WITH + PAIRED + " SELECT category, count(*) n_records, round(avg(base_correct / total), 9) base_mean, round(avg(arms_correct / total), 9) arms_mean FROM pairs GROUP BY category")
def _(spark, sf_dir):
    return rounded(S.record_means(paired(spark, sf_dir)), "base_mean", "arms_mean")


MCNEMAR = "CASE WHEN b + c = 0 THEN NULL WHEN b + c < 25 THEN CAST(least(b, c) AS DOUBLE) ELSE pow(abs(b - c) - 1, 2) / (b + c) END"


@query("mcnemar", WITH + PAIRED + f" SELECT *, b + c n_discordant, round({MCNEMAR}, 9) statistic FROM (SELECT category, CAST(sum(base_only) AS BIGINT) b, CAST(sum(arms_only) AS BIGINT) c FROM pairs GROUP BY category)")
def _(spark, sf_dir):
    return rounded(S.mcnemar_counts(paired(spark, sf_dir), "category"), "statistic")


@query("mcnemar_labels", f"SELECT *, b + c n_discordant, round({MCNEMAR}, 9) statistic FROM (SELECT count_if(quality = 1 AND toxic = 0) b, count_if(quality = 0 AND toxic = 1) c FROM labels)")
def _(spark, sf_dir):
    ok = lambda x: F.col(x) == 1
    rows = table(spark, sf_dir, "labels").select((ok("quality") & ~ok("toxic")).cast("long").alias("base_only"), (ok("toxic") & ~ok("quality")).cast("long").alias("arms_only"))
    return rounded(S.mcnemar_counts(rows), "statistic")


#: Two-sided normal tail of z by Simpson's rule.
TAIL = "(1 - list_sum(list_transform(range(0, 801), lambda i: CASE WHEN i = 0 OR i = 800 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({z} / sqrt(2) * i / 800, 2)))) * {z} / sqrt(2) / 2400 * 2 / sqrt(pi()))"


@query("mcnemar_p", WITH + PAIRED + f" SELECT category, b, c, round(CASE WHEN x > 144 THEN 0 ELSE {TAIL.format(z='sqrt(x)')} END, 7) p FROM (SELECT *, {MCNEMAR} x FROM (SELECT category, CAST(sum(base_only) AS BIGINT) b, CAST(sum(arms_only) AS BIGINT) c FROM pairs GROUP BY category))")
def _(spark, sf_dir):
    return rounded(S.with_mcnemar_p(S.mcnemar_counts(paired(spark, sf_dir), "category")).select("category", "b", "c", "p"), "p", places=7)


@query("mcnemar_exact", """SELECT *, CASE WHEN b + c = 0 THEN 1 ELSE round(least(1, 2 * list_sum(list_transform(range(0, CAST(least(b, c) AS BIGINT) + 1), lambda i: CAST(factorial(CAST(b + c AS INT)) AS DOUBLE) / factorial(CAST(i AS INT)) / factorial(CAST(b + c - i AS INT)))) / pow(2, b + c)), 9) END p
 FROM (SELECT doc_id % 40 part, CAST(count_if(quality = 1 AND toxic = 0) AS BIGINT) b, CAST(count_if(quality = 0 AND toxic = 1) AS BIGINT) c FROM labels WHERE doc_id % 40 >= 0 GROUP BY 1) WHERE b + c < 25""")
def _(spark, sf_dir):
    ok = lambda x: F.col(x) == 1
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("part"), (ok("quality") & ~ok("toxic")).cast("long").alias("base_only"), (ok("toxic") & ~ok("quality")).cast("long").alias("arms_only"))
    return rounded(S.with_mcnemar_p(S.mcnemar_counts(rows, "part").where("n_discordant < 25")).select("part", "b", "c", "p"), "p")


@query("wilcoxon_p", WITH + PAIRED + f""", d AS (SELECT category, arms_correct / total - base_correct / total d FROM pairs), g AS (SELECT category, abs(d) size, count(*) t, count_if(d > 0) up FROM d WHERE d <> 0 GROUP BY ALL),
 r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY category ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 rank FROM g),
 w AS (SELECT category, sum(t)::DOUBLE n, sum(t::DOUBLE * t * t - t) ties, least(sum(rank * up), sum(rank * (t - up)))::DOUBLE w FROM r GROUP BY category), z AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) z FROM w)
 SELECT category, round(CASE WHEN z > 12 THEN 0 ELSE {TAIL.format(z='z')} END, 7) p FROM z""")
def _(spark, sf_dir):
    return rounded(S.with_wilcoxon_p(S.wilcoxon_ranks(paired(spark, sf_dir), "category")).select("category", "p"), "p", places=7)


@query("wilcoxon", WITH + PAIRED + """, d AS (SELECT category, arms_correct / total - base_correct / total d FROM pairs), g AS (SELECT category, abs(d) size, count(*) t, count_if(d > 0) up FROM d WHERE d <> 0 GROUP BY ALL),
 r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY category ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 rank FROM g)
 SELECT category, sum(rank * up)::DOUBLE w_plus, sum(rank * (t - up))::DOUBLE w_minus, sum(t)::BIGINT n_nonzero, sum(t::DOUBLE * t * t - t) tie_sum, least(sum(rank * up), sum(rank * (t - up)))::DOUBLE statistic FROM r GROUP BY category""")
def _(spark, sf_dir):
    return S.wilcoxon_ranks(paired(spark, sf_dir), "category")


@query("effective_n", WITH + """, cl AS (SELECT count(*)::DOUBLE m, sum(e_ok::INT)::DOUBLE c FROM experiment GROUP BY assay, field, value_key), s AS (SELECT sum(m) n, count(*)::DOUBLE k, sum(m*m) mm, sum(c) c, sum(c*c/m) ccm FROM cl),
 v AS (SELECT *, (ccm - c*c/n) / (k-1) msb, (c - ccm) / (n-k) msw, (n - mm/n) / (k-1) m0 FROM s), i AS (SELECT *, CASE WHEN msb + (m0-1)*msw > 0 THEN greatest(0, (msb-msw) / (msb + (m0-1)*msw)) ELSE 0 END icc FROM v)
 SELECT n::BIGINT n, k::BIGINT n_clusters, round(icc, 6) icc, round(1 + (n/k - 1)*icc, 6) design_effect, round(n / (1 + (n/k - 1)*icc), 3) n_effective FROM i""")
def _(spark, sf_dir):
    out = S.effective_sample_size(facts(spark, sf_dir))
    return rounded(rounded(out, "icc", "design_effect", places=6), "n_effective", places=3)


@query("overall_table")
def _(spark, sf_dir):
    return S.overall_table(paired(spark, sf_dir))


@query("per_assay_table")
def _(spark, sf_dir):
    return S.per_assay_table(paired(spark, sf_dir), assays(spark))


SCORES = f", b AS (SELECT assay, record, 'baseline' run_type, {_share('b_ok', None)} score FROM baseline GROUP BY ALL UNION ALL SELECT assay, record, 'experiment', {_share('e_ok', None)} FROM experiment GROUP BY ALL)"
RANGES = " SELECT assay, run_type, avg(score) mean, min(score) low, max(score) high, count(*) n_records FROM b GROUP BY ALL"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_scores(A.run_facts(O.records(spark, sf_dir), O.schema(spark), list(O.RUNS)))


@query("plot_stats", WITH + SCORES + f" SELECT assay, run_type, {_r('mean', 'mean')}, {_r('low', 'low')}, {_r('high', 'high')}, n_records FROM ({RANGES})")
def _(spark, sf_dir):
    return rounded(A.score_ranges(scores(spark, sf_dir)), "mean", "low", "high")


@query("plot_chart", WITH + SCORES + f" SELECT label assay, r.run_type, round(coalesce(mean, 0), 9) mean, round(coalesce(low, 0), 9) low, round(coalesce(high, 0), 9) high FROM {LABELS} CROSS JOIN (VALUES ('baseline'), ('experiment'), ('none')) r(run_type) LEFT JOIN ({RANGES}) x ON x.assay = key AND x.run_type = r.run_type")
def _(spark, sf_dir):
    return rounded(A.chart_rows(A.score_ranges(scores(spark, sf_dir)), assays(spark), [*O.RUNS, "none"]), "mean", "low", "high")


@query("plot_intervals")
def _(spark, sf_dir):
    return S.score_intervals(scores(spark, sf_dir))


@query("empty_terms", "SELECT lower(trim(term)) term FROM (SELECT event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%d') term, CASE WHEN k < 50 THEN 0 ELSE k END total FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events)) GROUP BY 1 HAVING max(total) = 0")
def _(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    term = F.concat_ws("|", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    return E.empty_search_terms(table(spark, sf_dir, "events").select(term.alias("term"), F.when(k < 50, 0).otherwise(k).alias("total")))


@query("best_term", """SELECT p_type, p_partkey pos, label, iri, CAST(round(score, 6) AS DOUBLE) score FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) r FROM (
 SELECT p_type, p_partkey, p_name AS label, p_brand iri, CASE WHEN lower(trim(p_name)) = q THEN 1.0 WHEN contains(lower(trim(p_name)), q) OR contains(q, lower(trim(p_name))) THEN 0.7
 WHEN lower(p_brand) = q THEN 0.6 WHEN contains(lower(p_brand), q) OR contains(q, lower(p_brand)) THEN 0.4 ELSE 0.1 END - CASE WHEN p_size % 5 = 0 THEN 0.2 ELSE 0 END score
 FROM (SELECT *, substr(lower(trim(p_brand)), 7, 1) q FROM part))) WHERE r = 1 AND score >= 0.3""")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select("p_type", F.substring(F.lower(F.trim("p_brand")), 7, 1).alias("query"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"), F.array("p_brand").alias("synonyms"), (F.col("p_size") % 5 == 0).alias("obsolete"), F.col("p_brand").alias("iri"))
    best = L.best_terms(rows, "p_type")
    where = rows.select("p_type", "label", "iri", "pos", "query", "synonyms", "obsolete").withColumn("score", L.term_score(F.col("query"), F.col("label"), F.col("synonyms"), F.col("obsolete")))
    first = where.groupBy("p_type", "label", "iri", "score").agg(F.min("pos").alias("pos"))
    return rounded(best.join(first, ["p_type", "label", "iri", "score"]).select("p_type", "pos", "label", "iri", "score"), "score", places=6)


@query("final_response", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY conv_id")
def _(spark, sf_dir):
    return L.final_responses(table(spark, sf_dir, "conversations"))


#: Seconds of `ts` since 1970, whatever the session's time zone.
SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat_ws("|", "user_id", "event_type").alias("key"), F.expr(SECONDS).cast("double").alias("created_at"), F.lit(L.DAY).alias("ttl"), F.col("event_id").alias("event_id"), (F.col("event_id") % 50 == 0).alias("is_error"))


CACHE = "WITH e AS (SELECT user_id || '|' || event_type AS key, CAST(floor(epoch_us(ts) / 1e6) AS DOUBLE) created_at, 86400 ttl, event_id FROM events WHERE event_id % 50 <> 0), latest AS (SELECT key, created_at, ttl, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, event_id DESC) r FROM e) WHERE r = 1), t AS (SELECT CAST(floor(epoch_us(max(ts)) / 1e6) AS DOUBLE) now FROM events) "


def cache_now(spark: SparkSession, sf_dir: str) -> Column:
    return F.lit(table(spark, sf_dir, "events").agg(F.max(F.expr(SECONDS).cast("double"))).first()[0])


@query("cache_latest", CACHE + "SELECT * FROM latest")
def _(spark, sf_dir):
    return L.cache_latest(cache_entries(spark, sf_dir), "event_id")


@query("cache_get", CACHE + "SELECT latest.*, TRUE cached, round(now - created_at, 1) cache_age_seconds FROM latest, t WHERE now - created_at <= ttl")
def _(spark, sf_dir):
    return L.cache_get(L.cache_latest(cache_entries(spark, sf_dir), "event_id"), cache_now(spark, sf_dir))


@query("cache_stale", CACHE + "SELECT count_if(now - created_at > ttl) removed_count, count_if(now - created_at <= ttl) remaining_count FROM latest, t")
def _(spark, sf_dir):
    return L.cache_remove_stale(L.cache_latest(cache_entries(spark, sf_dir), "event_id"), cache_now(spark, sf_dir))


MODEL_OF_ROLE = {"system": "gpt-4o-mini-2024-07-18", "user": "gpt-4.1-nano", "assistant": "unknown-1"}


@query("token_cost", """SELECT role, sum(prompt)::BIGINT prompt_tokens, sum(completion)::BIGINT completion_tokens, sum(prompt + completion)::BIGINT total_tokens, round(sum(prompt / 1e6 * pin + completion / 1e6 * pout), 6) cost
 FROM (SELECT role, length(text) prompt, turn completion, CASE role WHEN 'system' THEN 2.5 WHEN 'user' THEN 0.1 ELSE 0 END pin, CASE role WHEN 'system' THEN 10 WHEN 'user' THEN 0.4 ELSE 0 END pout FROM conversations) GROUP BY role""")
def _(spark, sf_dir):
    model = F.when(F.lit(False), "")
    for role, name in MODEL_OF_ROLE.items():
        model = model.when(F.col("role") == role, name)
    usage = table(spark, sf_dir, "conversations").select("role", model.alias("model"), F.length("text").cast("long").alias("prompt"), F.col("turn").cast("long").alias("completion"))
    return rounded(L.token_costs(usage, "role"), "cost", places=6)


@query("stratified_sample", "SELECT source, name FROM (SELECT lang AS source, CAST(doc_id AS VARCHAR) AS name, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), CAST(doc_id AS VARCHAR)) r FROM documents WHERE lang IS NOT NULL) WHERE r <= 25")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("doc_id").cast("string").alias("name"))
    return L.exact_sample(names, names.select("source").distinct().withColumn("n", F.lit(25)), 7).select("source", "name")


@query("pairing_check", "SELECT lang AS source, count_if(l.doc_id IS NOT NULL) n_paired, count_if(l.doc_id IS NULL) n_unmatched FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null and doc_id is not null").select(F.col("lang").alias("source"), F.col("doc_id").alias("name"))
    known = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name")), "name", "left_semi")
    both, _ = L.paired_names(docs, known)
    counts = both.groupBy("source").agg(F.count("*").alias("n_paired")).join(L.unmatched_counts(docs, known), "source", "full")
    return counts.select("source", F.coalesce("n_paired", F.lit(0)).cast("long").alias("n_paired"), F.coalesce("n_unmatched", F.lit(0)).cast("long").alias("n_unmatched"))


@query("value_match_flags", "SELECT p_partkey, p_type = p_brand whole_word, contains(p_type, split_part(p_type, ' ', 1)) inside, lower(p_type) = p_type same_case, TRUE folded FROM part")
def _(spark, sf_dir):
    v = lambda c: V.value("str", c)
    match = lambda p, g, **k: V.values_match(v(p), v(g), F.lit("name"), **k)
    kind = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", match(kind, F.col("p_brand")).alias("whole_word"), match(kind, F.split_part(kind, F.lit(" "), F.lit(1)), match_whole_word=False).alias("inside"), match(F.lower(kind), kind).alias("same_case"), match(F.lower(kind), kind, match_case=False).alias("folded"))


@query("doi_normalise", "SELECT o_orderkey, replace('https://doi.org/10.1/' || o_custkey, 'https://doi.org/', 'https://dx.doi.org/') doi FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.normalise_doi(F.concat(F.lit("https://doi.org/10.1/"), "o_custkey")).alias("doi"))


@query("sanitise_names", "SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN 'f_' || n ELSE n END AS name FROM (SELECT p_partkey, regexp_replace(p_size || ' ' || p_type, '[^a-zA-Z0-9_]', '_', 'g') n FROM part)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.sanitise_name(F.concat_ws(" ", "p_size", "p_type")).alias("name"))


@query("shortened_texts", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS short FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.shortened(F.col("text")).alias("short"))


@query("formatted", "SELECT o_orderkey, printf('%.2f [%.2f, %.2f]', x, x - 1, x + 1) ci, CASE WHEN x < 0.001 THEN '<0.001' ELSE printf('%.3f', x) END p FROM (SELECT o_orderkey, (o_orderkey % 64) / 64.0 x FROM orders)")
def _(spark, sf_dir):
    x = (F.col("o_orderkey") % 64) / 64
    return table(spark, sf_dir, "orders").select("o_orderkey", V.format_interval(x, x - 1, x + 1).alias("ci"), V.format_p(x).alias("p"))


@query("cache_keys", """SELECT event_id, sha256('{"func_name": "search", "params": {"event": "' || event_type || '", "user": "' || user_id || '"}}') cache_key FROM events""")
def _(spark, sf_dir):
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", V.cache_key(F.lit("search"), params).alias("cache_key"))


@query("picked_terms", """SELECT p_type AS query, p_brand AS acronym, CASE WHEN cached THEN 'cached' ELSE label END label, CASE WHEN cached THEN 'c' ELSE iri END iri, cached from_cache FROM (SELECT p_type, p_brand, min(p_partkey) % 2 = 0 cached FROM part GROUP BY ALL)
 LEFT JOIN (SELECT p_brand, p_name AS label, CAST(p_partkey AS VARCHAR) iri, p_type FROM (SELECT t.p_brand, t.p_name, t.p_partkey, q.p_type, row_number() OVER (PARTITION BY q.p_type, q.p_brand ORDER BY CASE WHEN lower(t.p_name) = lower(q.p_type) THEN 1.0 WHEN contains(lower(t.p_name), lower(q.p_type)) OR contains(lower(q.p_type), lower(t.p_name)) THEN 0.7 WHEN lower(t.p_type) = lower(q.p_type) THEN 0.6
 WHEN contains(lower(t.p_type), lower(q.p_type)) OR contains(lower(q.p_type), lower(t.p_type)) THEN 0.4 ELSE 0.1 END DESC, t.p_partkey) r FROM part t JOIN (SELECT DISTINCT p_type, p_brand FROM part) q USING (p_brand)) WHERE r = 1) USING (p_type, p_brand)""")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    terms = part.select(F.col("p_brand").alias("acronym"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"), F.array("p_type").alias("synonyms"), F.lit(False).alias("obsolete"), F.col("p_partkey").cast("string").alias("iri"))
    asked = part.groupBy(F.col("p_type").alias("query"), F.col("p_brand").alias("acronym")).agg(F.min("p_partkey").alias("least"))
    known = asked.where("least % 2 = 0").select(L.pick_key("query", "acronym").alias("key"), F.lit(0.0).alias("created_at"), F.lit(L.DAY).alias("ttl"), F.lit("cached").alias("label"), F.lit("c").alias("iri"))
    return L.picked_terms(asked, terms, known, F.lit(60.0), False)


def region_templates(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a template for each region, whose fields are the region's nations, and a record of each nation's suppliers."""
    folder = R.scratch_folder(spark, "templates")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").select("r_name", "n_name", "n_nationkey").collect()
    for region in sorted({r["r_name"] for r in rows}):
        nations = [{"name": r["n_name"], "type": "integer" if r["n_nationkey"] % 2 else "string", "required": r["n_nationkey"] % 2 == 0, "permissible_values": [{"type": ("branch", "ontology", "value")[r["n_nationkey"] % 3], "ontology_acronym": r["n_name"][:3]}]} for r in rows if r["r_name"] == region]
        place = {"name": "place", "type": "element", "multivalued": True, "children": nations}
        R.write_text(spark, f"{folder}/schemas/{region}.json", json.dumps({"type": "template", "name": region, "children": [*nations, place]}))
    return folder


NATIONS = "(SELECT r_name, n_name, n_nationkey k, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY r_name) n FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("schema_fields", f"SELECT r_name assay, n_name field, k % 3 < 2 is_ontology, k % 2 = 0 required, i ord FROM {NATIONS} UNION ALL SELECT r_name, 'place', FALSE, FALSE, max(n) FROM {NATIONS} GROUP BY r_name")
def _(spark, sf_dir):
    return R.read_templates(spark, region_templates(spark, sf_dir))


@query("flatten_template", f"SELECT r_name assay, i ord, n_name field FROM {NATIONS} UNION ALL SELECT r_name, i + n, 'place.' || n_name FROM {NATIONS}")
def _(spark, sf_dir):
    rows = [(assay, i, name) for assay, t in R.load_templates(spark, region_templates(spark, sf_dir)) for i, name in enumerate(T.field_names(t))]
    return spark.createDataFrame(rows, "assay string, ord int, field string")


@query("ontology_instructions", f"SELECT r_name assay, '- ' || p || n_name || ': value should be one of the ' || left(n_name, 3) || ' ontology concepts' line FROM {NATIONS}, (VALUES (''), ('place.')) v(p) WHERE k % 3 = 0")
def _(spark, sf_dir):
    rows = [(assay, line) for assay, t in R.load_templates(spark, region_templates(spark, sf_dir)) for line in T.instructions(t)]
    return spark.createDataFrame(rows, "assay string, line string")


@query("template_schema", f"""SELECT r_name assay, n_name field, CASE WHEN k % 2 = 1 THEN 'bigint' ELSE 'string' END AS type FROM {NATIONS}
 UNION ALL SELECT r_name, 'place', 'array<struct<' || string_agg(n_name || ':' || CASE WHEN k % 2 = 1 THEN 'bigint' ELSE 'string' END, ',' ORDER BY k) || '>>' FROM {NATIONS} GROUP BY r_name""")
def _(spark, sf_dir):
    rows = [(assay, f.name, ",".join(f.dataType.simpleString().split(","))) for assay, t in R.load_templates(spark, region_templates(spark, sf_dir)) for f in T.schema_of(t)]
    return spark.createDataFrame(rows, "assay string, field string, type string")


@query("json_records", "SELECT n_name AS record_name, 'AF' assay, role, field, tag, text FROM nation, LATERAL (VALUES ('gold', 'key', 'int', CAST(n_nationkey AS VARCHAR)), ('gold', 'name', 'str', n_name || ' \"é😀\"'), ('gold', 'none', NULL, NULL), ('input', 'share', 'float', n_regionkey || '.5'), ('input', 'odd', 'bool', CASE WHEN n_nationkey % 2 = 1 THEN 'true' ELSE 'false' END)) v(role, field, tag, text)")
def _(spark, sf_dir):
    k = F.col("n_nationkey")
    text = lambda tag, x, num=None: V.value(tag, x, num)
    cells = [("gold", "key", text("int", k.cast("string"), k)), ("gold", "name", text("str", F.concat("n_name", F.lit(' "é😀"')))), ("gold", "none", V.no_value()), ("input", "share", text("float", F.concat("n_regionkey", F.lit(".5")), k)), ("input", "odd", text("bool", (k % 2 == 1).cast("string"), k))]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(f).alias("field"), v.alias("value")) for r, f, v in cells]))
    rows = table(spark, sf_dir, "nation").select(F.lit("AF").alias("assay"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("run_type"), F.col("n_name").alias("record"), each.alias("c")).select("assay", "model", "run_type", "record", "c.*")
    folder = R.scratch_folder(spark, "records")
    R.write_records(rows, folder)
    read = R.read_json_records(spark, folder)
    return read.select(F.regexp_replace("record", r"\.json$", "").alias("record_name"), "assay", "role", "field", "value.tag", "value.text")


TEMPLATE = {
    "type": "template", "name": "Orders", "children": [
        {"name": "status", "type": "string", "required": True, "permissible_values": [{"type": "branch", "ontology_acronym": "ORD"}]},
        {"name": "count", "type": "integer", "required": False},
        {"name": "ship", "type": "element", "multivalued": True, "children": [{"name": "city", "type": "string", "permissible_values": [{"type": "branch", "ontology_acronym": "GEO"}, {"type": "ontology", "ontology_acronym": "X"}]}, {"name": "on", "type": "date"}]},
    ],
}


@query("strict_records", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'missing ship' WHEN o_orderkey % 3 = 1 THEN 'unknown x' ELSE '' END problems, CASE WHEN o_orderkey % 3 = 2 THEN o_custkey END count FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    head = F.concat(F.lit('{"status": null, "count": '), "o_custkey")
    raw = F.concat(head, F.when(k % 3 == 0, "}").when(k % 3 == 1, ', "ship": [], "x": 1}').otherwise(', "ship": [{"city": "A", "on": null}]}'))
    found = T.validated(table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("value")), TEMPLATE)
    return found.select("o_orderkey", F.array_join("problems", ", ").alias("problems"), F.col("parsed.count").alias("count"))


@query("prompts")
def _(spark, sf_dir):
    record = {"a": 1, "b": None}
    return spark.createDataFrame([("agent", T.agent_prompt(record, "iri", "target")), ("baseline", T.baseline_prompt(record, TEMPLATE))], "kind string, prompt string")

