"""Errors of predictions: their labels, their likely causes, and summaries of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.functions.values import FORMAT_LABELS, classify_error, normalised
from accordant.operators.facts import KEY, ONTOLOGY

#: How trace logs write a search and the number of its results.
SEARCH_STRING = r"'search_string':\s*'((?:[^'\\]|\\.)*)'"
TOTAL_COUNT = r'"totalCount":\s*(\d+)'

TYPES = {True: "ontology-constrained", False: "non-ontology-constrained"}


def error_rows(facts: DataFrame) -> DataFrame:
    """(assay, file, field, error_type, field_type, required, gold_value, predicted_value) of each wrong field."""
    kind = F.when(F.col("field_type") == ONTOLOGY, TYPES[True]).otherwise(TYPES[False])
    label = classify_error(F.col("field"), F.col("gold"), F.col("pred"))
    rows = facts.withColumns({"error_type": label, "kind": kind}).where(F.col("error_type").isNotNull())
    return rows.select("assay", F.col("record").alias("file"), "field", "error_type", F.col("kind").alias("field_type"), "required", F.col("gold").alias("gold_value"), F.col("pred").alias("predicted_value"))


def error_report(rows: DataFrame) -> DataFrame:
    """Frequency of each (error, type, expected, predicted) with its assays, the most frequent first."""
    shown = lambda c: F.concat("field", F.lit(": "), F.coalesce(F.col(f"{c}.text"), F.lit("None")))
    by = ["error_type", "field_type", shown("gold_value").alias("expected_value"), shown("predicted_value").alias("predicted_value")]
    grouped = rows.groupBy(*by).agg(F.count("*").alias("frequency"), F.array_join(F.array_sort(F.collect_set("assay")), ", ").alias("assays"))
    return grouped.orderBy(F.desc("frequency"), "error_type", "field_type", "expected_value", "predicted_value")


def legacy_maps(records: DataFrame) -> DataFrame:
    """(assay, record, legacy): normalised legacy values by field, empty ones included."""
    entries = F.collect_list(F.struct("field", normalised(F.col("value")).alias("v")))
    return records.where(F.col("role") == "input").groupBy(*KEY).agg(F.map_from_entries(entries).alias("legacy"))


def classify_cause(ontology: Column, error_type: Column, gold: Column, pred: Column, own: Column, legacy: Column, is_empty_term: Column) -> Column:
    """The first cause that applies; all strings are normalised, own is the legacy value of the same field.

    is_empty_term: whether `own` is a term that no search found; null where searches aren't known.
    """
    holds = F.exists(F.map_values(legacy), lambda v: v == pred)
    gives = F.exists(F.map_values(legacy), lambda v: (v != "") & F.contains(v, gold))
    return (
        F.when(F.coalesce(is_empty_term, F.lit(False)) & ontology & (own != "") & (pred == own), "missing_ontology_result")
        .when(error_type.isin(*FORMAT_LABELS), "format_or_variant")
        .when((pred != "") & holds & (own != pred), "field_mapping_confusion")
        .when((gold != "") & ~ontology & ~gives, "external_information_required")
        .otherwise("other")
    )


def error_detail(rows: DataFrame, legacy: DataFrame, empty_terms: DataFrame | None = None) -> DataFrame:
    """Error rows with their cause; a record without a legacy one has no legacy values.

    empty_terms: (term), normalised; left out where searches aren't known, as for baselines.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    joined = rows.join(legacy.withColumnRenamed("record", "file"), ["assay", "file"], "left").withColumn("legacy", F.coalesce("legacy", none))
    joined = joined.withColumn("own", F.coalesce(F.try_element_at("legacy", F.col("field")), F.lit("")))
    if empty_terms is not None:
        joined = joined.join(empty_terms.select(F.col("term").alias("own"), F.lit(True).alias("_empty")).distinct(), "own", "left")
    else:
        joined = joined.withColumn("_empty", F.lit(None).cast("boolean"))
    cause = classify_cause(F.col("field_type") == TYPES[True], F.col("error_type"), normalised(F.col("gold_value")), normalised(F.col("predicted_value")), F.col("own"), F.col("legacy"), F.col("_empty"))
    return joined.withColumn("cause", cause).select(*rows.columns, "cause")


def summarise(detail: DataFrame, key: str) -> DataFrame:
    """(field_type, key, count, pct_of_all_errors), the most frequent first."""
    counts = detail.groupBy("field_type", key).agg(F.count("*").alias("count"))
    share = F.round(100 * F.col("count") / F.sum("count").over(Window.partitionBy()), 1)  # over a few rows
    return counts.withColumn("pct_of_all_errors", share).orderBy(F.desc("count"), "field_type", key)


def missed_required(detail: DataFrame) -> DataFrame:
    """Missed values by type of field, and how many of them are required."""
    missed = detail.where(F.col("error_type") == "missed_non_null")
    return missed.groupBy("field_type").agg(F.count("*").alias("n_missed"), F.sum(F.col("required").cast("long")).alias("n_required"))


def empty_search_terms(searches: DataFrame) -> DataFrame:
    """(term) of searches (term, total) that never had a result; terms are normalised."""
    term = F.lower(F.regexp_replace("term", r"(?U)^\s+|\s+$", ""))
    return searches.groupBy(term.alias("term")).agg(F.max("total").alias("most")).where(F.col("most") == 0).select("term")


def searches_of(traces: DataFrame) -> DataFrame:
    """(term, total) of tool rows of a trace log whose name has term_search; a count that isn't there is 0."""
    rows = traces.where((F.col("run_type") == "tool") & F.contains("name", F.lit("term_search")) & F.rlike("inputs", F.lit(SEARCH_STRING)))
    term = F.replace(F.regexp_extract("inputs", SEARCH_STRING, 1), F.lit("\\'"), F.lit("'"))
    total = F.coalesce(F.regexp_extract(F.coalesce("outputs", F.lit("")), TOTAL_COUNT, 1).try_cast("long"), F.lit(0))
    return rows.select(term.alias("term"), total.alias("total"))
