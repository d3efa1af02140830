"""Gold, predicted and legacy records made of the orders table by arithmetic, so that SQL can make the same ones.

A record is an order, its assay the order's priority. Each prediction run spoils field f of record k where k + f is
divisible by 7 (baseline) or 11 (experiment), each field in its own way; beside that, statuses of some records differ
in case alone. Some records lack a run or a legacy record. The expressions below are SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSAYS = [("1-URGENT", "Urgent"), ("2-HIGH", "High"), ("3-MEDIUM", "Medium"), ("4-NOT SPECIFIED", "Not specified"), ("5-LOW", "Low")]
#: Field, constrained by a vocabulary, required.
FIELDS = [
    ("status", True, True), ("priority", True, False), ("is_open", False, True), ("ref_doi", False, False),
    ("dims", False, False), ("custkey", False, True), ("price", False, True), ("note", False, False),
]
RUNS = {"baseline": (7, 19), "experiment": (11, 17)}
LEGACY_MISSING = 23
EMPTY_TERMS = ["1-urgent", "5-low"]

CUST, DIMS = "CAST(o_custkey AS STRING)", "o_custkey || ' x ' || o_orderkey"
GOLD = {
    "status": ("str", "o_orderstatus"), "priority": ("str", "o_orderpriority"), "is_open": ("str", "CASE WHEN o_orderstatus = 'O' THEN 'Yes' ELSE 'No' END"),
    "ref_doi": ("str", "'https://doi.org/10.1/' || o_custkey"), "dims": ("str", DIMS), "custkey": ("int", CUST),
    "price": ("float", "CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS STRING)"), "note": ("str", "CASE WHEN o_orderkey % 13 <> 0 THEN 'checked' END"),
}
LEGACY = {
    "status": ("str", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE o_orderpriority END"), "priority": ("str", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE o_orderstatus END"),
    "is_open": GOLD["is_open"], "ref_doi": GOLD["ref_doi"], "dims": ("str", f"CASE WHEN o_orderkey % 5 <> 0 THEN {DIMS} END"), "custkey": ("str", CUST),
    "flag": ("str", "CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE 'Y' END"),
}
PLAIN = GOLD | {
    "status": ("str", "CASE WHEN o_orderkey % 29 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END"),
    "ref_doi": ("str", "'https://dx.doi.org/10.1/' || o_custkey"), "note": ("str", "'checked'"),
}


def spoilt(run: str) -> dict[str, tuple[str, str]]:
    return {
        "status": ("str", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'X' END"), "priority": ("str", "lower(replace(o_orderpriority, '-', ' '))"),
        "is_open": ("str", "CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END"), "ref_doi": ("str", "'10.1/' || o_custkey"), "dims": ("str", "o_custkey || ',' || o_orderkey || 'px'"),
        "custkey": ("int", "CAST(o_custkey + 1 AS STRING)") if run == "baseline" else ("str", CUST), "price": ("str", "CAST(NULL AS STRING)"), "note": ("str", "CAST(NULL AS STRING)"),
    }


def cell(tag: str, text: str) -> tuple[str, str, str]:
    """SQL of a value's tag, text and number."""
    return f"'{tag}'", text, f"CAST({text} AS DOUBLE)" if tag in ("int", "float") else "CAST(NULL AS DOUBLE)"


def predicted(run: str) -> dict[str, tuple[str, str, str]]:
    step, wrong = RUNS[run][0], spoilt(run)
    return {n: tuple(a if a == b else f"CASE WHEN (o_orderkey + {i}) % {step} = 0 THEN {a} ELSE {b} END" for a, b in zip(cell(*wrong[n]), cell(*PLAIN[n]))) for i, (n, _, _) in enumerate(FIELDS)}


def schema(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{a}', '{n}', {o}, {r}, {i})" for a, _ in ASSAYS for i, (n, o, r) in enumerate(FIELDS))
    return spark.sql(f"SELECT * FROM VALUES {rows} t(assay, field, is_ontology, required, ord)")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(assay, role, model, run_type, record, field, value) of all orders."""
    sides = [("gold", None, {n: cell(*v) for n, v in GOLD.items()}, "TRUE"), ("input", None, {n: cell(*v) for n, v in LEGACY.items()}, f"k % {LEGACY_MISSING} <> 0")]
    sides += [("output", run, predicted(run), f"k % {missing} <> 0") for run, (_, missing) in RUNS.items()]
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = ["o_orderpriority AS assay", "CAST(o_orderkey AS STRING) AS record", "o_orderkey AS k"]
    out = None
    for role, run, cells, there in sides:
        rows = ", ".join(f"'{n}', {t}, {x}, {v}" for n, (t, x, v) in cells.items())
        one = orders.selectExpr(*base, f"stack({len(cells)}, {rows}) AS (field, tag, text, num)").where(there)
        value = "CASE WHEN text IS NOT NULL THEN named_struct('tag', tag, 'text', text, 'num', num) END AS value"
        one = one.selectExpr("assay", f"'{role}' AS role", "'orders' AS model", f"CAST({repr(run) if run else 'NULL'} AS STRING) AS run_type", "record", "field", value)
        out = one if out is None else out.unionAll(one)
    return out


def sql_cells() -> str:
    """DuckDB: a CTE list ending in `cells` (assay, record, field, field_type, required, f, k and g_, b_, e_, l_ tag, text, num)."""

    def columns(p: str, tag: str, text: str, num: str) -> str:
        return f"CASE WHEN ({text}) IS NOT NULL THEN {tag} END {p}_tag, ({text}) {p}_text, CASE WHEN ({text}) IS NOT NULL THEN {num} END {p}_num"

    runs = {run: predicted(run) for run in RUNS}
    parts = []
    for name, ontology, required in FIELDS:
        old = columns("l", *cell(*LEGACY.get(name, ("str", "CAST(NULL AS VARCHAR)"))))
        parts.append(
            f"SELECT o_orderpriority assay, CAST(o_orderkey AS VARCHAR) record, o_orderkey k, '{name}' field, '{'ontology' if ontology else 'non_ontology'}' field_type, {str(required).upper()} required, "
            f"{columns('g', *cell(*GOLD[name]))}, {columns('b', *runs['baseline'][name])}, {columns('e', *runs['experiment'][name])}, {old} FROM orders"
        )
    cells = "cells AS (" + " UNION ALL ".join(parts) + ")"
    ok = []
    for p in "bel":
        doi = lambda x: f"CASE WHEN ends_with(field,'_doi') THEN replace({x},'https://doi.org/','https://dx.doi.org/') ELSE {x} END"
        ok.append(
            f"CASE WHEN g_text IS NULL THEN {p}_text IS NULL WHEN {p}_text IS NULL THEN FALSE WHEN g_tag='str' AND {p}_tag='str' THEN {doi('g_text')} = {doi(f'{p}_text')} "
            f"WHEN g_tag='str' OR {p}_tag='str' THEN FALSE ELSE g_num = {p}_num END {p}_ok"
        )
    return (
        f"{cells}, marked AS (SELECT *, {', '.join(ok)}, coalesce(g_tag || ':' || g_text, 'null') value_key FROM cells), "
        f"experiment AS (SELECT * FROM marked WHERE k % {RUNS['experiment'][1]} <> 0), baseline AS (SELECT * FROM marked WHERE k % {RUNS['baseline'][1]} <> 0), "
        f"uncorrected AS (SELECT * FROM marked WHERE k % {LEGACY_MISSING} <> 0), both_runs AS (SELECT * FROM experiment WHERE k % {RUNS['baseline'][1]} <> 0)"
    )
