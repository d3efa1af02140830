"""Field facts: gold, predictions and legacy values of each field side by side, and the accuracies made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.functions.values import is_correct, is_missing, ratio, value_key

KEY = ["assay", "record"]
ONTOLOGY, PLAIN = "ontology", "non_ontology"
ACCURACIES = {"ontology_constrained_field_accuracy": ONTOLOGY, "non_ontology_constrained_field_accuracy": PLAIN, "all_field_accuracy": None}


def aligned(records: DataFrame, sides: dict[str, Column], required: list[str] = (), marked: list[str] = ()) -> DataFrame:
    """One row for each gold field with a column of each side's value; null where the side lacks the field.

    sides: conditions on role, model or run type by name, `gold` among them. Records that a side of `required` lacks are
    left out, as are fields that gold lacks; in_<name> says for names in `marked` whether the record has that side. One
    shuffle and one sort by record serve pairing, presence and alignment; the record leads, since assays are few.
    """
    by = KEY[::-1]
    chosen = records.where(F.lit(False) if not sides else _any(sides.values())).repartition(*by)
    values = [F.first(F.when(when, F.col("value")), ignorenulls=True).alias(name) for name, when in sides.items()]
    there = [F.max(sides[name]).alias(f"in_{name}") for name in dict.fromkeys(["gold", *required, *marked])]
    each = chosen.groupBy(*by, "field").agg(*values, *there)
    record = Window.partitionBy(*by)
    each = each.withColumns({f"in_{name}": F.max(f"in_{name}").over(record) for name in dict.fromkeys([*required, *marked])}) if required or marked else each
    kept = each.where("in_gold")
    for name in required:
        kept = kept.where(F.col(f"in_{name}"))
    return kept.select(*KEY, "field", *sides, *[f"in_{name}" for name in marked])


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def run(name: str) -> Column:
    return F.coalesce((F.col("role") == "output") & (F.col("run_type") == name), F.lit(False))


def gold_side() -> Column:
    return F.coalesce(F.col("role") == "gold", F.lit(False))


def legacy_side() -> Column:
    return F.coalesce(F.col("role") == "input", F.lit(False))


def with_schema(cells: DataFrame, schema: DataFrame) -> DataFrame:
    """Adds field_type and required; fields that the schema lacks are unconstrained and not required."""
    known = schema.select("assay", "field", "is_ontology", "required")
    out = cells.join(known, ["assay", "field"], "left")
    kind = F.when(F.coalesce("is_ontology", F.lit(False)), ONTOLOGY).otherwise(PLAIN)
    return out.withColumns({"field_type": kind, "required": F.coalesce("required", F.lit(False))}).drop("is_ontology")


def field_facts(records: DataFrame, schema: DataFrame, pred: Column, match_case: bool = True, match_whole_word: bool = True) -> DataFrame:
    """(assay, record, field, field_type, required, gold, pred, is_correct, value_key) of records that both sides have."""
    cells = with_schema(aligned(records, {"gold": gold_side(), "pred": pred}, ["pred"]), schema)
    return cells.withColumns({"is_correct": is_correct(F.col("pred"), F.col("gold"), F.col("field"), match_case, match_whole_word), "value_key": value_key(F.col("gold"))})


def run_facts(records: DataFrame, schema: DataFrame, runs: list[str], match_case: bool = True, match_whole_word: bool = True) -> DataFrame:
    """field_facts of several runs with run_type, aligned in one pass."""
    sides = {"gold": gold_side()} | {f"run_{i}": run(name) for i, name in enumerate(runs)}
    cells = with_schema(aligned(records, sides, marked=list(sides)[1:]), schema)
    each = F.array(*[F.struct(F.lit(name).alias("run_type"), F.col(f"run_{i}").alias("pred"), F.col(f"in_run_{i}").alias("there")) for i, name in enumerate(runs)])
    long = cells.withColumn("_r", F.explode(each)).where("_r.there").select(*KEY, "field", "field_type", "required", "gold", "_r.run_type", "_r.pred")
    return long.withColumn("is_correct", is_correct(F.col("pred"), F.col("gold"), F.col("field"), match_case, match_whole_word))


def with_outcomes(cells: DataFrame) -> DataFrame:
    """Adds base_ok and arms_ok to cells with the sides gold, base and arms."""
    ok = lambda side: is_correct(F.col(side), F.col("gold"), F.col("field"))
    return cells.withColumns({"base_ok": ok("base"), "arms_ok": ok("arms")})


def field_results(facts: DataFrame) -> DataFrame:
    return facts.select(*KEY, "field", "field_type", "is_correct")


def _share(kind: str | None) -> Column:
    """Correct among fields of a type, or of all."""
    of = F.lit(True) if kind is None else F.col("field_type") == kind
    return ratio(F.sum((of & F.col("is_correct")).cast("long")), F.sum(of.cast("long")))


def record_accuracy(facts: DataFrame) -> DataFrame:
    """Three accuracies of each record; a record without fields of a type scores 0 there."""
    return facts.groupBy(*KEY).agg(*[_share(kind).alias(name) for name, kind in ACCURACIES.items()])


def field_counts(facts: DataFrame, *by: str) -> DataFrame:
    """Correct and total counts by type, of all facts or by columns."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    ontology, ok = F.col("field_type") == ONTOLOGY, F.col("is_correct")
    return facts.groupBy(*by).agg(
        count(ontology & ok).alias("ontology_correct"), count(ontology).alias("ontology_total"),
        count(~ontology & ok).alias("non_ontology_correct"), count(~ontology).alias("non_ontology_total"),
    )


def shown(accuracy: Column, places: int | None) -> Column:
    """Rounded to places, halves to even after scaling; as it is for None."""
    return accuracy if places is None else F.rint(accuracy * 10.0**places) / 10.0**places


def assay_summary(facts: DataFrame, assays: DataFrame, places: int | None = 2) -> DataFrame:
    """(label, ord and) means of the records' accuracies, in the order of the dimension; assays without records are absent."""
    means = record_accuracy(facts).groupBy("assay").agg(*[shown(F.avg(n), places).alias(n) for n in ACCURACIES])
    return means.join(assays, "assay").orderBy("ord").select(F.col("label").alias("assay"), *ACCURACIES)


def overall_summary(facts: DataFrame, places: int | None = 2) -> DataFrame:
    """One row of pooled accuracies: all correct fields over all fields."""
    return facts.agg(
        shown(_share(ONTOLOGY), places).alias("ontology_constrained_accuracy"),
        shown(_share(PLAIN), places).alias("non_ontology_constrained_accuracy"),
        shown(_share(None), places).alias("all_field_accuracy"),
    )


def populated(facts: DataFrame) -> DataFrame:
    return facts.where(~is_missing(F.col("gold")))


def dedup_summary(facts: DataFrame) -> DataFrame:
    """Each distinct (assay, field, gold value) counts once, by the mean over its occurrences; then the mean of those."""
    pairs = facts.groupBy("assay", "field", "value_key", "field_type").agg(F.avg(F.col("is_correct").cast("double")).alias("share"))
    of = lambda kind: F.when(F.col("field_type") == kind, F.col("share"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return pairs.agg(
        mean(of(ONTOLOGY)).alias("ontology_constrained_accuracy"), mean(of(PLAIN)).alias("non_ontology_constrained_accuracy"), mean(F.col("share")).alias("all_field_accuracy"),
        F.count(of(ONTOLOGY)).alias("n_ontology_pairs"), F.count(of(PLAIN)).alias("n_non_ontology_pairs"), F.count("*").alias("n_unique_pairs"),
    )


def frequency_split(facts: DataFrame, gold: DataFrame, field_type: str | None = None) -> DataFrame:
    """(bucket, accuracy, n_instances): values that gold has once, and more often.

    gold: (assay, field, gold) of all gold records, those without predictions too; both buckets are always there.
    """
    chosen = facts if field_type is None else facts.where(F.col("field_type") == field_type)
    often = gold.groupBy("assay", "field", value_key(F.col("gold")).alias("value_key")).agg(F.count("*").alias("n"))
    each = chosen.join(often, ["assay", "field", "value_key"]).withColumn("bucket", F.when(F.col("n") == 1, "singleton").otherwise("recurring"))
    sums = each.groupBy("bucket").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.count("*").alias("n_instances"))
    both = facts.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(F.lit("singleton"), F.lit("recurring"))).alias("bucket"))
    return both.join(sums, "bucket", "left").select("bucket", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("n_instances", F.lit(0)).cast("long").alias("n_instances"))


def run_scores(facts_by_run: DataFrame, metric: str = "all_field_accuracy") -> DataFrame:
    """(assay, run_type, score, n): the distinct record accuracies of each assay and run, and how many records have each."""
    each = facts_by_run.groupBy(*KEY, "run_type").agg(_share(ACCURACIES[metric]).alias("score"))
    return each.groupBy("assay", "run_type", "score").agg(F.count("*").alias("n"))


def score_ranges(scores: DataFrame) -> DataFrame:
    """(assay, run_type, mean, low, high, n_records): means with the least and the greatest score, as a chart shows them."""
    mean = F.sum(F.col("score") * F.col("n")) / F.sum("n")
    return scores.groupBy("assay", "run_type").agg(mean.alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.sum("n").alias("n_records"))


def chart_rows(stats: DataFrame, assays: DataFrame, runs: list[str]) -> DataFrame:
    """(assay label, run_type, mean, low, high) in the dimension's order, for assays that have some run; 0.0 for a run they lack."""
    every = stats.select("assay").distinct().join(assays, "assay").withColumn("run_type", F.explode(F.array(*map(F.lit, runs))))
    zero = {x: F.coalesce(x, F.lit(0.0)) for x in ("mean", "low", "high")}
    return every.join(stats, ["assay", "run_type"], "left").withColumns(zero).orderBy("ord", "run_type").select(F.col("label").alias("assay"), "run_type", "mean", "low", "high")
