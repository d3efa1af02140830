"""python -m accordant report|summary|causes|significance|plot|sample ROOT ... | query NAME SF_DIR"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.operators import errors, facts, lookup, statistics
from accordant.plans.queries import QUERIES
from accordant.sources import records as sources


def assays_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The assays that have records, each its own label, in order of name."""
    names = [r["assay"] for r in rows.select("assay").distinct().orderBy("assay").collect()]  # one row an assay
    return sources.assay_table(spark, [(n, n) for n in names])


def paired(rows: DataFrame, schema: DataFrame) -> DataFrame:
    sides = {"gold": facts.gold_side(), "base": facts.run("baseline"), "arms": facts.run("experiment")}
    return statistics.paired_counts(facts.with_outcomes(facts.with_schema(facts.aligned(rows, sides, ["base", "arms"]), schema)))


def sampled(rows: DataFrame, sources_: list[str], counts: list[int], seed: int) -> DataFrame:
    """(source, role, name, field, value) of as many paired input and gold records of each source as asked for."""
    spark = rows.sparkSession
    names = lambda role: rows.where(F.col("role") == role).select(F.col("assay").alias("source"), F.col("record").alias("name")).distinct()
    both, alone = lookup.paired_names(names("input"), names("gold"))
    asked = spark.createDataFrame(list(zip(sources_, counts, strict=True)), "source string, n int")
    for r in lookup.unmatched_counts(names("input"), names("gold")).join(asked, "source", "left_semi").collect():
        print(f"{r['source']}: {r['n_unmatched']} input records have no gold one and are left out")
    chosen = lookup.exact_sample(both, lookup.checked_counts(both, asked), seed)
    pairs = rows.where("role in ('input', 'gold')").withColumnsRenamed({"assay": "source", "record": "name"}).join(chosen, ["source", "name"])
    entry = F.struct("field", "value")
    return pairs.groupBy("source", "role", "name").agg(F.sort_array(F.collect_list(entry)).alias("fields"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="accordant", description=__doc__)
    parser.add_argument("what", choices=["report", "summary", "causes", "significance", "plot", "sample", "query"])
    parser.add_argument("place")
    parser.add_argument("sf_dir", nargs="?")
    parser.add_argument("--model", default="*")
    parser.add_argument("--csv")
    parser.add_argument("--metric", default="all_field_accuracy", choices=list(facts.ACCURACIES))
    parser.add_argument("--errors", default="ci", choices=["ci", "minmax"])
    parser.add_argument("--sources", nargs="+", default=[])
    parser.add_argument("--counts", nargs="+", type=int, default=[])
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("--output")
    parser.add_argument("--overwrite", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("accordant").getOrCreate()
    if args.what == "query":
        result = QUERIES[args.place](spark, args.sf_dir)
    else:
        rows = sources.read_json_records(spark, args.place, model=args.model)
        if args.what == "sample":
            sources.write_pairs(sampled(rows, args.sources, args.counts, args.seed), args.output, args.overwrite)
            return
        schema, runs = sources.read_templates(spark, args.place), ["baseline", "experiment"]
        if args.what == "summary":
            result = facts.overall_summary(facts.field_facts(rows, schema, facts.run("experiment")))
        elif args.what == "causes":
            detail = errors.error_detail(errors.error_rows(facts.field_facts(rows, schema, facts.run("experiment"))), errors.legacy_maps(rows))
            result = errors.summarise(detail, "cause")
        elif args.what == "plot":
            scores = facts.run_scores(facts.run_facts(rows, schema, runs), args.metric)
            result = facts.chart_rows(statistics.score_intervals(scores) if args.errors == "ci" else facts.score_ranges(scores), assays_of(spark, rows), runs)
        elif args.what == "significance":
            result = statistics.per_assay_table(paired(rows, schema), assays_of(spark, rows))
        else:
            result = statistics.overall_table(paired(rows, schema))
    if args.csv:
        sources.write_csv(result, args.csv)
    else:
        result.show(100, truncate=False)


if __name__ == "__main__":
    main()
