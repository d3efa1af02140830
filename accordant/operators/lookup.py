"""Ranking of vocabulary terms, last answers of conversations, token costs, caches with a lifetime, exact samples."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.functions.values import cache_key, strip
from accordant.sources.records import exists

LEAST_SCORE, OBSOLETE = 0.3, 0.2
DAY = 86_400
#: US dollars for a million tokens in and out, in the order in which prefixes are tried.
PRICES = (("gpt-4o", 2.50, 10.00), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4.1", 2.00, 8.00), ("gpt-4.1-mini", 0.40, 1.60), ("gpt-4.1-nano", 0.10, 0.40), ("gpt-5-mini", 1.00, 4.00))


def term_score(query: Column, label: Column, synonyms: Column, obsolete: Column) -> Column:
    """How well a term answers a query; strings are compared stripped and lower-cased, and empty ones lie inside any."""
    fold = lambda c: F.lower(strip(c))
    q, name = fold(query), fold(F.coalesce(label, F.lit("")))
    inside = lambda a, b: F.contains(a, b) | F.contains(b, a)
    each = F.transform(F.coalesce(synonyms, F.array().cast("array<string>")), lambda s: F.when(fold(s) == q, 0.6).when(inside(fold(s), q), 0.4))
    score = F.when(name == q, 1.0).when(inside(name, q), 0.7).otherwise(F.coalesce(F.array_max(each), F.lit(0.1)))
    return score - F.when(F.coalesce(obsolete, F.lit(False)), OBSOLETE).otherwise(0.0)


def best_terms(candidates: DataFrame, *by: str) -> DataFrame:
    """(by, label, iri, score) of the best candidate (query, pos, label, synonyms, obsolete, iri) of each group.

    The first of the greatest score wins; groups whose best is under LEAST_SCORE have no row. Partial aggregation finds
    the winner, so a group with many candidates is not sorted.
    """
    scored = candidates.withColumn("score", term_score(F.col("query"), F.col("label"), F.col("synonyms"), F.col("obsolete")))
    best = scored.groupBy(*by).agg(F.min_by(F.struct("label", "iri", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("best"))
    return best.select(*by, "best.*").where(F.col("score") >= LEAST_SCORE)


def search_terms(queries: DataFrame, terms: DataFrame, within_branch: bool) -> DataFrame:
    """Candidates of queries (query, acronym[, branch]) among terms (acronym, branch, pos, label, synonyms, obsolete, iri)."""
    by = ["acronym", "branch"] if within_branch else ["acronym"]
    return queries.join(terms.select(*by, "pos", "label", "synonyms", "obsolete", "iri"), by)


def picked_terms(queries: DataFrame, terms: DataFrame, entries: DataFrame, now: Column, within_branch: bool) -> DataFrame:
    """(query, acronym[, branch], label, iri, from_cache) for each distinct query: fresh cached picks first, else the best term found.

    entries: cache entries (key, created_at, ttl, label, iri), whose key is pick_key of the query; a null label is a
    cached "nothing". Queries that neither the cache nor the terms answer have null label and iri.
    """
    by = ["acronym", "branch"] if within_branch else ["acronym"]
    asked = queries.select("query", *by).distinct().withColumn("key", pick_key("query", *by))
    known = cache_get(cache_latest(entries, "label", "iri"), now).select("key", "label", "iri", F.lit(True).alias("from_cache"))
    hits = asked.join(known, "key", "left")
    missed = hits.where("from_cache is null").select("query", *by)
    best = best_terms(search_terms(missed, terms, within_branch), "query", *by).select("query", *by, F.col("label").alias("found"), F.col("iri").alias("found_iri"))
    out = hits.join(best, ["query", *by], "left")
    fresh = F.coalesce("from_cache", F.lit(False))
    return out.select("query", *by, F.when(fresh, F.col("label")).otherwise(F.col("found")).alias("label"), F.when(fresh, F.col("iri")).otherwise(F.col("found_iri")).alias("iri"), fresh.alias("from_cache"))


def pick_key(*columns: str) -> Column:
    return cache_key(F.lit("pick_term"), F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))]))


def new_entries(picked: DataFrame, now: Column, ttl: int | None = None) -> DataFrame:
    """What a pick adds to the cache: entries (key, created_at, ttl, label, iri) of queries that it didn't answer."""
    by = [c for c in picked.columns if c in ("query", "acronym", "branch")]
    return picked.where("not from_cache").select(pick_key(*by).alias("key"), now.alias("created_at"), F.lit(lifetime() if ttl is None else ttl).alias("ttl"), "label", "iri")


def lifetime(name: str = "ACCORDANT_CACHE_TTL_SECONDS") -> int:
    """Seconds that cache entries live: of the environment, a day where it is unset or no number."""
    try:
        return int(os.environ.get(name, DAY))
    except ValueError:
        return DAY


def cache_folder(name: str = "ACCORDANT_CACHE_DIR") -> str:
    """Where the cache table lies: of the environment, else the user's cache folder."""
    base = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.environ.get(name) or os.path.join(base, "accordant")


ENTRIES = "key string, value string, func_name string, params_summary string, created_at double, ttl int"


def cache_table(spark: SparkSession, folder: str) -> DataFrame:
    """Entries stored in a folder; the folder is made, empty, where it isn't there."""
    if not exists(spark, folder):
        spark.createDataFrame([], ENTRIES).write.mode("append").parquet(folder)
    return spark.read.schema(ENTRIES).parquet(folder)


def cache_set(entries: DataFrame, folder: str) -> None:
    """Adds entries (ENTRIES, is_error); error results are left out, and of one key the newest holds."""
    kept = entries.where(~F.coalesce("is_error", F.lit(False))) if "is_error" in entries.columns else entries
    kept.select(*[c.split()[0] for c in ENTRIES.split(", ")]).write.mode("append").parquet(folder)


def cache_compact(spark: SparkSession, folder: str, to: str, now: Column) -> DataFrame:
    """Writes the newest fresh entries of `folder` to the new folder `to`, expired and replaced ones left out."""
    values = [c.split()[0] for c in ENTRIES.split(", ") if not c.startswith(("key", "created_at", "ttl"))]
    latest = cache_latest(cache_table(spark, folder), *values)
    latest.where(now - F.col("created_at") <= F.col("ttl")).select(*[c.split()[0] for c in ENTRIES.split(", ")]).write.parquet(to)
    return spark.read.schema(ENTRIES).parquet(to)


def final_responses(messages: DataFrame, required: bool = False) -> DataFrame:
    """(conv_id, text) of the last message of the assistant with text; messages have `text`, `blocks` (an array of structs with a text) or both.

    Conversations without such a message have no row; with `required` they raise an error when the row is made.
    """
    body = F.when(strip(F.col("text")) != "", F.col("text")) if "text" in messages.columns else F.lit(None).cast("string")
    if "blocks" in messages.columns:
        joined = joined_blocks(F.col("blocks"))
        body = F.coalesce(body, F.when(joined != "", joined))
    said = F.when(F.col("role") == "assistant", body)
    if not required:
        return messages.withColumn("_said", said).where("_said is not null").groupBy("conv_id").agg(F.max_by("_said", "turn").alias("text"))
    last = F.max_by(said, F.when(said.isNotNull(), F.col("turn")))
    return messages.groupBy("conv_id").agg(last.alias("text")).withColumn("text", F.coalesce("text", F.raise_error("a conversation has no text response")))


def joined_blocks(blocks: Column) -> Column:
    """Text of a message made of blocks with a text: those that have any, a line each."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != ""), lambda b: b["text"]), "\n")


def price_table(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(m).alias("known"), F.lit(i).alias("price_in"), F.lit(o).alias("price_out"), F.lit(k).alias("ord")) for k, (m, i, o) in enumerate(PRICES)])
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def price_of(model: Column, part: int) -> Column:
    """Price in (1) or out (2): of the model by name, else of the first known name that it starts with, else null."""
    out = F.when(F.lit(False), F.lit(0.0))
    for row in PRICES:
        out = out.when(model == row[0], F.lit(row[part]))
    for row in PRICES:
        out = out.when(F.startswith(model, F.lit(row[0])), F.lit(row[part]))
    return out


def token_costs(usage: DataFrame, *by: str) -> DataFrame:
    """Sums of usage (model, prompt, completion) and the cost in dollars; unknown models cost nothing."""
    cost = lambda tokens, part: F.col(tokens) / 1e6 * F.coalesce(price_of(F.col("model"), part), F.lit(0.0))
    return usage.groupBy(*by).agg(
        F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"),
        F.sum(F.col("prompt") + F.col("completion")).alias("total_tokens"), F.sum(cost("prompt", 1) + cost("completion", 2)).alias("cost"),
    )


def usage_summary(costs: DataFrame) -> DataFrame:
    shown = F.format_string("User prompt tokens: %,d | Completion tokens: %,d | Total tokens: %,d | Estimated cost: $%.4f", "prompt_tokens", "completion_tokens", "total_tokens", "cost")
    return costs.withColumn("summary", shown)


def cache_latest(entries: DataFrame, *value: str) -> DataFrame:
    """The newest entry (key, created_at, ttl, value...) of each key; error results aren't entries."""
    kept = entries.where(~F.coalesce("is_error", F.lit(False))) if "is_error" in entries.columns else entries
    newest = kept.groupBy("key").agg(F.max_by(F.struct("created_at", "ttl", *value), F.struct("created_at", *value)).alias("e"))
    return newest.select("key", "e.*")


def cache_get(latest: DataFrame, now: Column) -> DataFrame:
    """Entries that are fresh at `now` (seconds), with their age to a tenth of a second."""
    age = now - F.col("created_at")
    return latest.where(age <= F.col("ttl")).withColumns({"cached": F.lit(True), "cache_age_seconds": F.round(age, 1)})


def cache_remove_stale(latest: DataFrame, now: Column) -> DataFrame:
    """removed_count and remaining_count."""
    stale = (now - F.col("created_at")) > F.col("ttl")
    return latest.agg(F.count(F.when(stale, 1)).alias("removed_count"), F.count(F.when(~stale, 1)).alias("remaining_count"))


def cache_clear(latest: DataFrame) -> DataFrame:
    return latest.agg(F.count("*").alias("cleared_count"))


def exact_sample(names: DataFrame, counts: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (source, name) drawn without replacement: of each source as many as counts (source, n) says, all if fewer.

    Order by MD5 of seed and name decides. Each source is first cut in SHARES shares, of which each keeps its own n, so
    no task sorts a whole source.
    """
    ranked = names.join(counts, "source").withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), "name")))
    share = F.pmod(F.xxhash64("name"), F.lit(64))
    first = Window.partitionBy("source", share).orderBy("draw", "name")
    last = Window.partitionBy("source").orderBy("draw", "name")
    few = ranked.withColumn("r", F.row_number().over(first)).where("r <= n")
    return few.withColumn("r", F.row_number().over(last)).where("r <= n").drop("r", "draw", "n")


def paired_names(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names (source, name) that both sides have, and those of the left alone."""
    return left.join(right, ["source", "name"], "left_semi"), left.join(right, ["source", "name"], "left_anti")


def checked_counts(available: DataFrame, counts: DataFrame) -> DataFrame:
    """counts (source, n), after a check on the driver: an error names sources with fewer paired names than asked for, or none."""
    there = available.groupBy("source").agg(F.count("*").alias("_there"))
    short = counts.join(there, "source", "left").withColumn("_there", F.coalesce("_there", F.lit(0))).where("_there = 0 or n > _there")
    if found := short.select("source", "n", "_there").orderBy("source").head(20):
        raise ValueError("not enough paired names: " + ", ".join(f"{r['source']}: {r['n']} of {r['_there']}" for r in found))
    return counts


def unmatched_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source, n_unmatched): names of the left that the right lacks, for a warning."""
    return paired_names(left, right)[1].groupBy("source").agg(F.count("*").alias("n_unmatched"))
