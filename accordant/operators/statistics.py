"""Paired comparison of two runs: intervals by resampling, rank, sign and contingency tests, effective sample size.

Resampling works on histograms, not on rows: records with the same counts are alike, and a resample of n rows with
replacement is one multinomial draw over the distinct rows. So drivers and tasks hold as many numbers as there are
distinct record outcomes, which the number of fields bounds, whatever the number of records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.functions.values import ratio
from accordant.operators.facts import KEY

CATEGORIES = ("ontology", "non_ontology", "all")
RESAMPLES, ALPHA, SEED = 10_000, 0.05, 0
#: McNemar is exact below so many discordant pairs, Wilcoxon up to so many differences without ties.
EXACT_PAIRS, EXACT_RANKS = 25, 50


def paired_counts(cells: DataFrame) -> DataFrame:
    """Counts of each record and category of rows (assay, record, field_type, base_ok, arms_ok); a category without fields has no row."""
    each = cells.select(*KEY, "base_ok", "arms_ok", F.explode(F.array("field_type", F.lit("all"))).alias("category"))
    count = lambda c: F.sum(c.cast("long"))
    base, arms = F.col("base_ok"), F.col("arms_ok")
    return each.groupBy(*KEY, "category").agg(
        count(base).alias("base_correct"), count(arms).alias("arms_correct"), F.count("*").alias("total"),
        count(base & ~arms).alias("base_only"), count(arms & ~base).alias("arms_only"),
    )


def mcnemar_counts(paired: DataFrame, *by: str) -> DataFrame:
    """b (base only), c (arms only), their sum and the statistic; null without discordant pairs."""
    sums = paired.groupBy(*by).agg(F.sum("base_only").alias("b"), F.sum("arms_only").alias("c")).withColumn("n_discordant", F.col("b") + F.col("c"))
    exact = F.least("b", "c").cast("double")
    corrected = F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / F.col("n_discordant")
    return sums.withColumn("statistic", F.when(F.col("n_discordant") == 0, None).when(F.col("n_discordant") < EXACT_PAIRS, exact).otherwise(corrected))


def tail_column(z: Column, nodes: int = 400) -> Column:
    """Two-sided normal tail of z >= 0 as a column, by Simpson's rule; 0 beyond 12. For a few rows: each takes `nodes` steps."""
    x = F.least(z, F.lit(12.0)) / math.sqrt(2)
    step = x / (2 * nodes)
    weight = lambda i: F.when((i == 0) | (i == 2 * nodes), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(2 * nodes)), F.lit(0.0), lambda s, i: s + weight(i) * F.exp(-(step * i) * (step * i)))
    return F.greatest(F.lit(0.0), 1 - area * step / 3 * 2 / math.sqrt(math.pi))


def with_mcnemar_p(counts: DataFrame) -> DataFrame:
    """Adds p to mcnemar_counts: exact below EXACT_PAIRS discordant pairs, else of the corrected statistic; 1 without any."""
    n, least = F.col("n_discordant"), F.least("b", "c")
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    below = F.aggregate(F.slice(F.sequence(F.lit(0).cast("long"), least), F.lit(2), least.cast("int")), first, add, lambda s: s["sum"])
    exact = F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))
    return counts.withColumn("p", F.when(n == 0, 1.0).when(n < EXACT_PAIRS, exact).otherwise(tail_column(F.sqrt("statistic"))))


def with_wilcoxon_p(ranks: DataFrame) -> DataFrame:
    """Adds the tie-corrected normal p to wilcoxon_ranks."""
    n = F.col("n_nonzero").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_sum") / 2) / 24)
    return ranks.withColumn("p", F.when(spread == 0, 1.0).otherwise(tail_column(F.abs(F.col("statistic") - n * (n + 1) / 4) / spread)))


def mcnemar_p(b: int, c: int) -> float:
    n = b + c
    if n == 0:
        return 1.0
    if n < EXACT_PAIRS:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))


def wilcoxon_ranks(paired: DataFrame, *by: str) -> DataFrame:
    """w_plus, w_minus, statistic, n_nonzero and tie_sum (of t^3 - t) of the differences of the records' accuracies.

    Ranks come from the sizes of groups of equal differences, so the window runs over distinct values alone.
    """
    d = F.col("arms_correct") / F.col("total") - F.col("base_correct") / F.col("total")
    sizes = paired.withColumn("d", d).where("d <> 0").withColumn("size", F.abs("d")).groupBy(*by, "size").agg(
        F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("up")
    )
    before = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    up, down = F.sum(F.col("rank") * F.col("up")), F.sum(F.col("rank") * (F.col("t") - F.col("up")))
    t = F.col("t").cast("double")
    out = ranked.groupBy(*by).agg(up.alias("w_plus"), down.alias("w_minus"), F.sum("t").alias("n_nonzero"), F.sum(t * t * t - t).alias("tie_sum"))
    return out.withColumn("statistic", F.least("w_plus", "w_minus"))


def wilcoxon_p(n: int, w: float, tie_sum: float) -> float:
    """Two-sided: by counting subsets of ranks without ties up to EXACT_RANKS, else the tie-corrected normal one."""
    if n == 0:
        return 1.0
    if n <= EXACT_RANKS and tie_sum == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_sum / 2) / 24)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


def effective_sample_size(facts: DataFrame) -> DataFrame:
    """n, n_clusters, icc, design_effect and n_effective; clusters are equal (assay, field, gold value).

    One-way analysis of variance with clusters of unequal size; without two clusters, or with no more rows than
    clusters, icc and design_effect are null and n_effective is n.
    """
    clusters = facts.groupBy("assay", "field", "value_key").agg(F.count("*").cast("double").alias("m"), F.sum(F.col("is_correct").cast("double")).alias("c"))
    m, c = F.col("m"), F.col("c")
    sums = clusters.agg(F.sum(m).alias("n"), F.count("*").cast("double").alias("k"), F.sum(m * m).alias("mm"), F.sum(c).alias("c"), F.sum(c * c / m).alias("ccm"))
    n, k, p = F.col("n"), F.col("k"), F.col("c") / F.col("n")
    between = (F.col("ccm") - F.col("n") * p * p) / (k - 1)  # sum of m (c/m - p)^2
    within = (F.col("c") - F.col("ccm")) / (n - k)  # sum of c (m - c) / m
    size = (n - F.col("mm") / n) / (k - 1)
    enough = (k >= 2) & (n > k)
    parts = sums.select("n", "k", *[F.when(enough, x).alias(name) for name, x in (("msb", between), ("msw", within), ("m0", size))])
    down = F.col("msb") + (F.col("m0") - 1) * F.col("msw")
    icc = F.when(F.col("msb").isNull(), None).when(down > 0, F.greatest(F.lit(0.0), (F.col("msb") - F.col("msw")) / down)).otherwise(0.0)
    out = parts.withColumn("icc", icc).withColumn("design_effect", 1 + (n / k - 1) * F.col("icc"))
    return out.select(n.cast("long").alias("n"), k.cast("long").alias("n_clusters"), "icc", "design_effect", F.coalesce(n / F.col("design_effect"), n).alias("n_effective"))


def histogram(paired: DataFrame, *by: str) -> list:
    """Distinct record outcomes and how many records have each; of bounded size, see above."""
    return paired.groupBy(*by, "base_correct", "arms_correct", "total", "base_only", "arms_only").agg(F.count("*").alias("n")).orderBy(*by, "base_correct", "arms_correct", "total", "base_only", "arms_only").collect()


#: Numbers that one chunk of resamples holds.
HELD = 4_000_000


def _draws(n: np.ndarray, resamples: int, seed: int) -> Iterator[np.ndarray]:
    """Multinomial draws over the distinct rows, in chunks of at most HELD numbers."""
    rng = np.random.default_rng(seed)
    step = max(1, HELD // len(n))
    for at in range(0, resamples, step):
        yield rng.multinomial(int(n.sum()), n / n.sum(), size=min(step, resamples - at))


def bootstrap_mean(values: np.ndarray, n: np.ndarray, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> tuple[float, float, float]:
    """Mean of values, each n times, with a percentile interval; NaN for none."""
    values, n = np.asarray(values, float), np.asarray(n, np.int64)
    if not n.sum():
        return (math.nan,) * 3
    means = np.concatenate([d @ values for d in _draws(n, resamples, seed)]) / n.sum()
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(values @ n / n.sum()), float(low), float(high)


def bootstrap_ratio(part: np.ndarray, whole: np.ndarray, n: np.ndarray, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> tuple[float, float, float]:
    """Sum of parts over sum of wholes, records drawn whole; NaN for none."""
    part, whole, n = np.asarray(part, float), np.asarray(whole, float), np.asarray(n, np.int64)
    if not n.sum() or not whole @ n:
        return (math.nan,) * 3
    ratios = np.concatenate([(d @ part) / (d @ whole) for d in _draws(n, resamples, seed)])
    low, high = np.percentile(ratios, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(part @ n / (whole @ n)), float(low), float(high)


def score_intervals(scores: DataFrame) -> DataFrame:
    """(assay, run_type, mean, low, high, n_records) of run_scores: means with bootstrap intervals.

    What is collected are distinct accuracies by assay and run, which the number of fields bounds.
    """
    by: dict[tuple, list] = {}
    for r in scores.orderBy("assay", "run_type", "score").collect():
        by.setdefault((r["assay"], r["run_type"]), []).append((r["score"], r["n"]))
    rows = [(*key, *bootstrap_mean(np.array([x for x, _ in own]), np.array([n for _, n in own])), sum(n for _, n in own)) for key, own in by.items()]
    return scores.sparkSession.createDataFrame(rows, "assay string, run_type string, mean double, low double, high double, n_records long")


def permutation(d: np.ndarray, n: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, int, float]:
    """Observed sum, records with a difference and p of flipping each record's sign; equal differences flip binomially."""
    d, n = np.asarray(d, float), np.asarray(n, np.int64)
    observed, some = float(d @ n), d != 0
    if not some.any():
        return observed, 0, 1.0
    sizes, at = np.unique(np.abs(d[some]), return_inverse=True)
    counts = np.bincount(at, n[some]).astype(np.int64)
    rng, step = np.random.default_rng(seed), max(1, HELD // len(counts))
    flips = (rng.binomial(counts, 0.5, size=(min(step, resamples - at), len(counts))) for at in range(0, resamples, step))
    sums = np.concatenate([(2 * x - counts) @ sizes for x in flips])
    return observed, int(counts.sum()), float((np.sum(np.abs(sums) >= abs(observed) - 1e-9) + 1) / (resamples + 1))


def _interval(x: tuple[float, float, float]) -> str:
    return "-" if math.isnan(x[0]) else f"{x[0]:.2f} [{x[1]:.2f}, {x[2]:.2f}]"


def _p(x: float) -> str:
    return "-" if math.isnan(x) else "<0.001" if x < 0.001 else f"{x:.3f}"


def _tests(rows: list) -> dict:
    base, arms, total, n = (np.array([r[c] for r in rows], np.int64) for c in ("base_correct", "arms_correct", "total", "n"))
    only = np.array([[r["base_only"], r["arms_only"]] for r in rows], np.int64).reshape(-1, 2)
    b, c = (int(x) for x in n @ only)
    d = arms / total - base / total
    some = d != 0
    sizes, at = np.unique(np.abs(d[some]), return_inverse=True)
    t = np.bincount(at, n[some], len(sizes))
    ranks = (np.cumsum(t) - t + (t + 1) / 2)[at]
    up = float((ranks * n[some])[d[some] > 0].sum())
    down = float((ranks * n[some])[d[some] < 0].sum())
    n_some = int(n[some].sum())
    return {
        "n_records": int(n.sum()), "n_fields": int(total @ n), "base": base, "arms": arms, "total": total, "n": n,
        "wilcoxon_p": wilcoxon_p(n_some, min(up, down), float((t**3 - t).sum())), "wilcoxon_n": n_some,
        "b": b, "c": c, "mcnemar_p": mcnemar_p(b, c), "perm_p": permutation(only[:, 1] - only[:, 0], n)[2],
    }


def per_assay_table(paired: DataFrame, assays: DataFrame, category: str = "all") -> DataFrame:
    """Of each assay with records, in the dimension's order: means with intervals, and p of the three tests."""
    rows = histogram(paired.where(F.col("category") == category), "assay")
    out = []
    for a in assays.orderBy("ord").collect():
        if own := [r for r in rows if r["assay"] == a["assay"]]:
            t = _tests(own)
            means = [_interval(bootstrap_mean(t[x] / t["total"], t["n"])) for x in ("base", "arms")]
            out.append((a["label"], t["n_records"], *means, _p(t["wilcoxon_p"]), t["b"], t["c"], _p(t["mcnemar_p"]), _p(t["perm_p"])))
    schema = "assay string, n_records long, baseline string, arms string, wilcoxon_p string, mcnemar_b long, mcnemar_c long, mcnemar_p string, perm_p string"
    return paired.sparkSession.createDataFrame(out, schema)


def overall_table(paired: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Of each category: pooled accuracies with intervals by records, and p of the three tests."""
    rows, out = histogram(paired, "category"), []
    for category in CATEGORIES:
        own = [r for r in rows if r["category"] == category]
        t = _tests(own)
        pooled = [_interval(bootstrap_ratio(t[x], t["total"], t["n"])) for x in ("base", "arms")]
        out.append(((labels or {}).get(category, category), t["n_records"], t["n_fields"], *pooled, _p(t["wilcoxon_p"]), t["wilcoxon_n"], t["b"], t["c"], _p(t["mcnemar_p"]), _p(t["perm_p"])))
    schema = "category string, n_records long, n_fields long, baseline string, arms string, wilcoxon_p string, wilcoxon_n long, mcnemar_b long, mcnemar_c long, mcnemar_p string, perm_p string"
    return paired.sparkSession.createDataFrame(out, schema)


def record_means(paired: DataFrame) -> DataFrame:
    """(category, n_records, base_mean, arms_mean): means of the records' accuracies, records without the category left out."""
    return paired.groupBy("category").agg(F.count("*").alias("n_records"), F.avg(ratio(F.col("base_correct"), F.col("total"))).alias("base_mean"), F.avg(ratio(F.col("arms_correct"), F.col("total"))).alias("arms_mean"))
