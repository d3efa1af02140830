"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import BLANK, BLANK_CHARS, Scratch

WINDOW = 5
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def covered_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows whose hash occurs twice or more; hashes: one for each window, in order."""

    def of(ordered: Column) -> Column:
        same = lambda x, k: F.get(ordered, k)["h"] == x["h"]
        twice = F.filter(ordered, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(starts, none, lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.transform(F.array(ordered), of)[0]  # bound as a variable, so it is sorted once


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """Adds the counts that the rules use, named with `prefix`; null text counts as empty."""
    p = prefix
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(f"{p}words", F.array_remove(F.split(body, f"[{BLANK}]+"), ""))
    n = F.size(f"{p}words")
    word = lambda i: F.get(f"{p}words", i)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)]))
    out = out.withColumns({
        f"{p}hashes": F.when(n > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")),
        f"{p}lines": F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(BLANK_CHARS)) != ""),
        f"{p}joined": F.array_join(f"{p}words", ""),
    })
    long = lambda c: c.cast("long")
    return out.withColumns({
        f"{p}row": F.monotonically_increasing_id(),
        f"{p}n_words": long(n),
        f"{p}word_chars": long(F.length(f"{p}joined")),
        f"{p}n_symbols": long(F.regexp_count(f"{p}joined", F.lit(SYMBOLS))),
        f"{p}n_upper": long(F.regexp_count(f"{p}joined", F.lit(r"\p{Lu}"))),
        f"{p}n_ends": long(F.regexp_count(body, F.lit(rf"[.!?](?=[{BLANK}]|$)"))),
        f"{p}n_plain": long(F.regexp_count(body, F.lit(rf"(?<![^{BLANK}])[\p{{L}}\p{{M}}'’-]++[,.;:!?]?(?=[{BLANK}]|$)"))),
        f"{p}n_lines": long(F.size(f"{p}lines")),
        f"{p}n_dup_lines": long(F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))),
        f"{p}n_repeat_words": F.when(F.size(F.array_distinct(f"{p}hashes")) < F.size(f"{p}hashes"), covered_words(F.col(f"{p}hashes"))).otherwise(F.lit(0).cast("long")),
    }).drop(f"{p}words", f"{p}hashes", f"{p}lines", f"{p}joined")


def base_failed(p: str = "_q_") -> Column:
    n, repeated = F.col(f"{p}n_words"), F.col(f"{p}n_repeat_words")
    return (n < 10) | (100 * repeated > 20 * n)


def votes(p: str = "_q_") -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    c = lambda name: F.col(f"{p}{name}").cast("double")
    n = F.greatest(c("n_words"), F.lit(1.0))
    chars = F.greatest(c("word_chars"), F.lit(1.0))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    length, symbols, upper = c("word_chars") / n, c("n_symbols") / n, c("n_upper") / chars
    copied, lines = c("n_repeat_words") / n, c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0))
    ends, plain = c("n_ends") / n, c("n_plain") / n
    return {
        "length": rule(n < 10, n >= 25),
        "word_length": rule((length < 2.5) | (length > 14), (length >= 3) & (length <= 10)),
        "symbols": rule(symbols > 0.1, symbols < 0.02),
        "capitals": rule(upper > 0.3, upper < 0.15),
        "sentences": rule((ends > 0.6) | (ends < 0.008) & (n >= 40), (ends >= 0.02) & (ends <= 0.4)),
        "plain_words": rule(plain < 0.7, plain >= 0.9),
        "repeats": rule((copied > 0.2) | (lines > 0.5), (copied < 0.05) & (lines < 0.1)),
    }


@dataclass(frozen=True)
class VoteModel:
    """prior: of good documents; table: for each rule, P(vote | bad), P(vote | good) by vote."""

    prior: float
    table: dict[str, dict[int, tuple[float, float]]]

    def log_odds(self, named: dict[str, Column]) -> Column:
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, vote in named.items():
            weight = {v: math.log(good / bad) for v, (bad, good) in self.table[rule].items()}
            out = out + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(weight[0])
        return out

    def posterior(self, named: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(named)))


def fit(counts: list[tuple[tuple[int, ...], int]], rules: list[str], rounds: int = 60) -> VoteModel:
    """EM over distinct vote patterns and how many documents have each; there are at most 3 ** len(rules) of them.

    A document begins as bad where any rule says so. A rule's votes keep the meaning they are written with: in each
    class its odds can't turn against it. With no documents the prior alone remains.
    """
    good = [0.9 if -1 not in pattern else 0.1 for pattern, _ in counts]
    prior, table = 0.5, {r: {v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for r in rules}
    total = sum(n for _, n in counts)
    for _ in range(rounds if total else 0):
        goods = sum(n * g for (_, n), g in zip(counts, good))
        prior = min(max((goods + 1) / (total + 2), 0.01), 0.99)
        for k, r in enumerate(rules):
            mass = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for (pattern, n), g in zip(counts, good):
                mass[pattern[k]][0] += n * (1 - g)
                mass[pattern[k]][1] += n * g
            bad_sum, good_sum = (sum(m[i] for m in mass.values()) for i in (0, 1))
            odds = {v: (m[0] / bad_sum, m[1] / good_sum) for v, m in mass.items()}
            bad, ok = odds[-1]
            odds[-1] = (max(bad, ok), ok)
            bad, ok = odds[1]
            odds[1] = (bad, max(bad, ok))
            odds[0] = (1.0, 1.0)  # abstaining says nothing
            table[r] = odds
        good = []
        for pattern, _ in counts:
            z = math.log(prior / (1 - prior)) + sum(math.log(table[r][v][1] / table[r][v][0]) for r, v in zip(rules, pattern))
            good.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
    return VoteModel(prior, table)


def fitted(counted: DataFrame) -> VoteModel:
    """The model of rows with counts: vote patterns are counted in Spark and these counts alone reach the driver."""
    named = votes()
    patterns = counted.select(*[v.alias(r) for r, v in named.items()]).groupBy(*named).count().collect()
    return fit([(tuple(row[r] for r in named), row["count"]) for row in patterns], list(named))


def with_verdict(counted: DataFrame, model: VoteModel) -> DataFrame:
    """Adds _q_base_failed, _q_posterior and _q_kept to rows with counts."""
    out = counted.withColumns({"_q_base_failed": base_failed(), "_q_posterior": model.posterior(votes())})
    return out.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_posterior") >= 0.5))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, counts (_q_...), _q_base_failed, _q_posterior and _q_kept of each row of `docs`; counts are taken once and stored.

    Nulls: a null text is empty and fails the base test. Repeated rows and ids are judged row by row; an empty table
    gives an empty table.
    """
    counted = with_counts(docs.select("doc_id", "text"), "text").drop("text")
    counted = Scratch(docs.sparkSession, "quality").keep(counted, "counts")
    return with_verdict(counted, fitted(counted))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with its columns. Counts are taken twice, so no text is stored or shuffled.

    The row number in the condition keeps the filter above the counts; pushed below, it would take them again and again.
    Columns of any name go through unread. Nulls, repeats and empty tables: as in `judged`.
    """
    model = fitted(with_counts(docs.select("text")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = with_verdict(with_counts(held), model).where("_q_kept and _q_row >= 0")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """`judged` for `documents`, a row for each of its rows: counts, base test, verdict and posterior."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judged(docs)
    return out.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in COUNTS], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_posterior").alias("posterior"))
