"""URL filter: rules on host and path, and block decisions that spread over redirects and canonical links.

Pages, redirect targets and canonical targets are nodes of a graph, named by host, path and query; each redirect or
canonical link joins two. Rules are applied to nodes. In a connected component an allowed node lets its aliases pass,
else a blocked one blocks them; a rule that fits a page itself always comes first. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm.shared import Scratch, connected_components, let, lower_ascii

#: Verdict, host and path of each rule.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
TARGET = r"(?is);\s*url\s*=\s*[\"']?([^\"'>\s]+)"


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Host, path (/ if empty) and query, without scheme and fragment; null for what has no host."""

    def named(rest: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(rest, r"^[^#]*", 0), r"^([^/?]+)(?=\?|$)", "$1/")

    def split(name: Column) -> Column:
        return let(F.regexp_extract(name, r"^[^/?]*", 0), lambda host: F.when(host != "", F.concat(lower_ascii(host), F.substr(name, F.length(host) + 1))))

    return let(url, lambda u: let(named(_rest(u)), split))


def without_dots(path: Column) -> Column:
    """A path without . and .. parts, each of which takes the part before it along."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def add(out: Column, part: Column) -> Column:
        return F.when(part == ".", out).when(part == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(part)))

    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), add), "/")
    return F.when(F.contains(path, F.lit("/.")), F.concat(kept, F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def resolved(to: Column, url: Column, host: Column, path: Column) -> Column:
    """The target of a link as a full address, as seen from a page."""
    scheme = F.substring_index(url, "://", 1)
    site = F.concat(scheme, F.lit("://"), host)
    target, rest = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?", 1))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(target == "", F.concat(site, path, rest))
        .when(F.startswith(to, F.lit("/")), F.concat(site, without_dots(target), rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, target)), rest))
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1, numPartitions=1).select(F.inline(rows)).select("verdict", "host", "path")


def with_rules(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Adds `rule` (host and path as one string) and `ruling`: of the longest rule that fits host and path, else null.

    Rules are gathered by host and met by each ending of the host that has as many labels as some rule's host, so no
    row is multiplied; Spark broadcasts the rules where they are small. Of rules of one length an allowing one wins.
    """
    known = rules.where("host is not null and path is not null").select("verdict", F.lower("host").alias("_h"), F.col("path").alias("p"), F.concat("host", "path").alias("rule"))
    depths = [r[0] for r in known.select(F.size(F.split("_h", r"\.")).alias("n")).distinct().orderBy("n").collect()]
    by_host = known.groupBy("_h").agg(F.collect_set(F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule"), F.col("p"))).alias("_r"))
    none = F.array().cast("array<struct<n: int, verdict: string, rule: string, p: string>>")
    out = urls
    for n in depths:
        ending = F.substring_index(F.col(host), ".", -n)
        full = F.size(F.split(F.col(host), r"\.")) >= n
        out = out.withColumn(f"_e{n}", F.when(full, ending)).join(by_host.select(F.col("_h").alias(f"_h{n}"), F.col("_r").alias(f"_r{n}")), F.col(f"_e{n}") == F.col(f"_h{n}"), "left")
    met = reduce(F.concat, [F.coalesce(f"_r{n}", none) for n in depths], none)
    fitting = F.filter(met, lambda r: F.startswith(F.col(path), r["p"]))
    best = F.element_at(F.array_sort(F.transform(fitting, lambda r: F.named_struct(F.lit("n"), -r["n"], F.lit("verdict"), r["verdict"], F.lit("rule"), r["rule"]))), 1)
    out = out.withColumn("_best", F.when(F.size(fitting) > 0, best))
    return out.select(*urls.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("ruling"))


def html_links(pages: DataFrame) -> DataFrame:
    """(u, v): nodes of pages and of all targets that their canonical links and refreshes name."""
    lowered = F.lower("html")
    found = pages.where(F.col("url").contains("://") & (F.contains(lowered, F.lit("canonical")) | F.contains(lowered, F.lit("http-equiv"))))
    every = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    href = lambda tag: F.trim(F.concat(*[F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)]))
    targets = F.concat(F.transform(every(LINK), href), F.transform(every(REFRESH), lambda tag: F.trim(F.regexp_extract(tag, TARGET, 1))))
    found = found.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.explode(targets).alias("to")).where("host <> '' and to <> ''")
    full = resolved(F.col("to"), F.col("url"), F.col("host"), F.col("path"))
    # an array of one keeps the condition behind this step; before it, each node would be made again and again
    both = F.array(F.struct(node_of(F.col("url")).alias("u"), node_of(full).alias("v")))
    return found.select(F.inline(both)).where("u is not null and v is not null and u <> v")


def judged_pages(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component) for each row of `pages` (page_id, url, html).

    redirects: (source_url, target_url) beside what pages name. component: the least node of the page's aliases, itself
    if it has none. A null url or one without "://" has no host, fits no rule and passes. Repeated rows are judged
    alike; an empty table gives an empty table. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    links = html_links(pages)
    if redirects is not None:
        more = redirects.select(F.inline(F.array(F.struct(node_of(F.col("source_url")).alias("u"), node_of(F.col("target_url")).alias("v")))))
        links = links.unionAll(more.where("u is not null and v is not null and u <> v"))
    found = connected_components(links, "url-components")
    nodes = found.withColumns({"host": F.regexp_extract("node", r"^[^/?#]*", 0), "path": F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)})
    ruled = with_rules(nodes, rules).groupBy("component").agg(F.bool_or(F.col("ruling") == "allow").alias("allow"), F.bool_or(F.col("ruling") == "block").alias("block"))
    spread = F.when(F.coalesce("allow", F.lit(False)), F.lit("allow")).when(F.coalesce("block", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    shared = scratch.keep(found.join(ruled.select("component", spread.alias("spread")), "component").select("node", "component", "spread"), "spread")
    own = with_rules(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")), rules)
    out = own.join(shared, "node", "left")
    verdict = F.coalesce("ruling", "spread", F.lit("allow"))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "node").alias("component"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """`judged_pages` for `pages`, a row for each of its rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged_pages(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")
