"""Line dedup with an edit join by segments, in DataFrame operations only.

Equal lines are one class, as are lines within so many edits as EDITS gives for the length of the shorter; of each class
the first occurrence in the corpus stays. A line of length l is split into edits + 1 segments. Of two lines within that
many edits one segment is equal in both, at a place that differs by a few characters at most; which places must be looked
at follows from the difference in length, and from the segments before and behind, which hold the other edits. So each
line posts its segments under its own length, and probes the places that segments of lines as long or a little shorter
can stand at, with the length in the key. Pairs that meet are held against each other by their counts of some letters,
which an edit changes by two at most, then by a banded automaton: bit d of its k-th integer says that with k edits as
many characters of one line are read as of the other, plus d less the number of edits.

A segment that many different lines share (more than BUCKET) would give all pairs of them. For one edit such lines are
joined by their neighbourhoods instead: lines that agree but for the character at one place form a clique, which is
stored as a star, and a line without one of its characters equals the shorter line; that has one row for each character.
For more edits they are dealt out as pairs of blocks, each of which is a bucket of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import BLANK_CHARS, Scratch, connected_components, sent_if_small

#: Length from which lines are met by so many edits, 3 at most; shorter lines with a word are met where they are equal.
EDITS = ((20, 1), (60, 2))
#: Different lines under one segment that are compared in pairs.
BUCKET = 200
#: Keys that lines meet in, hashes of lines that meet, and removed lines, up to which they are sent to all tasks; beyond
#: that keys or texts are shuffled to meet them.
SENT_KEYS, SENT_HASHES, SENT_LINES = 1_000_000, 500_000, 1_000_000
#: Numbers above any line's, and numbers that tell texts under one id apart.
ROW, TEXTS = 1 << 31, 1 << 24
#: Letters that are counted to tell lines apart.
COUNTED = "etaoinsrhldu"
KEY = ["doc_id", "t1", "t2"]
REMOVED = "array<struct<line: int, first_doc: bigint, first_line: int>>"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): rows that share an id are told apart by two hashes of their text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def place() -> Column:
    """One number for a line's place in the corpus, in order of doc_id, text and line."""
    number = lambda c, n: c.cast(f"decimal({n},0)")
    doc = number(F.col("doc_id"), 20) * number(F.lit(TEXTS), 8) + number(F.col("t1").bitwiseAND(F.lit(TEXTS - 1)), 8)
    return (number(doc, 28) * number(F.lit(ROW), 10) + number(F.col("line_no"), 10)).cast("decimal(38,0)")


def place_parts(at: Column) -> tuple[Column, Column]:
    """doc_id and line number of a place."""
    number = lambda n: F.lit(n).cast("decimal(20,0)")
    doc = (at - F.pmod(at, number(ROW * TEXTS))) / number(ROW * TEXTS)  # no remainder is left to round
    return doc.cast("long"), F.pmod(at, number(ROW)).cast("int")


def edits_for(n: Column, edits=EDITS) -> Column:
    """How many edits lines of length n are met by; 0 where they aren't."""
    out = F.lit(0)
    for least, k in edits:
        out = F.when(n >= least, k).otherwise(out)
    return out


def probed_shifts(k: int, i: int, longer: int) -> range:
    """Where segment i of k + 1 can stand in a line that is `longer` by so many characters, against its place in the shorter one."""
    return range(max(-i, longer - (k - i)), min(i, longer + (k - i)) + 1)


def segment_keys(line: Column, edits=EDITS) -> tuple[list[Column], list[Column]]:
    """Keys that the line posts and keys that it probes, null where there are fewer; the lowest two bits say for how many edits."""
    n, most = F.length(line), max(k for _, k in edits)

    def key(k: int, length: Column, i: int, shift: int) -> Column:
        start, end = (F.floor(length * x / (k + 1)).cast("int") for x in (i, i + 1))
        h = F.xxhash64(length, F.lit(i), F.substr(line, start + 1 + shift, end - start))
        return h.bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(k).cast("long"))

    def chosen(length: Column, of: dict[int, Column]) -> Column:
        out = F.lit(None).cast("long")
        for k, c in of.items():
            out = F.when(edits_for(length, edits) == k, c).otherwise(out)
        return out

    kinds = sorted({k for _, k in edits})
    own = [chosen(n, {k: key(k, n, i, 0) for k in kinds if i <= k}) for i in range(most + 1)]
    probes = []
    for longer in range(most + 1):
        places = {k: [(i, s) for i in range(k + 1) for s in probed_shifts(k, i, longer) if longer or s] for k in kinds if longer <= k}
        for slot in range(max(map(len, places.values()))):
            probes.append(chosen(n - longer, {k: key(k, n - longer, *x[slot]) for k, x in places.items() if slot < len(x)}))
    return own, probes


def within(x: Column, y: Column, k: int) -> Column:
    """Whether two strings are within k edits; the band is 2 k + 1 bits wide, r[e] has what is reached with e edits at most."""
    mask = (1 << (2 * k + 1)) - 1

    def below(r: Column) -> Column:
        return F.shiftleft(r, 1).bitwiseAND(F.lit(mask))

    start = [F.lit(1 << k)]
    for _ in range(k):
        start.append(start[-1].bitwiseOR(below(start[-1])))

    def step(x: Column, y: Column, s: Column, j: Column) -> Column:
        bit = lambda d: F.when(F.coalesce(F.get(x, j + d - k) == F.get(y, j), F.lit(False)), 1 << d).otherwise(0)
        same = bit(0)
        for d in range(1, 2 * k + 1):
            same = same + bit(d)
        # bound as a variable, so that it is made once
        return F.transform(F.array(same), lambda same: rows(s, same))[0]

    def rows(s: Column, same: Column) -> Column:
        out = [s["r0"].bitwiseAND(same)]
        for e in range(1, k + 1):
            old = s[f"r{e - 1}"]
            out.append(s[f"r{e}"].bitwiseAND(same).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(below(out[-1])))
        return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(out)])

    def automaton(x: Column, y: Column) -> Column:
        first = F.struct(*[r.alias(f"r{e}") for e, r in enumerate(start)])
        last = F.aggregate(F.slice(F.sequence(F.lit(0), F.size(y)), F.lit(1), F.size(y)), first, lambda s, j: step(x, y, s, j), lambda s: s[f"r{k}"])
        end = F.size(x) - F.size(y)
        out = F.lit(False)
        for d in range(-k, k + 1):
            out = F.when(end == d, last.bitwiseAND(F.lit(1 << (d + k))) > 0).otherwise(out)
        return out

    both = F.array(F.struct(characters(x).alias("x"), characters(y).alias("y")))
    return F.transform(both, lambda b: automaton(b["x"], b["y"]))[0]


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def letter_counts(line: Column) -> Column:
    n = F.length(line)
    return F.array(*[n - F.length(F.replace(line, F.lit(c))) for c in COUNTED])


def may_be_within(x: Column, y: Column, k: Column) -> Column:
    """Whether counts of letters differ by no more than k edits can make them: 2 k in all."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0), lambda s, d: s + d) <= 2 * k


def close(pairs: DataFrame, edits=EDITS) -> DataFrame:
    """Of (u, v, lu, lv, ...) the rows whose lines are within the edits of the shorter."""
    k = edits_for(F.least(F.length("lu"), F.length("lv")), edits)
    out = F.lit(False)
    for n in sorted({n for _, n in edits}):
        out = F.when(k == n, within(F.col("lu"), F.col("lv"), n)).otherwise(out)
    return pairs.where(out)


def neighbourhood_links(crowd: DataFrame, scratch: Scratch, edits=EDITS) -> tuple[DataFrame, DataFrame]:
    """For lines (id, line): links (u, v) that join all within one edit whose shorter line asks for one, and (id, n_links)."""
    n, one = F.length("line"), lambda x: edits_for(x, edits) == 1
    crowd = crowd.where(one(n) | one(n - 1))
    at = crowd.select("id", "line", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    front, back = F.left("line", F.col("i") - 1), F.right("line", n - F.col("i"))
    posted = scratch.keep(at.select("id", "i", n.alias("n"), F.xxhash64(n, "i", front, F.lit(1), back).alias("hole"), F.xxhash64(F.concat(front, back)).alias("rest")), "holes")
    alike = posted.where(one(F.col("n")))
    cliques = alike.groupBy("n", "i", "hole").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1")
    in_clique = alike.join(cliques, ["n", "i", "hole"])
    stars = in_clique.where("id <> least").select(F.col("least").alias("u"), F.col("id").alias("v"))
    whole = crowd.where(one(n)).select(F.col("id").alias("shorter"), F.xxhash64("line").alias("rest"), (n + 1).alias("n"))
    drops = scratch.keep(posted.join(whole, ["n", "rest"]).select(F.col("id").alias("u"), F.col("shorter").alias("v")).distinct(), "drops")
    each = in_clique.select("id", (F.col("size") - 1).alias("k")).unionAll(drops.selectExpr("u id", "1L k")).unionAll(drops.selectExpr("v id", "1L k"))
    return stars.unionAll(drops).distinct(), each.groupBy("id").agg(F.sum("k").alias("n_links"))


def bucket_pairs(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of met (k, id, own, size) that share a key which one of them owns, and whose letter counts let them be close.

    Lines of a bucket are compared within an array, so what can't be close is no row. A bucket of more than BUCKET lines
    is cut into blocks, and each two blocks meet in an array of their own.
    """
    blocks = F.ceil(F.col("size") / BUCKET).cast("int")
    dealt = met.join(texts.select("id", "c"), "id").withColumns({"b": F.pmod(F.xxhash64("id"), blocks).cast("int"), "o": F.explode(F.sequence(F.lit(0), blocks - 1))})
    cells = dealt.groupBy("k", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi")).agg(F.collect_list(F.struct("id", "own", "b", "c")).alias("all"))
    cells = cells.where(F.exists("all", lambda x: x["own"])).withColumn("edits", F.col("k").bitwiseAND(F.lit(3)).cast("int"))
    here = lambda a, b: (a["id"] < b["id"]) & (a["own"] | b["own"]) & ((F.col("lo") == F.col("hi")) | (a["b"] != b["b"]))
    fits = lambda a, b: F.when(here(a, b), may_be_within(a["c"], b["c"], F.col("edits"))).otherwise(False)
    found = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: fits(a, b)), lambda b: F.struct(a["id"].alias("u"), b["id"].alias("v")))))
    return cells.select(F.inline(found)).distinct()


def line_classes(docs: DataFrame, scratch: Scratch, short: bool, edits=EDITS) -> tuple[DataFrame, DataFrame]:
    """All lines that take part (doc_id, t1, t2, line_no, h1, h2), and for those whose class has another occurrence (h1, h2, keep_at, n_links)."""
    split = with_key(docs.where("doc_id is not null")).select(*KEY, F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    enough = F.length("line") >= min(n for n, _ in edits)
    found = split.withColumn("line", F.trim("line", F.lit(BLANK_CHARS))).where(enough | F.rlike("line", F.lit(r"[\p{L}\p{N}]")) if short else enough)
    found = found.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})
    own, probes = segment_keys(F.col("line"), edits)
    names = [f"k{i}" for i in range(len(own) + len(probes))]
    lines = scratch.keep(found.select(*KEY, "line_no", "h1", "h2", *[c.alias(n) for c, n in zip([*own, *probes], names)]), "lines")
    each = lines.groupBy("h1", "h2").agg(F.min(place()).alias("first_at"), F.count("*").alias("n"), *[F.first(n).alias(n) for n in names])
    each = scratch.keep(each.withColumn("id", F.monotonically_increasing_id()), "distinct")
    posted = each.select("id", F.posexplode(F.array(*names)).alias("slot", "k")).where("k is not null").select("k", "id", (F.col("slot") < len(own)).alias("own"))
    buckets = posted.groupBy("k").agg(F.count("*").alias("size"), F.sum(F.col("own").cast("int")).alias("owns")).where("size > 1 and owns > 0").select("k", "size")
    met = scratch.keep(posted.join(sent_if_small(scratch.keep(buckets, "buckets"), SENT_KEYS), "k"), "met")
    crowded, one = F.col("size") > BUCKET, F.col("k").bitwiseAND(F.lit(3)) == 1
    ids = sent_if_small(scratch.keep(met.groupBy("id").agg(F.max(crowded & one).alias("crowded")), "ids"), SENT_HASHES)
    needed = sent_if_small(scratch.keep(each.select("id", "h1", "h2").join(ids, "id"), "needed"), SENT_HASHES)
    texts = found.select("h1", "h2", "line").join(needed, ["h1", "h2"]).groupBy("id", "crowded").agg(F.first("line").alias("line"))
    texts = scratch.keep(texts.withColumn("c", letter_counts(F.col("line"))), "texts")

    pairs = scratch.keep(bucket_pairs(met.where(~(crowded & one)), texts), "pairs")
    side = lambda x: texts.select(F.col("id").alias(x), F.col("crowded").alias(f"c{x}"), F.col("line").alias(f"l{x}"))
    k = edits_for(F.least(F.length("lu"), F.length("lv")), edits)
    sides = pairs.join(side("u"), "u").join(side("v"), "v").where(~(F.col("cu") & F.col("cv") & (k == 1)))
    links = scratch.keep(close(sides, edits).select("u", "v"), "close")
    counts = links.selectExpr("u id").unionAll(links.selectExpr("v id")).groupBy("id").agg(F.count("*").alias("n_links"))
    crowd = texts.where("crowded")
    if not crowd.isEmpty():
        more, also = neighbourhood_links(crowd.select("id", "line"), scratch, edits)
        more = close(more.join(side("u"), "u").join(side("v"), "v"), edits).select("u", "v")
        links, counts = links.unionAll(more), counts.unionAll(also).groupBy("id").agg(F.sum("n_links").alias("n_links"))
    classes = connected_components(links, "line-components")

    members = each.select("id", "h1", "h2", "first_at").join(classes.withColumnRenamed("node", "id"), "id").join(counts, "id", "left").select("component", "h1", "h2", "n_links", "first_at")
    members = scratch.keep(members, "members")
    heads = members.groupBy("component").agg(F.min("first_at").alias("keep_at"))
    joined = members.join(heads, "component").select("h1", "h2", "keep_at", "n_links")
    alone = each.where("n > 1").join(members, ["h1", "h2"], "left_anti").select("h1", "h2", F.col("first_at").alias("keep_at"), F.lit(0).cast("long").alias("n_links"))
    return lines.select(*KEY, "line_no", "h1", "h2"), scratch.keep(joined.unionAll(alone), "classes")


def repeated_lines(docs: DataFrame, short: bool = False, edits=EDITS) -> DataFrame:
    """(doc_id, t1, t2, n_links, removed): removed holds (line, first_doc, first_line) for each line whose class occurs before.

    A row for each text with such a line or with a link; n_links counts links of its lines to different texts. Lines
    are taken without white space around them. Occurrences are ordered by doc_id, text and line number; rows that share
    an id are told apart by t1 and t2, hashes of the text, and rows that repeat both keep the same lines. Rows with a null
    doc_id take no part. Lines too short for edits are met where they are equal if `short`, and only those with a word.
    An empty table gives none. Other columns of `docs` are not read.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines, classes = line_classes(docs.select("doc_id", "text"), scratch, short, edits)
    met = lines.join(classes, ["h1", "h2"]).select(*KEY, "line_no", "n_links", "keep_at", (place() != F.col("keep_at")).alias("again")).distinct()
    first_doc, first_line = place_parts(F.col("keep_at"))
    entry = F.struct(F.col("line_no").alias("line"), first_doc.alias("first_doc"), first_line.alias("first_line"))
    out = scratch.keep(met.groupBy(*KEY).agg(F.sum("n_links").alias("n_links"), F.sort_array(F.collect_list(F.when(F.col("again"), entry))).alias("removed")), "removed")
    scratch.drop_all_but("removed")
    return out


def without_repeats(docs: DataFrame, short: bool = False, edits=EDITS) -> DataFrame:
    """`docs` with its columns; texts without the lines that repeat an earlier one. Texts without such lines are as before."""
    found = repeated_lines(docs, short, edits).where(F.size("removed") > 0)
    gone = sent_if_small(found.select(*KEY, F.transform("removed", lambda x: x["line"]).alias("gone")), SENT_LINES, F.size("gone") + 4)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    joined = held.withColumns({"t1": F.xxhash64("body"), "t2": F.xxhash64(F.lit(1), "body")}).join(gone, KEY, "left")

    def cut(all_lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")

    bound = F.transform(F.array(lines_of(F.col("body"))), cut)[0]
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(bound)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each row of `documents`: how many lines it has and loses, links of its lines, and what is removed with the place that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeated_lines(docs, short=True)
    out = with_key(docs).select(*KEY, F.size(lines_of(F.col("text"))).cast("long").alias("n_lines")).join(found, KEY, "left")
    removed = F.coalesce("removed", F.array().cast(REMOVED))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), removed.alias("removed"))
