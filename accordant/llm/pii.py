"""PII spans: fixed patterns, and terms that give away a protected entity by what the corpus tells of them together.

Protected entities are the values that the patterns find, however rare. A term stands near an entity if it is in the
same line within NEAR characters. From how many documents have the entity, the term and both, the share of the entity's
information that the term discloses is PMI(term, entity) / IC(entity): 1 where the term is met with the entity alone.
Counts are smoothed, so few contexts tell less than many. Terms from THRESHOLD on become spans of kind `term` in all
documents, wherever they stand; all spans are then generalised to their kind's name or removed. DataFrame operations only.

Terms are counted over the whole corpus once, and only those that can still disclose something: a term is in at least as
many documents as among those with an entity, and where that many is already too often the pair is out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.shared import BLANK, Scratch, lower_ascii, sent_if_small

#: Fixed patterns, in the order of kinds. Quantifiers are possessive where that can't change a match, so long runs need
#: no stack; the first part of an email begins at its run's start or where the match before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that a text with a match of the kind has, looked for before the pattern is.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Share of an entity's information that a term may disclose; contexts that the entity's share of all documents weighs as
#: much as, when the share of the term's documents is estimated; characters on either side that are an entity's context.
THRESHOLD, PRIOR, NEAR = 0.9, 0.5, 150
#: Strings that are sent to all tasks at most; beyond that the other side is shuffled to meet them.
SENT_TERMS = 1_000_000
#: Characters of a word, as the inside of a class: letters, and all beyond ASCII.
LETTERS = r"A-Za-z\x{80}-\x{10FFFF}"
#: Letters that a term has at the least.
TERM_LETTERS = 3
CHUNK = 256
SPANS = "array<struct<kind: string, start: bigint, end: bigint, value: string, near: string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right each second digit doubled, nines cast out of what exceeds 9."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def context(before: Column, after: Column) -> Column:
    """What of the same line stands next to a match, NEAR characters on either side; words that are cut there are left out."""
    left, right = F.substring_index(before, "\n", -1), F.substring_index(after, "\n", 1)
    left = F.when(F.length(left) > NEAR, F.regexp_replace(F.right(left, F.lit(NEAR)), r"^\S++", "")).otherwise(left)
    right = F.when(F.length(right) > NEAR, F.regexp_replace(F.left(right, F.lit(NEAR)), r"\S++$", "")).otherwise(right)
    return F.concat(left, F.lit(" "), right)


def located(gaps: Column, matches: Column, kind: str, keep: Callable[[Column], Column], near: Callable[[Column, Column], Column]) -> Column:
    """Spans of those of `matches` that `keep` lets pass, of which gaps[i] stands before matches[i] and gaps[i + 1] behind.

    Sums run in chunks, so many matches cost no square.
    """

    def of(gaps: Column, matches: Column) -> Column:
        size = lambda i: (F.length(F.get(gaps, i)) + F.length(F.get(matches, i))).cast("long")
        n = F.size(matches)
        chunk = lambda c: F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, n) - 1)
        chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
        sizes = F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0).cast("long"), lambda s, i: s + size(i)))

        def spans(c: Column, before: Column) -> Column:
            first = F.struct(before.alias("at"), F.array().cast(SPANS).alias("out"))

            def add(s: Column, i: Column) -> Column:
                end = s["at"] + size(i)
                match = F.get(matches, i)
                span = F.struct(F.lit(kind).alias("kind"), (end - F.length(match)).alias("start"), end.alias("end"), match.alias("value"), near(F.get(gaps, i), F.get(gaps, i + 1)).alias("near"))
                return F.struct(end.alias("at"), F.when(keep(match), F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

            return F.aggregate(chunk(c), first, add, lambda s: s["out"])

        def all_chunks(sizes: Column) -> Column:
            before = lambda c: F.aggregate(F.slice(sizes, F.lit(1), c), F.lit(0).cast("long"), lambda s, x: s + x)
            return F.flatten(F.transform(chunks, lambda c: spans(c, before(c))))

        return F.transform(F.array(sizes), all_chunks)[0]

    # bound as variables, so neither array is made again for each element
    return F.transform(F.array(F.struct(gaps.alias("g"), matches.alias("m"))), lambda x: of(x["g"], x["m"]))[0]


def text_key(text: Column) -> list[Column]:
    """Two numbers that together stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def with_base(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, base): spans that the patterns find, by kind and start."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        out = out.withColumn(f"m_{kind}", F.when(F.contains("text", F.lit(NEEDED[kind])), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))

    def found(kind: str) -> Column:
        matches = F.col(f"m_{kind}")
        any_holds = F.exists(matches, lambda m: holds(kind, m))
        return F.when(any_holds, located(F.split("text", PATTERNS[kind]), matches, kind, lambda m: holds(kind, m), context)).otherwise(F.array().cast(SPANS))

    # the row number keeps a filter on `base` above this step; pushed below, it would run each pattern again
    return out.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.concat(*map(found, PATTERNS)).alias("base"))


def entity_of(span: Column) -> Column:
    """One value for the ways in which an entity is written."""
    plain = F.regexp_replace(span["value"], r"[\x20().-]", "")
    return F.when(span["kind"] == "email", lower_ascii(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(plain)


def terms_of(text: Column) -> Column:
    """The distinct words of a text, lower-cased; shorter ones than terms, empty ones too, may be among them."""
    return F.array_distinct(F.split(F.lower(text), rf"[^{LETTERS}]+"))


def telling_share(n_lines: Column, n_both: Column, n_term: Column, share: Column) -> Column:
    """Share of the term's documents that are taken to have the entity, which `share` of all documents have.

    n_both / n_term is known from n_lines different contexts, since copies of one text are no evidence, and smoothed by
    PRIOR contexts of `share`.
    """
    return (n_lines * F.least(F.lit(1.0), n_both / n_term) + PRIOR * share) / (n_lines + PRIOR)


def discloses(n_lines: Column, n_both: Column, n_term: Column, share: Column) -> Column:
    """Whether PMI reaches THRESHOLD of the entity's information; an entity of all documents has none."""
    return (share < 1) & (F.log2(telling_share(n_lines, n_both, n_term, share) / share) >= -THRESHOLD * F.log2(share))


def disclosing(having: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(t1, t2, terms): by the key of a text its words that disclose some entity, for texts with such a word.

    having: (row, text, base) of documents with a span, stored; docs: all documents. Counts are of rows.
    """
    spans = having.select("row", F.explode("base").alias("s")).select("row", entity_of(F.col("s")).alias("entity"), "s.near")
    plain = F.regexp_replace("near", r"\S*[@0-9]\S*", " ")
    near = spans.withColumn("terms", terms_of(plain)).groupBy("row", "entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    # equal contexts are counted before their terms are taken apart
    near = scratch.keep(near.groupBy("entity", "terms").agg(F.count("*").alias("n")), "near")
    entities = near.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    pairs = near.select("entity", "n", F.explode("terms").alias("term")).where(F.length("term") >= TERM_LETTERS).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_lines"))
    total = float(docs.count())
    share = F.col("n_entity") / F.lit(max(total, 1.0))
    test = lambda n: discloses(F.col("n_lines"), F.col("n_both"), n, share)
    among = having.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_among"))
    pairs = scratch.keep(pairs.join(entities, "entity").where(test(F.col("n_both"))).join(among, "term").where(test(F.col("n_among"))).drop("n_among"), "pairs")
    candidates = scratch.keep(pairs.select("term").distinct(), "candidates")
    words = docs.select(*text_key(F.col("text")), F.explode(terms_of(F.col("text"))).alias("term"))
    met = scratch.keep(words.join(sent_if_small(candidates, SENT_TERMS), "term").select("t1", "t2", "term"), "met")
    known = pairs.join(met.groupBy("term").agg(F.count("*").alias("n_term")), "term")
    telling = scratch.keep(known.where(test(F.col("n_term"))).select("term").distinct(), "telling")
    return met.join(sent_if_small(telling, SENT_TERMS), "term").groupBy("t1", "t2").agg(F.collect_set("term").alias("terms"))


def term_spans(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text, base, terms) all spans, those of terms outside base spans included: each word that is a term."""
    word = rf"[{LETTERS}]++"
    is_term = lambda w: F.array_contains("terms", F.lower(w))
    words = located(F.split("text", word), F.regexp_extract_all("text", F.lit(word), F.lit(0)), "term", is_term, lambda before, after: F.lit(None).cast("string"))
    found = F.filter(words, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", found))
    plain = lambda spans: F.transform(spans, lambda s: s.dropFields("near"))
    kept = F.when((F.size("base") > 0) | F.col("terms").isNotNull(), F.col("text")).alias("text")
    return docs.select("doc_id", kept, plain(F.col("base")).alias("base"), plain(spans).alias("spans"))


def all_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, base, spans) for each row of `docs`, stored; without text where there are neither spans nor terms.

    Texts meet their terms by a hash of the text, so rows without an id and rows that share one are served alike.
    """
    found = with_base(docs)
    having = scratch.keep(found.where(F.size("base") > 0), "having")
    terms = scratch.keep(disclosing(having, docs.select(F.coalesce("text", F.lit("")).alias("text")), scratch), "terms")
    keyed = found.select("doc_id", "text", "base", *text_key(F.col("text")))
    return scratch.keep(term_spans(keyed.join(sent_if_small(terms, SENT_TERMS, F.size("terms")), ["t1", "t2"], "left")), "spans")


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, spans) for each row of `docs` with a span; spans begin with base ones and end with terms, each by start.

    Null texts are empty. Rows with a null doc_id and rows that share an id are judged each by their own text, and
    counted each. Other columns of `docs` are not read. An empty table gives an empty table.
    """
    return all_spans(docs, Scratch(docs.sparkSession, "pii")).where(F.size("spans") > 0)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind in brackets; spans that overlap become one, of the first's kind."""

    def merge(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))
        return F.when((F.size(out) > 0) & (s["start"] < last["end"]), joined).otherwise(F.concat(out, F.array(s)))

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    plain = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    merged = F.aggregate(plain, F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>"), merge)

    def write(s: Column, x: Column) -> Column:
        piece = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.struct(F.concat(s["out"], piece, F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(merged, first, write, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """pii_spans of `documents`, one row for each of its rows: counts and digest of base spans, all spans, and the sanitised text (null if there is no span)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = all_spans(docs, Scratch(spark, "pii"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    clean = F.when(F.size("spans") > 0, sanitised(F.col("text"), F.col("spans"))).alias("sanitised")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), clean)
