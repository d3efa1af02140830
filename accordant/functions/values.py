"""Typed values of record fields and how two of them compare.

A value is STRUCT<tag, text, num>: tag is str, int, float, bool, list or dict; text is the string itself or the
canonical JSON; num is the number (booleans as 0 and 1) or null. A missing value (JSON null, absent key) is a null struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<tag: string, text: string, num: double>"

#: Strings that read as booleans, and the two DOI hosts that are one.
BOOLEAN_WORDS = ("yes", "no", "true", "false")
DOI_HOST, DOI_ALIAS = "https://doi.org/", "https://dx.doi.org/"

#: Error labels, and those that are matters of form.
FORMAT_LABELS = ("boolean_representation", "delimiter_or_case", "doi_format", "numeric_format_in_string")

BLANKS = r"(?U)^\s+|\s+$"


def value(tag: str, text: Column, num: Column | None = None) -> Column:
    """A value of one tag; null where `text` is."""
    number = F.lit(None).cast("double") if num is None else num.cast("double")
    made = F.struct(F.lit(tag).alias("tag"), text.cast("string").alias("text"), number.alias("num"))
    return F.when(text.isNotNull(), made)


def no_value() -> Column:
    return F.lit(None).cast(VALUE)


def is_missing(v: Column) -> Column:
    """Only null is missing; empty strings and lists are present."""
    return v.isNull()


def strip(text: Column) -> Column:
    """Without white space of any alphabet at either end."""
    return F.regexp_replace(text, BLANKS, "")


def normalise_doi(text: Column) -> Column:
    return F.replace(text, F.lit(DOI_HOST), F.lit(DOI_ALIAS))


def normalised(v: Column) -> Column:
    """Lower-cased and stripped text; missing counts as empty."""
    return F.coalesce(F.lower(strip(v["text"])), F.lit(""))


def values_match(pred: Column, gold: Column, field: Column, match_case: bool = True, match_whole_word: bool = True) -> Column:
    """Equality of two present values: never null.

    Strings compare as they are, or lower-cased without match_case; fields named *_doi take both DOI hosts as one; without
    match_whole_word the gold string may lie inside the predicted one. A string equals no other type; numbers and
    booleans compare as numbers, lists and objects by canonical text.
    """
    fold = (lambda c: c) if match_case else F.lower
    is_doi = F.endswith(field, F.lit("_doi"))
    doi = lambda c: F.when(is_doi, normalise_doi(c)).otherwise(c)
    p, g = doi(fold(pred["text"])), doi(fold(gold["text"]))
    strings = (p == g) if match_whole_word else F.contains(p, g)
    both, one = (pred["tag"] == "str") & (gold["tag"] == "str"), (pred["tag"] == "str") | (gold["tag"] == "str")
    numbers = F.coalesce(pred["num"] == gold["num"], F.lit(False))
    nested = pred["num"].isNull() & gold["num"].isNull() & (pred["tag"] == gold["tag"]) & (pred["text"] == gold["text"])
    return F.coalesce(F.when(both, strings).when(one, F.lit(False)).otherwise(numbers | nested), F.lit(False))


def is_correct(pred: Column, gold: Column, field: Column, match_case: bool = True, match_whole_word: bool = True) -> Column:
    """Both missing, or both present and equal."""
    return F.when(is_missing(gold), is_missing(pred)).when(is_missing(pred), F.lit(False)).otherwise(values_match(pred, gold, field, match_case, match_whole_word))


def value_key(v: Column) -> Column:
    """A string for grouping that tells 1, 1.0, true, "1" and null apart."""
    return F.coalesce(F.concat(v["tag"], F.lit(":"), v["text"]), F.lit("null"))


def is_boolean_like(text: Column) -> Column:
    return F.lower(strip(text)).isin(*BOOLEAN_WORDS)


def classify_error(field: Column, gold: Column, pred: Column, match_case: bool = True, match_whole_word: bool = True) -> Column:
    """One of eight labels, or null where there is no error; the first that applies. Strings that differ are looked at without outer white space."""
    g, p = strip(gold["text"]), strip(pred["text"])
    url = lambda c: F.rlike(c, F.lit(r"^https?://(dx\.)?doi\.org/"))
    joined = lambda c: F.lower(F.regexp_replace(c, r"(?U)[\s_\-]+", ""))
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0))
    return (
        F.when(is_missing(gold) & is_missing(pred), None)
        .when(is_missing(gold), "hallucinated_non_null")
        .when(is_missing(pred), "missed_non_null")
        .when(values_match(pred, gold, field, match_case, match_whole_word), None)
        .when(gold["tag"] != pred["tag"], "type_mismatch")
        .when(gold["tag"] != "str", "value_mismatch")
        .when(is_boolean_like(g) & is_boolean_like(p), "boolean_representation")
        .when(F.endswith(field, F.lit("_doi")) & (url(g) != url(p)), "doi_format")
        .when(joined(g) == joined(p), "delimiter_or_case")
        .when((F.size(digits(g)) > 0) & (digits(g) == digits(p)), "numeric_format_in_string")
        .otherwise("wrong_value")
    )


def sanitise_name(name: Column) -> Column:
    """An identifier: other characters become _, a leading digit gets f_ before it, nothing becomes unnamed."""
    plain = F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_")
    return F.when(plain == "", "unnamed").when(plain.rlike(r"^[0-9]"), F.concat(F.lit("f_"), plain)).otherwise(plain)


def format_interval(mean: Column, low: Column, high: Column) -> Column:
    """Two places, halves to even."""
    return F.when(F.isnan(mean), "-").otherwise(F.format_string("%.2f [%.2f, %.2f]", *[F.bround(c, 2) for c in (mean, low, high)]))


def format_p(p: Column) -> Column:
    return F.when(F.isnan(p), "-").when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", F.bround(p, 3)))


def shortened(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def json_string(text: Column) -> Column:
    """A JSON string in ASCII: other characters are written as \\u and four hex digits, those beyond 16 bits as two."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        out = F.replace(out, F.lit(char), F.lit(f"\\{name}"))
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n.cast("long"))), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        wide = F.concat(four(F.lit(0xD800) + F.floor((n - 0x10000) / 1024)), four(F.lit(0xDC00) + (n - 0x10000) % 1024))
        return F.when((n >= 32) & (n < 127), c).when(n < 0x10000, four(n)).otherwise(wide)

    each = F.array_join(F.transform(F.regexp_extract_all(out, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.concat(F.lit('"'), F.when(out.rlike(r"[^\x20-\x7e]"), each).otherwise(out), F.lit('"'))


def cache_key(function: Column, params: Column) -> Column:
    """SHA-256 of canonical JSON: the function's name and its parameters (a map of strings) in order of name."""
    pair = lambda e: F.concat(json_string(e["key"]), F.lit(": "), F.coalesce(json_string(e["value"]), F.lit("null")))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(params)), pair), ", ")
    return F.sha2(F.concat(F.lit('{"func_name": '), json_string(function), F.lit(', "params": {'), body, F.lit("}}")), 256)


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole as double, `empty` for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))
