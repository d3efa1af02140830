"""Record comparison on small hand-computed records read from JSON files."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.functions import values as V
from accordant.operators import batches
from accordant.operators import errors as E
from accordant.operators import facts as A
from accordant.operators import lookup as L
from accordant.operators import statistics as S
from accordant.operators import templates as T
from accordant.sources import records as R
from accordant.streaming import cache

TEMPLATE = {"name": "t", "children": [{"name": "tissue", "permissible_values": [{"type": "ontology"}], "required": True}, {"name": "title"}, {"name": "note"}, {"name": "n"}]}


def write(root, assay, kind, name, record):
    folder = root / assay / kind
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(record))


@pytest.fixture
def root(tmp_path):
    (tmp_path / "schemas").mkdir()
    (tmp_path / "schemas" / "x.json").write_text(json.dumps(TEMPLATE))
    for i in range(3):
        write(tmp_path, "x", "gold", f"r{i}", {"tissue": "lung", "title": f"study{i}", "note": None, "n": 1})
        write(tmp_path, "x", "input", f"r{i}", {"tissue": "Lung", "old": f"study{i}", "note": "", "n": "1"})
        write(tmp_path, "x", "output/m/experiment", f"r{i}", {"tissue": "LUNG", "title": "wrong", "note": None, "n": 1.0, "extra": 5})
        write(tmp_path, "x", "output/m/baseline", f"r{i}", {"tissue": "liver", "title": "wrong", "note": "x", "n": "1"})
    write(tmp_path, "x", "gold", "alone", {"tissue": "lung", "title": "only", "note": None, "n": 2})
    return str(tmp_path)


@pytest.fixture
def rows(spark, root):
    return R.read_json_records(spark, root)


def test_tags_tell_json_types_apart(spark, tmp_path):
    write(tmp_path, "a", "gold", "r", {"i": 1, "f": 1.0, "b": True, "s": "1", "z": None, "l": [1, "a"], "d": {"b": 1, "a": 2}, 'q"x': "y", "dot.ted": 3})
    got = {r["field"]: r["value"] for r in R.read_json_records(spark, str(tmp_path)).collect()}
    assert {k: v and v["tag"] for k, v in got.items()} == {"i": "int", "f": "float", "b": "bool", "s": "str", "z": None, "l": "list", "d": "dict", 'q"x': "str", "dot.ted": "int"}
    assert got["f"]["text"] == "1.0" and got["b"]["num"] == 1.0 and got["d"]["text"] == '{"a":2,"b":1}'


def test_malformed_files_are_listed(spark, tmp_path):
    write(tmp_path, "a", "gold", "good", {"x": 1})
    (tmp_path / "a" / "gold" / "bad.json").write_text("[1")
    assert [r["record"] for r in R.malformed(spark, str(tmp_path)).collect()] == ["bad.json"]


def test_accuracies(spark, root, rows):
    facts = A.field_facts(rows, R.read_templates(spark, root), A.run("experiment")).cache()
    each = {r["record"]: r.asDict() for r in A.record_accuracy(facts).collect()}
    assert set(each) == {"r0.json", "r1.json", "r2.json"}  # records without predictions are out
    assert each["r0.json"]["ontology_constrained_field_accuracy"] == 0.0  # case counts
    assert each["r0.json"]["all_field_accuracy"] == 0.5
    folded = A.field_facts(rows, R.read_templates(spark, root), A.run("experiment"), match_case=False)
    assert {r["all_field_accuracy"] for r in A.record_accuracy(folded).collect()} == {0.75}
    dedup = A.dedup_summary(facts).first()
    assert (dedup["n_ontology_pairs"], dedup["n_unique_pairs"]) == (1, 6) and dedup["all_field_accuracy"] == pytest.approx(2 / 6)
    gold = rows.where(A.gold_side()).select("assay", "field", F.col("value").alias("gold"))
    split = {r["bucket"]: (r["accuracy"], r["n_instances"]) for r in A.frequency_split(facts, gold).collect()}
    assert split == {"singleton": (0.0, 3), "recurring": (pytest.approx(2 / 3), 9)}
    assert {r["bucket"]: r["n_instances"] for r in A.frequency_split(facts, gold, "ontology").collect()} == {"singleton": 0, "recurring": 3}


def test_uncorrected_counts_populated_fields(spark, root, rows):
    facts = A.field_facts(rows, R.read_templates(spark, root), A.legacy_side())
    assert A.overall_summary(facts).first()["all_field_accuracy"] == 0.0
    folded = A.field_facts(rows, R.read_templates(spark, root), A.legacy_side(), match_case=False)
    assert A.overall_summary(folded).first()["all_field_accuracy"] == 0.25
    assert A.overall_summary(A.populated(folded)).first()["all_field_accuracy"] == 0.33
    assert A.overall_summary(A.populated(folded), None).first()["all_field_accuracy"] == pytest.approx(1 / 3)


def match(spark, gold, pred, field="f", **flags):
    made = lambda v: V.value("str", F.lit(v)) if v is not None else V.no_value()
    return spark.range(1).select(V.is_correct(made(pred), made(gold), F.lit(field), **flags)).first()[0]


@pytest.mark.parametrize(
    ("gold", "pred", "field", "flags", "expected"),
    [
        (None, None, "f", {}, True), ("a", None, "f", {}, False), (None, "a", "f", {}, False), ("", "", "f", {}, True), ("", None, "f", {}, False),
        ("World", "hello world", "f", {"match_whole_word": False}, False), ("World", "hello world", "f", {"match_whole_word": False, "match_case": False}, True), ("A", "a", "f", {}, False), ("A", "a", "f", {"match_case": False}, True), ("hello world", "world", "f", {"match_whole_word": False}, False),
        ("A", "a", "f", {"match_case": True}, False), ("https://doi.org/1", "https://dx.doi.org/1", "x_doi", {}, True), ("https://doi.org/1", "https://dx.doi.org/1", "x", {}, False),
    ],
)
def test_match(spark, gold, pred, field, flags, expected):
    assert match(spark, gold, pred, field, **flags) is expected


@pytest.mark.parametrize(
    ("field", "gold", "pred", "label"),
    [
        ("f", "Yes", "true", "boolean_representation"), ("a_doi", "https://doi.org/1", "1", "doi_format"), ("a_doi", " https://doi.org/1", "1x", "doi_format"), ("f", "Yes", "yes", "boolean_representation"), ("f", "Axio Scan.Z1", "axio scan.z1", "delimiter_or_case"), ("f", "a-b c", "A_BC", "delimiter_or_case"),
        ("f", "3 um", "3um/x", "numeric_format_in_string"), ("f", "x", "y", "wrong_value"), ("f", None, "y", "hallucinated_non_null"), ("f", "x", None, "missed_non_null"), ("f", None, None, None),
    ],
)
def test_error_labels(spark, field, gold, pred, label):
    made = lambda v: V.value("str", F.lit(v)) if v is not None else V.no_value()
    assert spark.range(1).select(V.classify_error(F.lit(field), made(gold), made(pred))).first()[0] == label


def test_error_types_of_other_tags(spark):
    one, text, two = V.value("int", F.lit("1"), F.lit(1)), V.value("str", F.lit("1")), V.value("int", F.lit("2"), F.lit(2))
    got = spark.range(1).select(V.classify_error(F.lit("f"), one, text), V.classify_error(F.lit("f"), one, two)).first()
    assert tuple(got) == ("type_mismatch", "value_mismatch")


@pytest.mark.parametrize(
    ("ontology", "kind", "gold", "pred", "own", "legacy", "empty", "cause"),
    [
        (True, "wrong_value", "g", "l", "l", {"f": "l"}, True, "missing_ontology_result"), (True, "wrong_value", "g", "l", "l", {"f": "l"}, None, "other"),
        (False, "doi_format", "g", "p", "", {}, None, "format_or_variant"), (False, "wrong_value", "g", "p", "o", {"f": "o", "h": "p"}, None, "field_mapping_confusion"),
        (False, "wrong_value", "g", "q", "o", {"f": "o"}, None, "external_information_required"), (False, "wrong_value", "g", "q", "o", {"f": "has g in"}, None, "other"), (True, "wrong_value", "g", "q", "o", {}, None, "other"),
    ],
)
def test_causes(spark, ontology, kind, gold, pred, own, legacy, empty, cause):
    keys, values = (F.array(*map(F.lit, x)).cast("array<string>") for x in (legacy.keys(), legacy.values()))
    column = E.classify_cause(F.lit(ontology), F.lit(kind), F.lit(gold), F.lit(pred), F.lit(own), F.map_from_arrays(keys, values), F.lit(empty).cast("boolean"))
    assert spark.range(1).select(column).first()[0] == cause


def test_empty_terms_from_traces(spark, tmp_path):
    line = lambda term, n: ["term_search", "tool", f"{{'search_string': '{term}'}}", json.dumps({"totalCount": n})]
    rows = [line("AxioScan.Z1", 0), line("Zeiss", 1), line("lipids", 0), line("lipids", 2), line("it\\'s", 0), ["other", "tool", "{'search_string': 'no'}", ""]]
    import csv

    for name in ("a_experiment.csv", "a_baseline.csv"):
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f).writerows([["name", "run_type", "inputs", "outputs"], *(rows if "exp" in name else [line("never", 0)])])
    found = E.empty_search_terms(E.searches_of(R.read_traces(spark, str(tmp_path))))
    assert {r[0] for r in found.collect()} == {"axioscan.z1", "it's"}


def test_paired_tables(spark, root, rows):
    sides = {"gold": A.gold_side(), "base": A.run("baseline"), "arms": A.run("experiment")}
    cells = A.with_schema(A.aligned(rows, sides, ["base", "arms"]), R.read_templates(spark, root))
    paired = S.paired_counts(A.with_outcomes(cells)).cache()
    assert paired.count() == 9
    row = S.mcnemar_counts(paired.where("category = 'all'")).first()
    assert (row["b"], row["c"], row["statistic"]) == (0, 6, 0.0)
    assert S.with_mcnemar_p(S.mcnemar_counts(paired.where("category = 'all'"))).first()["p"] == pytest.approx(S.mcnemar_p(0, 6))
    table = {r["category"]: r for r in S.overall_table(paired).collect()}
    assert table["all"]["n_records"] == 3 and table["all"]["arms"] == "0.50 [0.50, 0.50]" and table["ontology"]["mcnemar_c"] == 0
    each = S.per_assay_table(paired, R.assay_table(spark, [("w", "W"), ("x", "X")])).collect()
    assert [r["assay"] for r in each] == ["X"]


def test_tests_on_known_cases():
    assert S.mcnemar_p(1, 9) == pytest.approx(0.021484375) and S.mcnemar_p(0, 0) == 1.0 and S.mcnemar_p(2, 50) < 0.001
    assert S.wilcoxon_p(10, 0, 0) == pytest.approx(2 / 2**10) and S.wilcoxon_p(0, 0, 0) == 1.0
    assert S.permutation(np.array([3, 1, 0, -1]), np.array([1, 1, 1, 1]))[:2] == (3.0, 3)
    assert S.permutation(np.array([5]), np.array([20]))[2] < 0.001 and S.permutation(np.array([5, -5]), np.array([7, 3]))[2] > 0.05
    assert S.bootstrap_mean(np.array([0.5]), np.array([4])) == (0.5, 0.5, 0.5) and math.isnan(S.bootstrap_mean(np.array([]), np.array([]))[0])
    assert S.bootstrap_ratio(np.array([1, 1]), np.array([1, 3]), np.array([1, 1]))[0] == 0.5


def test_bootstrap_agrees_with_drawing_rows():
    values, n = np.array([0.0, 0.5, 1.0]), np.array([10, 30, 20])
    rng = np.random.default_rng(1)
    rows = np.repeat(values, n)
    low, high = np.percentile(rows[rng.integers(0, 60, (10_000, 60))].mean(axis=1), [2.5, 97.5])
    _, a, b = S.bootstrap_mean(values, n)
    assert a == pytest.approx(low, abs=0.02) and b == pytest.approx(high, abs=0.02)


def test_effective_sample_size(spark):
    rows = [("x", f"f{k % 2}", "v", k % 2 == 0) for k in range(6)]
    facts = spark.createDataFrame(rows, "assay string, field string, value_key string, is_correct boolean")
    out = S.effective_sample_size(facts).first()
    assert (out["n"], out["n_clusters"]) == (6, 2) and out["icc"] > 0.99 and out["n_effective"] == pytest.approx(2)
    one = S.effective_sample_size(facts.where("field = 'f0'")).first()
    assert one["icc"] is None and one["n_effective"] == 3


def test_best_term(spark):
    schema = "q string, query string, pos int, label string, synonyms array<string>, obsolete boolean, iri string"
    rows = [("1", "Lung ", 0, "lung lobe", None, False, "a"), ("1", "Lung ", 1, "lung", [], True, "b"), ("1", "Lung ", 2, "LUNG", [], None, "c"), ("2", "zz", 0, "other", ["Zz"], False, "d"), ("3", "zz", 0, "other", ["zzz"], True, "e")]
    got = {r["q"]: (r["iri"], round(r["score"], 2)) for r in L.best_terms(spark.createDataFrame(rows, schema), "q").collect()}
    assert got == {"1": ("c", 1.0), "2": ("d", 0.6)}


def test_cache(spark):
    rows = [("a", 0.0, 10, "old", False), ("a", 5.0, 10, "new", False), ("b", 0.0, 1, "x", False), ("c", 9.0, 10, "e", True)]
    latest = L.cache_latest(spark.createDataFrame(rows, "key string, created_at double, ttl int, v string, is_error boolean"), "v")
    got = [tuple(r) for r in L.cache_get(latest, F.lit(8.0)).select("key", "v", "cache_age_seconds").collect()]
    assert got == [("a", "new", 3.0)]
    assert tuple(L.cache_remove_stale(latest, F.lit(8.0)).first()) == (1, 1) and L.cache_clear(latest).first()[0] == 2
    key = lambda *kv: spark.range(1).select(V.cache_key(F.lit("f"), F.create_map(*[F.lit(x) for x in kv]))).first()[0]
    assert key("a", "1", "b", "2") == key("b", "2", "a", "1") != key("a", "2", "b", "1")


def test_costs(spark):
    usage = spark.createDataFrame([("gpt-4o", 10**6, 10**6), ("gpt-4o-mini-2024", 10**6, 0), ("nope", 5, 5)], "model string, prompt long, completion long")
    got = {r["model"]: r["cost"] for r in L.token_costs(usage, "model").collect()}
    assert got == {"gpt-4o": 12.5, "gpt-4o-mini-2024": 2.5, "nope": 0.0}
    assert L.usage_summary(L.token_costs(usage)).first()["summary"].startswith("User prompt tokens: 2,000,005 | ")


def test_final_response(spark):
    rows = [(1, 0, "assistant", "first"), (1, 2, "assistant", " \t\n"), (1, 3, "user", "last"), (2, 0, "user", "none")]
    assert [tuple(r) for r in L.final_responses(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()] == [(1, "first")]


def test_exact_sample(spark):
    names = spark.range(1000).select(F.when(F.col("id") < 900, "a").otherwise("b").alias("source"), F.col("id").cast("string").alias("name"))
    counts = spark.createDataFrame([("a", 37), ("b", 500)], "source string, n int")
    got = L.exact_sample(names, counts, 1)
    assert {r[0]: r[1] for r in got.groupBy("source").count().collect()} == {"a": 37, "b": 100}
    assert set(got.collect()) == set(L.exact_sample(names, counts, 1).collect()) != set(L.exact_sample(names, counts, 2).collect())


def test_templates(spark):
    nested = {"name": "t", "children": [{"name": "a", "type": "element", "children": [{"name": "b", "type": "integer"}]}, {"name": "c", "type": "decimal", "multivalued": True}, {"name": "d", "type": "odd"}]}
    assert T.schema_of(nested).simpleString() == "struct<a:struct<b:bigint>,c:array<double>,d:string>"
    assert T.schema_of({"name": "e", "children": []}).simpleString() == "struct<>" and T.field_names(nested) == ["a.b", "c", "d"]
    assert [T.sanitised(x) for x in ("1 a", "", "ok")] == ["f_1_a", "unnamed", "ok"]
    raw = ['{"a": {"b": 1}, "c": [1.5], "d": null}', '{"a": {"x": 1}, "c": null, "d": ""}', '{"a": null}', "[]"]
    found = T.validated(spark.createDataFrame([(x,) for x in raw], "value string"), nested).collect()
    assert [r["problems"] for r in found] == [[], ["missing a.b", "unknown a.x"], ["missing c", "missing d"], None]
    assert found[0]["parsed"]["a"]["b"] == 1 and found[1]["parsed"] is None


def test_records_are_read_back(spark, rows, tmp_path):
    before = {tuple(r) for r in rows.collect()}
    files = R.write_records(rows, str(tmp_path / "out"))
    assert files == 13 and {tuple(r) for r in R.read_json_records(spark, str(tmp_path / "out")).collect()} == before
    body = (tmp_path / "out" / "x" / "output" / "m" / "experiment" / "r0.json").read_text()
    assert json.loads(body) == {"tissue": "LUNG", "title": "wrong", "note": None, "n": 1.0, "extra": 5} and body.startswith('{\n  "')


def test_other_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("s", "gold", "a", "{}"), ("s", "input", "a", "{}")], "source string, role string, name string, value string")
    R.write_pairs(frame, str(tmp_path / "pairs"))
    with pytest.raises(Exception, match="already exists"):
        R.write_pairs(frame, str(tmp_path / "pairs"))
    R.write_pairs(frame, str(tmp_path / "pairs"), overwrite=True)
    assert spark.read.json(str(tmp_path / "pairs")).count() == 2
    R.write_csv(frame, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == frame.columns
    assert R.target_file(None, "a.json", "/d") == "/d/a.json" and R.target_file(str(tmp_path), "a.json") == str(tmp_path / "a.json") and R.target_file("/x/b.json", "a.json") == "/x/b.json"


def test_plot_intervals(spark, root, rows):
    facts = A.run_facts(rows, R.read_templates(spark, root), ["baseline", "experiment"])
    scores = A.run_scores(facts).cache()
    got = {r["run_type"]: tuple(r)[2:] for r in S.score_intervals(scores).collect()}
    assert got == {"baseline": (0.0, 0.0, 0.0, 3), "experiment": (0.5, 0.5, 0.5, 3)}
    chart = A.chart_rows(S.score_intervals(scores), R.assay_table(spark, [("w", "W"), ("x", "X")]), ["experiment", "other"]).collect()
    assert [tuple(r) for r in chart] == [("X", "experiment", 0.5, 0.5, 0.5), ("X", "other", 0.0, 0.0, 0.0)]


def test_draws_come_in_chunks(monkeypatch):
    whole = S.bootstrap_mean(np.arange(5.0), np.full(5, 4))
    monkeypatch.setattr(S, "HELD", 500)
    assert S.bootstrap_mean(np.arange(5.0), np.full(5, 4)) == whole


def test_rounding_is_half_to_even_after_scaling(spark):
    got = spark.createDataFrame([(0.125,), (0.135,), (1.005,), (0.575,)], "x double").select(A.shown(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [float(np.round(x, 2)) for x in (0.125, 0.135, 1.005, 0.575)]


def test_sampling_refuses_too_many(spark):
    names = spark.createDataFrame([("a", str(i)) for i in range(5)], "source string, name string")
    counts = lambda n, s="a": spark.createDataFrame([(s, n)], "source string, n int")
    assert L.checked_counts(names, counts(5)).first()["n"] == 5
    for bad in (counts(6), counts(1, "b")):
        with pytest.raises(ValueError, match="not enough paired names"):
            L.checked_counts(names, bad)
    assert [tuple(r) for r in L.unmatched_counts(names, names.limit(2)).collect()] == [("a", 3)]


def test_picked_terms(spark):
    terms = spark.createDataFrame([("X", "b1", 0, "lung", None, False, "i1"), ("X", "b2", 1, "lung", None, False, "i2"), ("Y", "b1", 0, "other", None, False, "i3")], "acronym string, branch string, pos int, label string, synonyms array<string>, obsolete boolean, iri string")
    asked = spark.createDataFrame([("Lung", "X", "b2"), ("Lung", "X", "b2"), ("kidney", "Y", "b1"), ("old", "X", "b1")], "query string, acronym string, branch string")
    key = asked.where("query = 'old'").select(L.pick_key("query", "acronym", "branch").alias("key"))
    cached = key.select("key", F.lit(0.0).alias("created_at"), F.lit(10).alias("ttl"), F.lit("Old").alias("label"), F.lit("o").alias("iri"))
    for now, old in ((5.0, ("Old", "o", True)), (50.0, (None, None, False))):
        picked = L.picked_terms(asked, terms, cached, F.lit(now), True)
        got = {r["query"]: tuple(r)[3:] for r in picked.collect()}
        assert got == {"Lung": ("lung", "i2", False), "kidney": (None, None, False), "old": old}
        assert L.new_entries(picked, F.lit(now)).count() == (2 if old[2] else 3)


def test_cache_tables(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "cache")
    assert L.cache_table(spark, folder).count() == 0
    row = lambda k, v, at, bad=False: (k, v, "f", "p", at, 10, bad)
    L.cache_set(spark.createDataFrame([row("a", "1", 0.0), row("a", "2", 5.0), row("b", "x", 5.0, True), row("c", "old", 0.0)], L.ENTRIES + ", is_error boolean"), folder)
    assert L.cache_table(spark, folder).count() == 3
    left = L.cache_compact(spark, folder, str(tmp_path / "next"), F.lit(12.0))
    assert [(r["key"], r["value"]) for r in left.collect()] == [("a", "2")]
    monkeypatch.setenv("ACCORDANT_CACHE_TTL_SECONDS", "x")
    assert L.lifetime() == 86_400
    monkeypatch.setenv("ACCORDANT_CACHE_TTL_SECONDS", "7")
    monkeypatch.setenv("ACCORDANT_CACHE_DIR", "/c")
    assert L.lifetime() == 7 and L.cache_folder() == "/c"


def test_cache_keys_are_of_canonical_json(spark):
    import hashlib

    params = {"b": 'q"\\\n\x1f', "a": "é😀", "c": "\x7f~"}
    expected = hashlib.sha256(json.dumps({"func_name": "f", "params": params}, sort_keys=True).encode()).hexdigest()
    assert spark.range(1).select(V.cache_key(F.lit("f"), F.create_map(*[F.lit(x) for kv in params.items() for x in kv]))).first()[0] == expected


def test_answers_in_blocks(spark):
    rows = [(1, 0, "assistant", None, [("a",), ("",), ("b",)]), (1, 1, "assistant", " ", []), (2, 0, "user", "x", None)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, blocks array<struct<text: string>>")
    assert [tuple(r) for r in L.final_responses(frame).collect()] == [(1, "a\nb")]
    with pytest.raises(Exception, match="no text response"):
        L.final_responses(frame, required=True).collect()


def test_batches(spark):
    prompts = spark.createDataFrame([("x", f"r{i}", str(i)) for i in range(7)], "assay string, record string, prompt string")
    got = {r["record"]: r["value"] for r in batches.run_batch(prompts, lambda p: '{"a": %s}' % p, 3).collect()}
    assert got == {f"r{i}": f'{{"a": {i}}}' for i in range(7)}
    checked = batches.last_answers(batches.run_batch(prompts, lambda p: '{"a": 1}' if p == "3" else "[]"), lambda d: T.validated(d, {"children": [{"name": "a", "type": "integer"}]}))
    assert [r["record"] for r in checked.collect()] == ["r3"]


def test_streamed_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("a", "2020-01-01 00:10:00"), ("b", "2020-01-01 02:00:00")], "key string, at string").select("key", F.to_timestamp("at").alias("created_at"))
    rows.write.parquet(str(tmp_path / "in"))
    for name, made, n in (("fresh", cache.fresh_entries, 2), ("hits", cache.hit_counts, 2)):
        stream = made(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName(name).outputMode("append" if name == "fresh" else "update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() == n


def test_command_line(spark, root, tmp_path, monkeypatch):
    from accordant.__main__ import main

    for what in ("report", "summary", "causes", "significance", "plot"):
        main([what, root, "--csv", str(tmp_path / what)])
        assert spark.read.option("header", True).csv(str(tmp_path / what)).count() > 0
    main(["sample", root, "--sources", "x", "--counts", "2", "--seed", "1", "--output", str(tmp_path / "sampled")])
    assert spark.read.json(str(tmp_path / "sampled")).where("role = 'gold'").count() == 2
