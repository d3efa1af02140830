"""Sources: folders of JSON records, template schemas, trace logs and the assay dimension; sinks for results."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions.values import json_string

#: Columns of a long table of records. A run type is set for predictions alone.
RECORDS = "assay string, role string, model string, run_type string, record string, field string, value struct<tag: string, text: string, num: double>"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset a temporary one, on a single machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written by the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def plain_path(encoded: Column) -> Column:
    """A path or name as _metadata has it, which is part of a URI, as it is in the file system."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def read_json_records(spark: SparkSession, root: str, pattern: str = "*/*", model: str = "*") -> DataFrame:
    """Records of <root>/<assay>/(input|gold)/*.json and <root>/<assay>/output/<model>/<run_type>/*.json, one row a field.

    A file that isn't one JSON object gives no rows here; `malformed` lists those. A record without fields has none.
    """
    typed = _typed(_raw(spark, root, model))
    return typed.select("assay", "role", "model", "run_type", "record", "field", "value")


def _raw(spark: SparkSession, root: str, model: str) -> DataFrame:
    paths = [f"{root}/*/input/*.json", f"{root}/*/gold/*.json", f"{root}/*/output/{model}/*/*.json"]
    found = [p for p in paths if exists(spark, p)]
    text = spark.read.text(found, wholetext=True).select("value", plain_path(F.col("_metadata.file_path")).alias("path"), plain_path(F.col("_metadata.file_name")).alias("record"))
    place = r"/([^/]+)/(?:(input|gold)|output/([^/]+)/([^/]+))/[^/]+$"
    part = lambda k: F.nullif(F.regexp_extract("path", place, k), F.lit(""))
    return text.select("value", "record", part(1).alias("assay"), F.coalesce(part(2), F.lit("output")).alias("role"), part(3).alias("model"), part(4).alias("run_type"))


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether some file or folder fits a path with wildcards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _typed(raw: DataFrame) -> DataFrame:
    """Explodes objects to fields; tags come from the JSON text of each value, so 1 and 1.0 stay apart."""
    fields = raw.withColumns({"v": F.try_parse_json("value"), "texts": F.from_json("value", "map<string,string>")})
    objects = fields.where(F.schema_of_variant("v").startswith("OBJECT"))
    one = objects.select("assay", "role", "model", "run_type", "record", "texts", F.explode(F.col("v").cast("map<string,variant>")).alias("field", "item"))
    one, item = one.withColumn("text", F.try_element_at("texts", F.col("field"))), F.col("item")
    kind = F.schema_of_variant(item)
    tag = (
        F.when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.when(F.col("text").rlike(r"^-?[0-9]+$"), "int").otherwise("float"))
        .when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "dict")
    )
    text = F.when(tag.isin("list", "dict"), F.to_json(item)).otherwise(F.col("text"))
    number = F.when(tag.isin("int", "float"), F.expr("try_cast(text as double)")).when(tag == "bool", F.col("text").cast("boolean").cast("double"))
    made = F.struct(tag.alias("tag"), text.alias("text"), number.alias("num"))
    return one.withColumn("value", F.when(tag.isNotNull() & F.col("text").isNotNull(), made))


def malformed(spark: SparkSession, root: str, model: str = "*") -> DataFrame:
    """(assay, role, record) of files that don't hold one JSON object."""
    raw = _raw(spark, root, model)
    kind = F.schema_of_variant(F.try_parse_json("value"))
    return raw.where(kind.isNull() | ~kind.startswith("OBJECT")).select("assay", "role", "record")


def template_rows(assay: str, template: dict) -> list[tuple[str, str, bool, bool, int]]:
    """(assay, field, is_ontology, required, ord) of a template's top-level fields."""
    rows = []
    for place, child in enumerate(template.get("children") or []):
        kinds = {p.get("type") for p in child.get("permissible_values") or []}
        rows.append((assay, child["name"], bool(kinds & {"branch", "ontology"}), child.get("required") is True, place))
    return rows


def read_templates(spark: SparkSession, root: str) -> DataFrame:
    """(assay, field, is_ontology, required, ord) from <root>/schemas/<assay>.json; of top-level fields alone."""
    raw = spark.read.text(f"{root}/schemas/*.json", wholetext=True).select("value", F.regexp_extract(plain_path(F.col("_metadata.file_name")), r"^(.*)\.json$", 1).alias("assay"))
    child = "struct<name: string, required: boolean, permissible_values: array<struct<type: string>>>"
    parsed = raw.select("assay", F.from_json("value", f"struct<children: array<{child}>>").alias("t"))
    each = parsed.select("assay", F.posexplode("t.children").alias("ord", "c"))
    ontology = F.exists(F.coalesce("c.permissible_values", F.array().cast("array<struct<type: string>>")), lambda p: p["type"].isin("branch", "ontology"))
    return each.select("assay", F.col("c.name").alias("field"), F.coalesce(ontology, F.lit(False)).alias("is_ontology"), F.coalesce("c.required", F.lit(False)).alias("required"), "ord")


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """(name, run_type, inputs, outputs) of all *experiment*.csv files of a folder, fields of any length."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(f"{folder}/*experiment*.csv").select("name", "run_type", "inputs", "outputs")


def assay_table(spark: SparkSession, assays: list[tuple[str, str]]) -> DataFrame:
    """(assay, label, ord) in the order given."""
    rows = F.array(*[F.struct(F.lit(k).alias("assay"), F.lit(label).alias("label"), F.lit(i).alias("ord")) for i, (k, label) in enumerate(assays)])
    return spark.range(1, numPartitions=1).select(F.inline(rows)).select("assay", "label", "ord")


def write_records(records: DataFrame, root: str) -> int:
    """One JSON file for each record, in the folders that read_json_records reads; how many files were written.

    Tasks write their own records, each file under its final name, so a repeated attempt writes the same bytes again.
    """
    text = F.when(F.col("value.tag") == "str", json_string(F.col("value.text"))).otherwise(F.coalesce("value.text", F.lit("null")))
    pair = F.concat(F.lit("  "), json_string(F.col("field")), F.lit(": "), text)
    place = F.when(F.col("role") == "output", F.concat_ws("/", "assay", F.lit("output"), "model", "run_type")).otherwise(F.concat_ws("/", "assay", "role"))
    rows = records.groupBy(place.alias("place"), "record").agg(F.concat(F.lit("{\n"), F.array_join(F.sort_array(F.collect_list(pair)), ",\n"), F.lit("\n}")).alias("body"))

    def write(batches):
        import pyarrow as pa
        import pyarrow.fs as pfs

        fs, top = pfs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pfs.LocalFileSystem(), root)
        for batch in batches:
            for folder, name, body in zip(*(c.to_pylist() for c in batch.columns)):
                fs.create_dir(f"{top}/{folder}", recursive=True)
                with fs.open_output_stream(f"{top}/{folder}/{name if name.endswith('.json') else name + '.json'}") as out:
                    out.write(body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_csv(result: DataFrame, folder: str) -> None:
    """A small result table as one CSV file with a header."""
    result.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_pairs(chosen: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Chosen (source, role, name, value) rows in folders by source and role; refuses a folder that exists unless told."""
    chosen.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("source", "role").json(folder)


def load_templates(spark: SparkSession, root: str) -> list[tuple[str, dict]]:
    """(assay, template) of <root>/schemas/*.json, in order of name: a few templates, kept on the driver."""
    raw = spark.read.text(f"{root}/schemas/*.json", wholetext=True).select("value", F.regexp_extract(plain_path(F.col("_metadata.file_name")), r"^(.*)\.json$", 1).alias("assay"))
    return [(r["assay"], json.loads(r["value"])) for r in raw.orderBy("assay").collect()]


def target_file(target: str | None, name: str, default_folder: str | None = None) -> str:
    """Where one result goes: a file as named, a folder with the input's name in it, or by default a temporary folder."""
    if target is None:
        return os.path.join(default_folder or tempfile.gettempdir(), name)
    return os.path.join(target, name) if os.path.isdir(target) or target.endswith(os.sep) else target
