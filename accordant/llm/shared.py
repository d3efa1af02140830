"""What the corpus operators share: scratch tables in the cluster's shared folder, text helpers and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java regex class body.
BLANK = r"\x20\x09-\x0D"
#: The same characters, to trim by.
BLANK_CHARS = " \t\n\x0b\x0c\r"

_OWN_FOLDER: list[str] = []
#: Spark applications whose executors have this package.
_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a temporary folder of this process, on a single machine alone."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(f"file://{tempfile.mkdtemp(prefix='accordant-')}")
    return _OWN_FOLDER[0]


class Scratch:
    """Tables written to and read back from the shared folder, which cuts lineage and survives lost executors.

    They go when the driver's JVM ends, or earlier through drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))
        self._fs.deleteOnExit(self._path(self.folder))
        self._names: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self._names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def drop_all_but(self, *names: str) -> None:
        for name in self._names:
            if name not in names:
                self.drop(name)


def sent_if_small(table: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """A stored table, marked for broadcast if it has at most `most` rows (or its sum of `size` is at most that)."""
    found = table.agg(F.coalesce(F.sum(size), F.lit(0)) if size is not None else F.count("*")).first()[0]
    return F.broadcast(table) if found <= most else table


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, with this package sent to executors that don't have it installed."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = os.path.join(tempfile.mkdtemp(), "accordant.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(os.path.join(top, "accordant")):
                for name in (f for f in files if f.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, top))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return df.mapInArrow(function, schema)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often `use` has it."""
    return F.transform(F.array(value), use)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; null counts as empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def crc32_of(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): component is the least node that a node of `edges` (u, v) reaches.

    Contraction: each node points to its least neighbour, pointers are doubled until flat, edges are rewritten
    between roots, and this repeats until no edge is left. A round at least removes every node that has a lesser
    neighbour, so rounds grow with the logarithm of the longest path; all tables have at most a row for each edge.
    Both sides of each join come straight from scratch tables, so adaptive execution can split a hot root.
    Edges with a null end and self-loops are left out; an empty table gives an empty result.
    """
    scratch = Scratch(edges.sparkSession, name)
    pairs = scratch.keep(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges-0")
    labels, turn = None, 0
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        parent = scratch.keep(least.select(F.col("u").alias("node"), F.least("u", "m").alias("parent"), F.lit(True).alias("moved")), f"parent-{turn}-0")
        step = 0
        while not parent.where("moved").isEmpty():
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = parent.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
            step += 1
            parent = scratch.keep(jumped, f"parent-{turn}-{step}")
            scratch.drop(f"parent-{turn}-{step - 1}")
        root = parent.select("node", "parent")
        moved = (
            pairs.join(root.select(F.col("node").alias("u"), F.col("parent").alias("ru")), "u")
            .join(root.select(F.col("node").alias("v"), F.col("parent").alias("rv")), "v")
            .where("ru != rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
        turn += 1
        pairs = scratch.keep(moved, f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        if labels is None:
            labels = root.withColumnRenamed("parent", "component")
        else:
            labels = labels.join(root.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    if labels is None:
        kind = pairs.schema["u"].dataType.simpleString()
        return pairs.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component")).limit(0)
    out = scratch.keep(labels, "labels")
    scratch.drop_all_but("labels")
    return out
