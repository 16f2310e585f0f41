"""JSON readers and writers with stated behaviour for blank, broken and empty input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def _lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row per line that isn't blank: ``file``, ``line``, the fields of ``schema`` and the text of a broken line."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_json("line", T.StructType([*fields, T.StructField(BAD, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return raw.select("file", "line", parsed.alias("r")).select("file", "line", "r.*")


def read_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, empty: bool = True) -> DataFrame:
    """Objects of a file with one per line, blank lines skipped, with ``source``, the name of the file without its ending.

    ``strict`` fails on a line that isn't an object of the schema and says which;
    otherwise such lines are left out. Without ``empty`` a file of no objects fails.
    """
    rows = _lines(spark, path, schema)
    if strict:
        bad = rows.where(F.col(BAD).isNotNull() | ~F.trim("line").startswith("{")).select("file", "line").first()
        if bad:
            raise ValueError(f"{bad['file']}: not an object of the schema: {bad['line'][:80]}")
    out = rows.where(F.col(BAD).isNull() & F.trim("line").startswith("{")).drop("line", BAD)
    if not empty and out.isEmpty():
        raise ValueError(f"{path}: no objects")
    return out.withColumn("source", F.regexp_replace("file", r"\.[^.]*$", "")).drop("file")


def broken_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """``file, n``: lines that a lenient read leaves out."""
    rows = _lines(spark, path, schema)
    return rows.where(F.col(BAD).isNotNull() | ~F.trim("line").startswith("{")).groupBy("file").agg(F.count("*").alias("n"))


def read_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Objects of files that are one array each; fails on anything else."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_any(spark: SparkSession, path: str, schema: str, required: str | None = None) -> DataFrame:
    """An array or one object per line, told apart by the first sign that isn't blank; rows with an empty ``required`` are left out."""
    head = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    rows = read_array(spark, path, schema) if head and head["c"] == "[" else read_lines(spark, path, schema).drop("source")
    return rows.where(F.col(required).isNotNull() & (F.col(required) != "")) if required else rows


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """``cluster_id, id, query, rank, probability`` of a nested cluster report; fails where it has no clusters."""
    schema = "clusters array<struct<cluster_id:int,size:int,queries:array<struct<id:string,query:string,rank:bigint,probability:double>>>>"
    report = read_array(spark, path, schema)
    if report.where("clusters is null").count() or report.isEmpty():
        raise ValueError(f"{path}: no clusters")
    return report.select(F.explode("clusters").alias("c")).select("c.cluster_id", F.explode("c.queries").alias("q")).select("cluster_id", "q.*")


def read_template(path: str, names: tuple[str, ...]) -> str:
    """A prompt template that has to hold ``{{NAME}}`` for every name."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    lacking = [n for n in names if "{{" + n + "}}" not in text]
    if lacking:
        raise ValueError(f"{path}: lacks {', '.join(lacking)}")
    return text


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of image files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def append_lines(df: DataFrame, path: str) -> None:
    """Adds one object per row to a folder of line files."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a folder anew, beside the old one, which is replaced when all rows are written; the folder must not be one that ``df`` reads."""
    if any(path.rstrip("/") in f for f in df.inputFiles()):
        raise ValueError("a table can't be replaced by rows read from it")
    spark, new = df.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(new)
    there, beside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new))
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(there, True)
    if not files.rename(beside, there):
        raise OSError(f"{new} can't be renamed")


def retrieval_report(ranks: DataFrame, source: str, rank: str, threshold: int = 60) -> DataFrame:
    """One nested row: overall measures, measures by source, and the number of ranks above ``threshold``."""
    r = F.col(rank)
    one = ranks.where(r.isNotNull()).agg(F.count("*").alias("queries"), F.avg(1 / r).alias("mrr"), F.count_if(r > threshold).alias("above"))
    by = ranks.where(r.isNotNull()).groupBy(source).agg(F.count("*").alias("queries"), F.avg(1 / r).alias("mrr"))
    nested = by.agg(F.sort_array(F.collect_list(F.struct(source, "queries", "mrr"))).alias("by_source"))  # a row per source
    return one.crossJoin(F.broadcast(nested)).select(F.struct("queries", "mrr").alias("overall"), F.struct(F.lit(threshold).alias("threshold"), F.col("above").alias("count")).alias("failures"), "by_source")
