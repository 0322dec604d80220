"""Readers and writers of the data sets' file layouts; absent paths and unreadable files are empty, not errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _json(spark: SparkSession, path: str, schema: str | T.StructType, **options: str) -> DataFrame:
    """JSON by an explicit schema; rows that can't be read are dropped; an absent path has no rows."""
    own = _schema(schema)
    try:
        rows = spark.read.schema(own).options(mode="DROPMALFORMED", **options).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], own)
    return rows.withColumn("_file", F.col("_metadata.file_name")).select(*[f.name for f in own.fields], "_file")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    rows = _json(spark, path, schema)
    return rows.drop("_file")


def read_domain_map(spark: SparkSession, path: str) -> DataFrame:
    """(domain, title, kind, pos, value): one row for each record of a ``{domains: {name: {...}}}`` document; values as JSON text."""
    record = "struct<title:string,category:string,facts:array<string>,qa:array<struct<question:string,answer:string,keywords:array<string>>>,locations:array<struct<city:string,address:string>>,records:array<struct<name:string,role:string,email:string>>>"
    rows = _json(spark, path, f"domains map<string, {record}>", multiLine="true").select(F.explode("domains").alias("domain", "d"))
    out = None
    for kind in ("records", "facts", "qa", "locations"):
        value = F.col("v") if kind == "facts" else F.to_json("v")
        part = rows.select("domain", F.col("d.title").alias("title"), F.lit(kind).alias("kind"), F.posexplode(f"d.{kind}").alias("pos", "v")).select("domain", "title", "kind", "pos", value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def read_histories(spark: SparkSession, folder: str) -> DataFrame:
    """(user, turn, role, content) from a folder of one history file per user, named by the file."""
    rows = _json(spark, folder, "messages array<struct<role:string,content:string>>", multiLine="true")
    user = F.regexp_replace("_file", r"\.json$", "") if "_file" in rows.columns else F.lit("")
    return rows.select(user.alias("user"), F.posexplode("messages").alias("turn", "m")).select("user", "turn", "m.role", "m.content")


def read_page_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, title, blocks) of cached pages, the manifest left out, absent fields empty."""
    rows = _json(spark, folder, "doc_id string, title string, blocks array<string>", multiLine="true", pathGlobFilter="*.json")
    rows = rows.where("_file <> 'manifest.json'") if "_file" in rows.columns else rows
    return rows.select(F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"))


def read_store(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of an ``{items: [...]}`` store; anything but a list is no rows."""
    rows = _json(spark, path, f"items array<struct<{item}>>", multiLine="true")
    return rows.select(F.inline("items"))


def write_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines in global order: ordered files, ordered inside."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)


def write_store(rows: DataFrame, path: str, key: str, size: int = 10_000) -> None:
    """Stores of ``{items: [...]}``: so many files, by a hash of the key, that each has about ``size`` items, whatever the table's size."""
    parts = max(1, -(-rows.count() // size))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")
    rows.groupBy(part).agg(F.collect_list(F.struct(*rows.columns)).alias("items")).write.partitionBy("part").json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_partitioned(rows: DataFrame, path: str, *keys: str) -> None:
    """One folder for each value of the keys; a reader's filter on them prunes folders."""
    rows.write.partitionBy(*keys).json(path)


def read_partitioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def manifest(rows: DataFrame, version: str = "1") -> DataFrame:
    return rows.agg(F.count("*").alias("chunks")).withColumn("schema_version", F.lit(version))
