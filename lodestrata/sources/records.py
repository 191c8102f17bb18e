"""Content-addressed records and blobs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.ids import source_id_column


def scan(spark: SparkSession, folder: str, kind: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Records of a kind, once each, in typed columns with record_sha256, and the files that were rejected with the reason.

    Files are <folder>/<kind>/aa/<sha256>.json, named by the SHA-256 of their content; batches are
    <folder>/<kind>-batch/... with version 1, record_kind, records and as many item_sha256s, each once and in order. A name
    or item that disagrees with its content, and a batch of another form, is rejected.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    files = reader.load(f"{folder}/{kind}").select("path", F.col("content").cast("string").alias("json"), F.sha2("content", 256).alias("sha"))
    files = files.withColumn("named", F.regexp_extract("path", r"([0-9a-f]{64})\.json$", 1))
    good = files.filter("named = sha")
    bad = files.filter("named <> sha").select("path", F.lit("name differs from content").alias("reason"))
    rows = good.select("json", F.col("sha").alias("record_sha256"))
    try:
        batches = reader.load(f"{folder}/{kind}-batch").select("path", F.col("content").cast("string").alias("json"))
        parsed = batches.select("path", F.from_json("json", "version int, record_kind string, records array<string>, item_sha256s array<string>").alias("b"))
        digests = F.col("b.item_sha256s")
        whole = (F.col("b.version") == 1) & (F.col("b.record_kind") == kind) & (F.size("b.records") == F.size(digests)) & (digests == F.array_sort(F.array_distinct(digests)))
        whole = F.coalesce(whole, F.lit(False))
        bad = bad.unionByName(parsed.filter(~whole).select("path", F.lit("envelope of the batch is wrong").alias("reason")))
        parsed = parsed.filter(whole)
        items = parsed.select("path", F.explode(F.arrays_zip(F.col("b.records").alias("r"), F.col("b.item_sha256s").alias("s"))).alias("i"))
        items = items.select("path", F.col("i.r").alias("json"), F.col("i.s").alias("record_sha256"), F.sha2(F.col("i.r"), 256).alias("sha"))
        rows = rows.unionByName(items.filter("sha = record_sha256").select("json", "record_sha256"))
        bad = bad.unionByName(items.filter("sha is distinct from record_sha256").select("path", F.lit("item differs from its digest").alias("reason")))
    except Exception as e:  # no batches of this kind
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return rows.dropDuplicates(["record_sha256"]).select("record_sha256", F.from_json("json", schema).alias("r")).select("record_sha256", "r.*"), bad


def sink(df: DataFrame, path: str, key: str = "record_sha256") -> None:
    """Appends the rows whose key the table at `path` has not; rows of one key count once. Running it again adds nothing."""
    spark, fresh = df.sparkSession, df.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)


def sink_batch(df: DataFrame, path: str, key: str = "record_sha256") -> int:
    """Writes the rows not yet at `path`, in order of key and in one go: a table that a reader finds whole or not at all. Returns how many were new."""
    spark, fresh = df.sparkSession, df.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    from pyspark.sql import Observation

    seen = Observation()
    fresh.repartitionByRange(key).sortWithinPartitions(key).observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def put_blobs(contents: DataFrame, path: str) -> DataFrame:
    """Stores contents (column content) by their digest in a table at `path`, each once; returns sha256, byte_length of what was given."""
    rows = contents.filter(F.col("content").isNotNull()).select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("byte_length"), "content")
    sink(rows, path, "sha256")
    return rows.select("sha256", "byte_length").distinct()


def read_blobs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """sha256, content of the wanted digests (column sha256); reading one that is missing or whose content has another digest fails."""
    held = wanted.select("sha256").distinct().join(spark.read.parquet(path).select("sha256", "content"), "sha256", "left")
    good = F.sha2("content", 256) == F.col("sha256")
    return held.withColumn("content", F.when(good, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("blob missing or altered: "), "sha256")).cast("binary")))


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256, byte_length, content of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"), "content")


def ingest(files: DataFrame) -> DataFrame:
    """source_version_id and payload of each distinct content of blobs(); the smallest path names it."""
    return files.groupBy(source_id_column(F.col("content")).alias("source_version_id")).agg(F.min("path").alias("source_uri"), F.max("byte_length").alias("byte_length"), F.min("content").alias("content"))


def validate(df: DataFrame, rules: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected rows carry the names of the rules that do not hold; a rule that is null does not hold."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    marked = df.withColumn("failed_rules", failed)
    return marked.filter(F.size("failed_rules") == 0).drop("failed_rules"), marked.filter(F.size("failed_rules") > 0)


def discover_files(spark: SparkSession, folder: str, terms: list[str], limit: int, page_size: int | None = None, most_bytes: int = 10_000_000) -> DataFrame:
    """Text files below a folder that hold any of the terms: path, name, matched, rank and page; best first, then by path."""
    from pyspark.sql import Window

    from lodestrata.functions.text import term_matches, window_around

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter((F.col("length") <= most_bytes) & F.lower("path").rlike(r"\.(txt|md|markdown|html?|xml|json|ya?ml|csv)$"))
    text = F.concat(F.element_at(F.split("path", "/"), -1), F.lit("\n"), F.col("content").cast("string"))
    top = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), term_matches(text, terms).alias("matched"), window_around(F.col("content").cast("string"), terms).alias("snippet"))
    top = top.filter("matched > 0").orderBy(F.desc("matched"), "path").limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("matched"), "path")))  # over `limit` rows
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / (page_size or limit)).cast("int"))
