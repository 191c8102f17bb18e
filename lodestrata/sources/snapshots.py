"""Snapshots of relations: immutable folders, stamped, and one pointer to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import integrity

#: Pointers are numbered files; the greatest number counts.
POINTER = "CURRENT-"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, folder: str) -> list[str]:
    """The names of all pointers, the latest last."""
    p, fs = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith(POINTER)) if fs.exists(p) else []


def _point(spark: SparkSession, folder: str, snapshot: str) -> None:
    """Writes a pointer beside the others and renames it to the next number: at no time is there none, and a crash leaves the last one valid."""
    jvm = spark.sparkContext._jvm
    new, fs = _fs(spark, f"{folder}/pointer-{snapshot}.tmp")
    out = fs.create(new, True)
    out.write(bytearray(snapshot.encode()))
    out.close()
    old = _pointers(spark, folder)
    number = int(old[-1].removeprefix(POINTER)) + 1 if old else 0
    if not fs.rename(new, jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}{number:012d}")):
        raise RuntimeError("another writer took the pointer")
    for name in old[:-1]:  # the former one stays, for readers who have just listed it
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), False)


def write(folder: str, tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]] = ()) -> str:
    """Writes tables as a new snapshot, checks the keys (table, field, parent, parent key), stamps it and makes it current; its id is the digest of its stamp.

    Raises ValueError, and leaves the pointer, if a reference leads nowhere. A reader sees the old snapshot or the new one, never a part.
    """
    import hashlib
    import uuid

    spark = next(iter(tables.values())).sparkSession
    place = f"{folder}/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}")
    written = {name: spark.read.parquet(f"{place}/{name}") for name in tables}
    if keys:
        bad = integrity.violations(written, list(keys))
        if not bad.isEmpty():
            raise ValueError(f"references lead nowhere: {bad.limit(5).collect()}")
    stamp = integrity.stamp(written)
    rows = stamp.collect()  # one row a table
    spark.createDataFrame(rows, stamp.schema).write.parquet(f"{place}/stamp")
    _point(spark, folder, place.rsplit("/", 1)[1])
    return hashlib.sha256("".join(r["digest"] for r in rows).encode()).hexdigest()


def current(spark: SparkSession, folder: str) -> str:
    """The folder of the current snapshot."""
    names = _pointers(spark, folder)
    if not names:
        raise ValueError(f"no snapshot in {folder}")
    return f"{folder}/{spark.read.text(f'{folder}/{names[-1]}').first()[0]}"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current snapshot."""
    return spark.read.parquet(f"{current(spark, folder)}/{name}")


def verify(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Tables of the current snapshot that differ from their stamp, with what to do."""
    place = current(spark, folder)
    there = {}
    for n in names:
        p, fs = _fs(spark, f"{place}/{n}")
        if fs.exists(p):
            there[n] = spark.read.parquet(f"{place}/{n}")
    return integrity.verify(there, spark.read.parquet(f"{place}/stamp"))


def inventory(spark: SparkSession, roles: dict[str, str]) -> DataFrame:
    """locator, role, sha256, byte_length of every file below the folder of each role, in order of locator."""
    out = None
    for role, folder in roles.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        one = files.select(F.col("path").alias("locator"), F.lit(role).alias("role"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("locator")
