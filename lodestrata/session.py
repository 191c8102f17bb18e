"""Session, input tables and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as surrounding white space of an id.
BLANKS = " \t\n\r\x0b\x0c "


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors' Python workers, once per context; they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrata_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="lodestrata-"))  # the driver's own; executors fetch the file from the driver
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "lodestrata.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(folder / "lodestrata.zip"))
    sc._lodestrata_shipped = True


def load(spark: SparkSession, directory: str, table: str, paths: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One input table; columns are pruned and filters pushed down by whoever uses it.

    paths: the nested fields to read (through lists, with dots), for uses that Catalyst cannot see into; the file's other fields are not read.
    """
    path = f"{directory}/{table}.parquet"
    df = spark.read.parquet(path)
    return spark.read.schema(pruned(df.schema, [p.split(".") for p in paths])).parquet(path) if paths else df


def pruned(kind: T.DataType, paths: list[list[str]]) -> T.DataType:
    """A type with only the fields that the paths name."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(pruned(kind.elementType, paths), kind.containsNull)
    if not isinstance(kind, T.StructType) or any(not p for p in paths):
        return kind
    below = {f.name: [p[1:] for p in paths if p[0] == f.name] for f in kind}
    return T.StructType([T.StructField(f.name, pruned(f.dataType, below[f.name]), f.nullable) for f in kind if below[f.name]])


#: A shuffled input of up to so many bytes a core is spread again, as Spark may have coalesced it.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it would make fewer tasks than there are: files of too few splits (a small file is one task), or a small
    shuffled input. Large inputs stay as they are, unshuffled. For work in Python on texts, which costs far more than moving them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(node in plan.toString() for node in ("Aggregate", "Join", "Window", "Sort", "Repartition", "Distinct", "Limit")):
        few = int(plan.stats().sizeInBytes()) <= SMALL * cores  # counting its partitions would run it
    else:
        few = df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if few else df


def norm_id(column: Column | str) -> Column:
    """An id as it is compared: without surrounding white space, in lower case, null if nothing is left."""
    c = F.lower(F.trim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS)))
    return F.when(c != "", c)


_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local master, where one machine is the whole cluster, may fall back to a temporary folder.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="lodestrata-"))
        atexit.register(_LOCAL[0].cleanup)
    return f"file://{_LOCAL[0].name}"


#: Folders of intermediate tables of this process, for clean().
_WRITTEN: list[str] = []


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        _WRITTEN.append(self.root)

    def _path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n:05d}"

    def table(self, df: DataFrame) -> DataFrame:
        """df, written once and read back with its schema (no inference job)."""
        path = self._path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def split(self, df: DataFrame, flag: str) -> tuple[DataFrame, int, DataFrame, int]:
        """df written once, parted by the boolean column `flag`: rows where it holds, their number, the others, their number."""
        from pyspark.sql import Observation

        path, seen = self._path(), Observation()
        df.observe(seen, F.count_if(F.col(flag)).alias("yes"), F.count_if(~F.col(flag)).alias("no")).write.partitionBy(flag).parquet(path)
        schema = df.drop(flag).schema

        def part(n: int, value: str) -> DataFrame:
            return self.spark.read.schema(schema).parquet(f"{path}/{flag}={value}") if n else self.spark.createDataFrame([], schema)

        yes, no = seen.get["yes"], seen.get["no"]
        return part(yes, "true"), yes, part(no, "false"), no


#: Stored tables that later queries of this process may use again, by application, directory and name.
_KEPT: dict[tuple[str, str, str], object] = {}


def kept(spark: SparkSession, d: str, name: str, make):
    """What make(path) stored under a path of the shared folder, made once per directory and process."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _KEPT:
        _KEPT[key] = make(Scratch(spark, name).root)
    return _KEPT[key]


def clean(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this process; results that read them must have been written before."""
    _KEPT.clear()
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
