"""What the corpus operators share: table access and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
_scopes: list[Scope] = []


class Scope:
    """Collects the tables that are written while it is entered, for remove()."""

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []
        self.entered = 0.0

    def __enter__(self) -> Scope:
        self.entered = time.time()
        _scopes.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self)

    def done_with(self, df: DataFrame) -> bool:
        """Whether df reads files written since the scope was last entered, and none of its tables: then what
        was made of the tables has been written, and df reads that."""
        files = df.inputFiles()
        mine = [path.split("/")[-1] for _, path in self.tables]
        if not files or any(name in f for f in files for name in mine):
            return False
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0]))
        return path.getFileSystem(conf).getFileStatus(path).getModificationTime() >= self.entered * 1000

    def remove(self) -> None:
        """Only once what was made of the tables is written elsewhere."""
        _remove(self.tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's setting.

    A temporary folder stands in only where the setting is unset and the master is this machine.
    """
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="quarryloom-")
    return _fallback[app]


#: Rows of a file, where their number is known to be small.
ROWS_A_FILE = 50_000


def written(df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, kept when an executor is lost.

    rows: about how many there are, where that is known: few rows make few files; options: of the writer.
    The table is removed when the driver's process ends.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(lambda: _remove(_written))
    _written.append((spark, path))
    for scope in _scopes[-1:]:
        scope.tables.append((spark, path))
    # what is shuffled for a table that is written is of no more use: its files go when the write ends
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        if (spark, path) in _written:
            _written.remove((spark, path))
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone already; its folder is the cluster's to clean
            return


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name
