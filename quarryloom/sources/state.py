"""State tables as Parquet snapshots: the latest row of each key, touched and pruned by rewriting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()
#: Explicit schemas of the state tables; nothing is inferred.
SCHEMAS = {
    "pages": T.StructType([
        T.StructField("url", _S, False), T.StructField("etag", _S), T.StructField("last_modified", _S), T.StructField("content_hash", _S), T.StructField("markdown", _S),
        T.StructField("metadata", T.StructType([
            T.StructField("title", _S), T.StructField("final_url", _S), T.StructField("tier", _S), T.StructField("low_quality", T.BooleanType()), T.StructField("quality_reason", _S),
            T.StructField("pruned_blocks", T.IntegerType()), T.StructField("adapter", _S), T.StructField("extraction", _S), T.StructField("hints", T.ArrayType(_S)), T.StructField("pdf_pages", T.IntegerType()),
        ])), T.StructField("fetched_at", _L, False)]),
    "domain_pages": T.StructType([T.StructField("domain", _S, False), T.StructField("url", _S, False), T.StructField("fetched_at", _L, False), T.StructField("block_hashes", T.ArrayType(_S))]),
    "host_requests": T.StructType([T.StructField("host", _S, False), T.StructField("last_request_at", _L, False)]),
    "robots": T.StructType([T.StructField("origin", _S, False), T.StructField("body", _S), T.StructField("fetched_at", _L, False)]),
}
#: Tables that expire; robots bodies are looked up by age but never pruned.
EXPIRING = {"pages": "fetched_at", "domain_pages": "fetched_at", "host_requests": "last_request_at"}


def upsert(state: DataFrame, new: DataFrame, keys: list[str], time: str, *ties: str) -> DataFrame:
    """The latest row of each key of both; of rows of one time the one with the greatest ties."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(time), *[F.desc(t) for t in ties])
    return state.unionByName(new).withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def touch(state: DataFrame, touched: DataFrame, keys: list[str], time: str = "fetched_at") -> DataFrame:
    """state with a new time where touched has the key; all else stays."""
    marks = touched.groupBy(*keys).agg(F.max(time).alias("_at"))
    return state.join(marks, keys, "left").withColumn(time, F.coalesce("_at", time)).select(*state.columns)


def raise_to(state: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greatest value of each key: a time that never goes back."""
    return state.unionByName(new).groupBy(*keys).agg(F.max(value).alias(value))


def prune(state: DataFrame, time: str, now: int, ttl: int) -> DataFrame:
    return state.filter(F.col(time) >= now - ttl)


def prune_due(last_pruned: Column, now: Column, ttl: int) -> Column:
    """Whether a state table is to be pruned: not again until a whole ttl has passed."""
    return F.coalesce(now - last_pruned >= ttl, F.lit(True))


def drop_stale_hosts(hosts: DataFrame, now: int, ttl: int) -> DataFrame:
    """hosts (last_request_at, waiting: requests that still stand in its queue) without those that nobody asked
    for within ttl; a host that is waited for stays, or its queue would begin anew."""
    return hosts.filter((F.col("last_request_at") >= now - ttl) | F.coalesce(F.col("waiting"), F.lit(False)))


def with_defaults(pages: DataFrame) -> DataFrame:
    """pages as a cached page is shown: null metadata replaced by defaults."""
    m = F.col("metadata")
    default = lambda name, value: F.coalesce(m[name], value).alias(name)
    return pages.select(
        "url", "markdown", "fetched_at", m["title"].alias("title"), default("final_url", F.col("url")), default("tier", F.lit("http")), default("low_quality", F.lit(False)),
        m["quality_reason"].alias("quality_reason"), default("pruned_blocks", F.lit(0)), m["adapter"].alias("adapter"), default("extraction", F.lit("readability")), default("hints", F.array().cast("array<string>")),
    )


class Snapshots:
    """A table kept as versions: each write is a new folder, then one pointer file names it. A reader sees
    a whole version, old or new; a failed write leaves the old one."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        found = self._fs.globStatus(self._Path(f"{self.path}/_at-*")) or []
        return sorted(f.getPath().getName() for f in found)

    def read(self) -> DataFrame:
        names = self._pointers()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{names[-1].split('-', 2)[2]}")

    def write(self, df: DataFrame) -> None:
        old = self._pointers()
        version = int(old[-1].split("-", 2)[1]) + 1 if old else 0
        name = f"v{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        self._fs.create(self._Path(f"{self.path}/_at-{version:012d}-{name}"), False).close()
        for gone in old[:-1]:  # the version before stays, for readers that began with it
            self._fs.delete(self._Path(f"{self.path}/{gone}"), False)
            self._fs.delete(self._Path(f"{self.path}/{gone.split('-', 2)[2]}"), True)


def lookup(requests: DataFrame, state: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    """requests with the state of their key, null where there is none."""
    return requests.join(state.select(*keys, *columns) if columns else state, keys, "left")
