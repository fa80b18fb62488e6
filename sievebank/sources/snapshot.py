"""Tables on disk: raw pages, manifests, JSON inputs, snapshots of the question bank."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.titles import strict

OFFICIAL = "array<struct<id:bigint,title:string,answer:string>>"
JSONL_POSTS = "id long, uuid string, title string, content string, createdAt long, date string, interviewExp string"
MANIFEST = "hash string, url string, status int, bytes int, fetchedAt long"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="sievebank-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def jsonl_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts in JSON lines; broken lines and rows without uuid or time are passed over.

    Company, job and round come from titles of the exact form alone.
    """
    rows = spark.read.schema(JSONL_POSTS).option("mode", "DROPMALFORMED").json(path)
    company, job, round_ = strict(F.coalesce("title", F.lit("")))
    rows = rows.filter("uuid IS NOT NULL AND uuid <> '' AND createdAt IS NOT NULL AND createdAt <> 0")
    return rows.withColumns({"source": F.lit("user"), "company": company, "job": job, "round": round_})


def sitemap(spark: SparkSession, paths: list[str], site: str) -> DataFrame:
    """Distinct addresses of content pages of a site, without their queries, in order."""
    pattern = re.escape(site) + r"/(?:feed/main/detail/[0-9a-f]+|discuss/[0-9]+)"
    urls = spark.read.text(paths).select(F.explode(F.regexp_extract_all("value", F.lit(f"({pattern})"))).alias("url"))
    return urls.distinct().orderBy("url")


def page_key(url: Column) -> Column:
    return F.substring(F.sha1(F.encode(url, "UTF-8")), 1, 20)


def shard_of(url: Column, n: int) -> Column:
    """The shard of an address: the first 64 bits of its SHA-1, modulo ``n``."""
    if n <= 1:
        return F.lit(0)
    return F.pmod(F.conv(F.substring(F.sha1(F.encode(url, "UTF-8")), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).filter("url IS NOT NULL").orderBy("url")


def queue(urls: DataFrame, fetched: DataFrame, shard: int = 0, shards: int = 1, limit: int | None = None, seed: int | None = None, kind: str = "") -> DataFrame:
    """Addresses of a shard (and of a kind, ``feed`` or ``discuss``) that have not been fetched, shuffled if there is a seed."""
    if kind:
        urls = urls.filter(F.contains("url", F.lit(f"/{kind}/")))
    out = urls.filter(shard_of(F.col("url"), shards) == shard).join(fetched.select("url"), "url", "left_anti")
    out = out.orderBy(F.xxhash64(F.lit(seed), "url"), "url") if seed is not None else out.orderBy("url")
    return out if limit is None else out.limit(limit)


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> str:
    """Write all tables below a new version and return its path; readers go on with the old one until told."""
    version = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    return version


def publish(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Write all tables as a new version, and only then make it the current one; returns the tables as written."""
    spark = next(iter(tables.values())).sparkSession
    version = write_snapshot(tables, folder)
    row = spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/current")
    return read_snapshot(spark, version, *tables)


def current(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The tables of the version that was published last."""
    row = spark.read.parquet(f"{folder.rstrip('/')}/current").orderBy(F.desc("at"), "version").first()
    return read_snapshot(spark, row["version"], *names)


def gzip_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pages: ``key``, the first 20 hexadecimal digits of the address's SHA-1, and the page behind gzip."""
    from gzip import decompress

    @F.pandas_udf("string")
    def plain(data: pd.Series) -> pd.Series:
        return data.map(lambda x: decompress(bytes(x)).decode("utf-8", "replace"))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1).alias("key"), plain("content").alias("html"))


def read_snapshot(spark: SparkSession, version: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{version}/{n}") for n in names}


def write_batches(rows: DataFrame, folder: str) -> None:
    """A JSON file folder for each ``batch``."""
    rows.repartition("batch").write.mode("append").partitionBy("batch").json(folder)


def next_batch(spark: SparkSession, *folders: str) -> int:
    """The number behind the largest ``batch`` in any of the folders; 0 where there is none."""
    found = -1
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            most = files.agg(F.max(F.regexp_extract("path", r"batch[=-](\d+)", 1).try_cast("int")).alias("n")).first()["n"]
            found = max(found, -1 if most is None else most)
    return found + 1


def official_list(text: Column) -> Column:
    """The official questions of a post; none for text that is no such list."""
    return F.coalesce(F.from_json(text, OFFICIAL), F.array().cast(OFFICIAL))


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
