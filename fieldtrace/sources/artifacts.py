"""Content-addressed artifacts, manifests, and file sources and sinks.

All of it goes through the Hadoop file system, so a folder may be local, HDFS
or an object store that has rename or put-if-absent.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrace.errors import FieldtraceError
from fieldtrace.functions import canon
from fieldtrace.runtime import cut, shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/fieldtrace/{uuid.uuid4().hex}"


def put(bodies: DataFrame, store: str) -> DataFrame:
    """(key, stored) of bodies (body string or binary): one file set, keyed by digest.

    Bodies already in the store are not written again; equal bodies in one
    call are written once. ``stored`` tells whether this call wrote the key.
    Null bodies are left out.
    """
    spark = bodies.sparkSession
    raw = F.col("body") if dict(bodies.dtypes)["body"] == "binary" else F.encode("body", "utf-8")
    new = bodies.filter("body is not null").select(F.sha2(raw, 256).alias("key"), raw.alias("body")).dropDuplicates(["key"])
    if exists(spark, store):
        new = new.join(spark.read.parquet(store).select("key"), "key", "left_anti")
    written = cut(new)
    written.write.mode("append").parquet(store)
    return written.select("key", F.lit(True).alias("stored"))


def verify(spark: SparkSession, store: str) -> DataFrame:
    """(key, problem) of stored artifacts whose bytes don't have their key."""
    bad = F.when(~F.col("key").rlike("^[0-9a-f]{64}$"), "INVALID_KEY").when(F.sha2("body", 256) != F.col("key"), "ARTIFACT_CORRUPT")
    return spark.read.parquet(store).withColumn("problem", bad).filter("problem is not null").select("key", "problem")


def get(spark: SparkSession, store: str, key: str) -> bytes:
    """Verified bytes of one artifact."""
    if not isinstance(key, str) or len(key) != 64 or set(key) - set("0123456789abcdef"):
        raise FieldtraceError("REPLAY_UNAVAILABLE", "no artifact key")
    row = spark.read.parquet(store).filter(F.col("key") == key).select("body").first()
    if row is None:
        raise FieldtraceError("REPLAY_UNAVAILABLE", key)
    body = bytes(row["body"])
    if hashlib.sha256(body).hexdigest() != key:
        raise FieldtraceError("ARTIFACT_CORRUPT", key)
    return body


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def publish(spark: SparkSession, folder: str, expected_version: int, manifest: dict) -> int:
    """Commit version expected+1 of a dataset head: create its file, never overwrite.

    The manifest is written aside and renamed without overwriting, so a head is
    never seen empty. A second writer with the same expectation gets
    PUBLICATION_CONFLICT; any other failure is raised as it is.
    """
    if expected_version and not exists(spark, f"{folder}/v{expected_version}.json"):
        raise FieldtraceError("STALE_VERSION", str(expected_version))
    target = f"{folder}/v{expected_version + 1}.json"
    fs, aside = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(json.dumps(manifest, sort_keys=True).encode())
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = fs.makeQualified(hadoop.Path(target))
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    plain[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), where, plain)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
            raise FieldtraceError("PUBLICATION_CONFLICT", str(expected_version + 1)) from e
        raise
    return expected_version + 1


def head(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The last published version and its manifest."""
    if not exists(spark, folder):
        return None
    rows = spark.read.text(f"{folder}/v*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"v(\d+)\.json$", 1).cast("int").alias("v"), "value").orderBy(F.desc("v")).limit(1).collect()
    return (rows[0]["v"], json.loads(rows[0]["value"])) if rows else None


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, all strings; a byte order mark before the first name is dropped."""
    df = spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_pinned(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """A CSV file whose bytes must have a known digest."""
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).collect()
    if [r["d"] for r in row] != [digest]:
        raise FieldtraceError("SNAPSHOT_CORRUPT", path)
    return read_csv(spark, path)


def sitemap_urls(xml: Column) -> Column:
    """All page locations of a sitemap document, in order."""
    return F.xpath(xml, F.lit("//loc/text()"))


def mime_allowed(mode: Column, content_type: Column) -> Column:
    """Whether a response's type suits the mode; parameters after ';' aside."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.coalesce(F.when(mode.isin("html", "browser"), kind.isin("text/html", "application/xhtml+xml")).when(mode == "json", kind.isin("application/json", "text/json")), F.lit(False))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_union_csv(parts: list[DataFrame], path: str) -> None:
    """Rows with different columns in one CSV with the union of columns."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    whole.write.option("escape", '"').csv(path, header=True)


def write_schema(path: str, schema: dict, check: bool = False) -> bool:
    """Writes a schema as canonical JSON; with ``check`` only tells whether the file has it."""
    wanted = canon.canonical(schema) + "\n"
    if check:
        try:
            with open(path, encoding="utf-8") as f:
                return f.read() == wanted
        except FileNotFoundError:
            return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(wanted)
    return True
