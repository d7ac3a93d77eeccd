"""Keyed tables in hash buckets, upserted in part.

A table is a folder of parquet files, each of one bucket of its key, and a manifest per version that names the files of
every bucket, the table's schema and, for each stream that writes it, the last batch that is in.  An upsert reads and rewrites
the buckets that its source touches and no other; the new manifest is written beside and renamed to the next version's name, which fails if
another writer has taken it.  Readers see the newest manifest, so half-written data is never read.  The rename is one
step on HDFS-like stores; a store without it needs a conditional put in ``_rename``.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import dedupe_source, upsert
from ..session import compiled_methods
from .sinks import _hadoop_fs

BUCKETS = 64


class VersionTaken(RuntimeError):
    """Another writer has committed first; nothing of this write is visible."""


def _versions(spark: SparkSession, base: str) -> list[int]:
    fs, p = _hadoop_fs(spark, f"{base}/_manifests")
    if not fs.exists(p):
        return []
    names = (st.getPath().getName() for st in fs.listStatus(p))
    return sorted(int(m.group(1)) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m)


def manifest(spark: SparkSession, base: str) -> dict | None:
    """The newest version's manifest; ``None`` before the first commit."""
    found = _versions(spark, base.rstrip("/"))
    if not found:
        return None
    text = spark.read.option("wholetext", True).text(f"{base.rstrip('/')}/_manifests/{found[-1]}.json").first()[0]
    return json.loads(text)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename without overwriting."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, s = _hadoop_fs(spark, source)
    t = jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(s, t, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))


def _commit(spark: SparkSession, base: str, content: dict) -> None:
    fs, draft = _hadoop_fs(spark, f"{base}/_manifests/.{uuid.uuid4()}")
    out = fs.create(draft, False)
    out.write(json.dumps(content).encode())
    out.close()
    target = f"{base}/_manifests/{content['version']}.json"
    try:
        _rename(spark, draft.toString(), target)
    except Exception as ex:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(ex) or "already exist" in str(ex):
            raise VersionTaken(f"version {content['version']} of {base} is taken") from None
        raise


def read_buckets(spark: SparkSession, base: str) -> DataFrame:
    """The table as of its newest version."""
    base = base.rstrip("/")
    found = manifest(spark, base)
    if found is None:
        raise FileNotFoundError(f"no committed version under {base}")
    return _read(spark, base, found, found["files"])


def _read(spark: SparkSession, base: str, found: dict, buckets) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    files = [f"{base}/{f}" for b in buckets for f in found["files"].get(b, [])]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def upsert_buckets(spark: SparkSession, base: str, src: DataFrame, keys: list[str], order: str | list[str],
                   buckets: int = BUCKETS, batch: tuple[str, int] | None = None, update_cols: list[str] | None = None,
                   add_cols: list[str] = ()) -> dict:
    """Upsert ``src`` (of several rows of a key the last by ``order`` counts; matched rows take its ``update_cols``, all
    columns without, and sum ``add_cols``) and commit the next version; the manifest.

    ``batch``: stream and number of a micro-batch; one that the table holds already is skipped, so a replay after a
    crash between this commit and the stream's own changes nothing."""
    base = base.rstrip("/")
    old = manifest(spark, base)
    if old and batch and old["batches"].get(batch[0], -1) >= batch[1]:
        return old
    buckets = old["buckets"] if old else buckets
    with compiled_methods(spark):
        return _upserted(spark, base, old, src, keys, order, buckets, batch, update_cols, add_cols)


def _upserted(spark: SparkSession, base: str, old: dict | None, src: DataFrame, keys: list[str], order: str | list[str], buckets: int,
              batch: tuple[str, int] | None, update_cols: list[str] | None, add_cols: list[str]) -> dict:
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = dedupe_source(src, keys, order).withColumn("_bucket", place).persist()
    try:
        touched = sorted(str(r[0]) for r in rows.select("_bucket").distinct().collect())  # ``buckets`` numbers at most
        if not touched and old and not batch:
            return old
        rows_in = rows.drop("_bucket")
        now = _read(spark, base, old, touched) if old else None
        if now is not None:
            rows_in = rows_in.select(*[c for c in now.columns if c in rows_in.columns], *[c for c in rows_in.columns if c not in now.columns])
        made = upsert(now, rows_in, keys, update_cols or [c for c in rows_in.columns if c not in keys], order, add_cols=add_cols)
        folder = f"data/{uuid.uuid4()}"
        if touched:
            (made.withColumn("_bucket", place).repartition(len(touched), "_bucket")
             .write.partitionBy("_bucket").parquet(f"{base}/{folder}"))
        files = {b: f for b, f in (old["files"] if old else {}).items() if b not in touched}
        fs, p = _hadoop_fs(spark, base)
        for b in touched:
            at = f"{folder}/_bucket={b}"
            files[b] = sorted(f"{at}/{st.getPath().getName()}" for st in fs.listStatus(p.suffix(f"/{at}")) if st.getPath().getName().endswith(".parquet"))
        new = {"version": (old["version"] if old else 0) + 1, "keys": keys, "buckets": buckets, "files": files,
               "schema": json.loads(made.schema.json()), "batches": {**(old["batches"] if old else {}), **(dict([batch]) if batch else {})}}
        _commit(spark, base, new)
        return new
    finally:
        rows.unpersist()
