"""Stores whose readers always see a whole version, and streams that give each record once.

A versioned store is a folder of versions and a file, `current`, that names the one to read.  A new version is written
beside the others and becomes current by one rename, so readers have the old one or the new one.  The rename replaces
atomically on file systems that have it (HDFS, local); on object stores it is as atomic as their rename.

An ingested store is a folder of batches and a ledger with a file for each batch that is complete.  A batch that is
replayed after a failure has the same number, so it overwrites what it left behind, and readers take only what the
ledger names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _files(spark: SparkSession, path: str):
    """The path in Hadoop's terms and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _exists(spark: SparkSession, path: str) -> bool:
    at, files = _files(spark, path)
    return files.exists(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    at, files = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there at once and whole, in the place of one of that name."""
    beside = f"{path}.{uuid.uuid4().hex}"
    at, files = _files(spark, beside)
    out = files.create(at)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    replace = spark.sparkContext._gateway.new_array(kinds, 1)
    replace[0] = kinds.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    context.rename(at.makeQualified(files.getUri(), files.getWorkingDirectory()), _files(spark, path)[0].makeQualified(files.getUri(), files.getWorkingDirectory()), replace)


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the version to read; None where nothing is published."""
    return spark.read.text(f"{path}/current").first()[0] if _exists(spark, f"{path}/current") else None


def publish(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """Write df as a new version and make it current; a job that fails leaves the old one as it is.  Returns its name."""
    names = [n for n in _names(df.sparkSession, f"{path}/versions") if n[:12].isdigit()]
    name = f"{int(names[-1][:12]) + 1 if names else 0:012d}-{uuid.uuid4().hex[:8]}"
    df.write.format(kind).save(f"{path}/versions/{name}")
    switch(df.sparkSession, path, name)
    return name


def switch(spark: SparkSession, path: str, name: str) -> None:
    """Make a version current that is there, an older one too."""
    if not _exists(spark, f"{path}/versions/{name}/_SUCCESS"):
        raise ValueError(f"no whole version {name}")
    _put(spark, f"{path}/current", name)


def read_current(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    name = current(spark, path)
    if name is None:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.format(kind).load(f"{path}/versions/{name}")


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all versions but the last `keep` and the current one; returns those that went."""
    names = _names(spark, f"{path}/versions")
    gone = [n for n in names[: max(0, len(names) - keep)] if n != current(spark, path)]
    for name in gone:
        at, files = _files(spark, f"{path}/versions/{name}")
        files.delete(at, True)
    return gone


def rebuild_vectors(df: DataFrame, path: str, key: str = "chunk_id", keep: int = 1) -> str:
    """Drop and rebuild a vector store: one row of each key; searches under way end on the old version."""
    name = publish(df.dropDuplicates([key]), path)
    expire(df.sparkSession, path, keep)
    return name


def extend_vectors(df: DataFrame, path: str, key: str = "chunk_id") -> str:
    """A new version with the rows that the store does not have yet."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    if current(spark, path) is None:
        return publish(fresh, path)
    old = read_current(spark, path)
    return publish(old.unionByName(fresh.join(old.select(key), key, "left_anti")), path)


def ingested(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The records of all complete batches (below a number); None if there are none."""
    done = [n for n in _names(spark, f"{path}/ledger") if n.isdigit() and (before is None or int(n) < before)]
    return spark.read.parquet(*[f"{path}/batches/{n}" for n in done]) if done else None


def _commit(spark: SparkSession, path: str, batch: int) -> None:
    _put(spark, f"{path}/ledger/{batch:012d}", "done")


def ingest(stream: DataFrame, path: str, key: str, time: str, late: str = "1 day", **trigger) -> StreamingQuery:
    """Start to take a stream into a store, each key once, whatever stops and starts again in between.

    Repeats within `late` of each other fall away in the stream's state, older ones by what the store has.  The
    checkpoint lies beside the store, and a batch counts when the ledger has it.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        held = ingested(spark, path, number)
        fresh = batch if held is None else batch.join(held.select(key).distinct(), key, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/batches/{number:012d}")
        _commit(spark, path, number)

    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger or {"availableNow": True}).start()
