"""Shared pieces of the training-data operators: column picking, durable tables, word scanning over Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Odd multipliers of the 64-bit mixers.
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True
#: Spark's regular expression for a word: any run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words above this many bytes are hashed one at a time.
_LONG_WORD = 256


def pick(df: DataFrame, **named: str | None) -> DataFrame:
    """Select columns by exact name and position, so columns that clash in case or with ours do no harm.

    named maps new names to input names; a missing input column is null.
    """
    own = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return plain.select(*[(F.col(f"_in{own[c]}") if c in own else F.lit(None)).alias(new) for new, c in named.items()])


def shared_dir(spark) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or a temporary one where a local session has none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark, kind: str) -> str:
    """A new folder within the shared one, which goes with its files when the driver ends."""
    at = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{at}/files"


def durable(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    at = shared_path(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def parts_for(df: DataFrame, size: Column, target: int) -> int:
    """Partitions so that each gets about `target` bytes of `size`, at least the session's shuffle partitions."""
    total = df.agg(F.sum(size.cast("double"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // target) + 1)


def ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df as a written table in ranges of `order`, with _at: ascending in that order, the range in the bits above 33.

    Rows that repeat in all of `order` are split like others, so no range is larger for them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_tie")]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return durable(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    right = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
    return left.join(right, on, how).drop(*[f"_r{i}" for i in range(len(keys))])


def numbered(df: DataFrame, group: list[str], order: list[str], base: DataFrame | None = None) -> DataFrame:
    """df with pos, the place of each row in its group from 0, and size, the rows of the group.

    Rows are ranged by group and order, so a group is dealt to as many tasks as its rows need.  A row's place is its
    place in its range plus what the group has in earlier ranges; those counts are one row for each group and range.
    base: a first place (column `first`) for each group.
    """
    rows = ranges(df, *group, *order).withColumn("_range", F.shiftright("_at", 33))
    runs = rows.groupBy(*group, "_range").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    runs = runs.withColumn("size", F.sum("_n").over(whole)).withColumn("_before", F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = same(runs, base, group) if base is not None else runs.withColumn("first", F.lit(0).cast("long"))
    runs = durable(runs.select(*group, "_range", "size", (F.col("first") + F.col("_before") - F.col("_from")).alias("_shift")))
    return same(rows, runs, [*group, "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and for each row the range of its words."""
    inside = ~_GAP[data]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[first] = inside[first]
    start = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    edge[last] = inside[last]
    return start, np.flatnonzero(edge) + 1, np.searchsorted(start, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a step; equal words have equal hashes on every machine."""
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    low = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    left = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    at = 0
    while len(left):
        rest = size[left] - at
        out[left] = mix(out[left] ^ (eight[start[left] + at] & low[np.minimum(rest, 8)]))
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), 7)
    return out


def chunks(batches, target: int = 24 << 20, text: str = "text"):
    """Join Arrow batches into tables of about `target` bytes of text, so that per-chunk work pays off and memory stays bounded.

    A batch above that is cut between rows; a row is never cut.
    """
    held, size = [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, done = 0, 0
        while begin < batch.num_rows:
            stop = max(int(np.searchsorted(sizes, done + target - size, "right")), begin + 1)
            stop = min(stop, batch.num_rows)
            held.append(batch.slice(begin, stop - begin))
            size += int(sizes[stop - 1]) - done
            begin, done = stop, int(sizes[stop - 1])
            if size >= target or begin < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def ragged(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenate values[first[i] : first[i] + count[i]] for all i."""
    total = int(count.sum())
    begin = np.cumsum(count) - count
    return values[np.repeat(first - begin, count) + np.arange(total)]
