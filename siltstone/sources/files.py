"""Readers and sinks: explicit schemas, latest-wins manifests, resumable appends, replaceable outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.numbers import year_of_parts
from siltstone.functions.text import clean_html, joined

#: The evidence table, one row for each paired observation.
EVIDENCE_SCHEMA = (
    "source string, Study_No_ string, latitude double, longitude double, CSA_practices string, practice_family string, Crop_group string, "
    "crop_type string, Rainfall double, Altitude_r double, slope double, temp_mean_annual double, precip_seasonality double, lgp_days double, "
    "soil_clay double, soil_ph double, soil_soc double, land_cover int, aez_belt string, Indicator string, response_ratio double, log_response_ratio double"
)
MANIFEST_SCHEMA = "era_code string, doi string, title string, year string, journal string, pdf string, xml string, abstract string"
CHUNK_SCHEMA = "chunk_id string, era_code string, doi string, title string, year string, journal string, source string, text string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header line, typed by schema; malformed cells are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with every value as a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped and absent keys are null."""
    return spark.read.schema(schema).json(path)


def sniffed(column: Column) -> Column:
    """A number where the cell reads as one, else null, for lookup tables of mixed cells."""
    return column.try_cast("double")


def lookup(df: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """A two-column lookup: the last row of each key wins, in the order of a column or else of the file.

    Rows of one file are read in place order, and the place of a row is taken before anything is shuffled.
    """
    placed = df.withColumn("_place", F.col(order) if order else F.monotonically_increasing_id())
    return placed.groupBy(F.col(key).cast("int").alias("code")).agg(F.max_by(value, "_place").alias("name"))


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """JSON lines as they arrive in a folder, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def stored_ids(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """The ids of a vector store: one column of its parquet files."""
    return spark.read.parquet(path).select(key)


def add_vectors(df: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Append the rows that a vector store does not have yet; a store that is not there is begun."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
    (new_rows(df, stored_ids(spark, path, key), key) if there else df).write.mode("append").parquet(path)


#: What the registries of papers answer, as far as it is used.
WORK_SCHEMA = (
    "DOI string, title array<string>, `container-title` array<string>, `published-print` struct<`date-parts`:array<array<int>>>, "
    "`published-online` struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string>>, "
    "abstract string"
)


def shape_works(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, doi, title, journal, year, authors, abstract of JSON answers; what is malformed or absent is null."""
    w = F.from_json(column, WORK_SCHEMA)
    dates = F.array(*[w[d]["date-parts"] for d in ("published-print", "published-online", "issued")])
    names = F.transform(w["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    return df.select(
        key, F.lower(w["DOI"]).alias("doi"), F.get(w["title"], F.lit(0)).alias("title"), F.get(w["container-title"], F.lit(0)).alias("journal"),
        year_of_parts(dates).alias("year"), joined(names).alias("authors"), clean_html(w["abstract"]).alias("abstract"),
    )


def readable(files: DataFrame, magic: bytes, again: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of binary files (path, content): a bad one is looked for once in a second delivery before it counts."""
    good = valid_content(files, magic)
    bad = files.join(good.select("path"), "path", "left_anti").select("path")
    if again is None:
        return good, bad
    second = valid_content(again.join(bad, "path", "left_semi"), magic)
    return good.unionByName(second), bad.join(second.select("path"), "path", "left_anti")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def new_rows(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def append_json(df: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines; a failed job adds nothing."""
    df.write.mode("append").json(path)


def replace_json(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones and return its place; readers of the old one are not disturbed."""
    at = f"{path}/version-{uuid.uuid4().hex}"
    df.write.json(at)
    return at


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV folder with a fixed order of fields."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_tiles(df: DataFrame, path: str, size: int = 256) -> None:
    """A raster (row, col, bands) partitioned by tiles, so that a window read opens its tiles only."""
    tiled = df.withColumn("tile_row", F.floor(F.col("row") / size)).withColumn("tile_col", F.floor(F.col("col") / size))
    tiled.repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], size: int = 256) -> DataFrame:
    """Cells of a tiled raster within inclusive bounds."""
    df = spark.read.parquet(path)
    tiles = F.col("tile_row").between(rows[0] // size, rows[1] // size) & F.col("tile_col").between(cols[0] // size, cols[1] // size)
    return df.filter(tiles & F.col("row").between(*rows) & F.col("col").between(*cols)).drop("tile_row", "tile_col")


def valid_content(files: DataFrame, magic: bytes) -> DataFrame:
    """Binary files that begin as they should."""
    return files.filter(F.substring("content", 1, len(magic)) == F.lit(magic))


def inspect(df: DataFrame, n: int, width: int = 160) -> DataFrame:
    """The first n records with strings cut to width, for a look at an unknown source."""
    return df.limit(n).select(*[F.substring(c, 1, width).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def first_filled(df: DataFrame, candidates: list[str]) -> Column:
    """The first of the candidate columns, by name in any case, that is there and not blank."""
    own = {c.lower(): c for c in df.columns}
    there = [F.expr(f"nullif(trim(cast(`{own[c.lower()]}` as string)), '')") for c in candidates if c.lower() in own]
    return F.coalesce(*there) if there else F.lit(None).cast("string")
