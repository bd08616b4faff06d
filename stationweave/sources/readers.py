"""Readers for measurement extracts, station masters, vocabularies and zones."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stationweave.functions import geometry
from stationweave.functions.columns import vocabulary_code, vocabulary_unit
from stationweave.model import LONG_SCHEMA, Measurements, infer_pollutants

# Header of the public hourly extracts -> column of the long contract.
EXTRACT_COLUMNS = {
    "AirQualityStationEoICode": "station",
    "AirPollutant": "pollutant",
    "Concentration": "concentration",
    "AveragingTime": "averaging_time",
    "DatetimeBegin": "begin_ts",
    "DatetimeEnd": "end_ts",
}


def scan_measurements(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Long measurements from many CSV extracts or Parquet folders; files may lack optional columns.

    CSV files with the same header form one scan, however many they are; one job finds the headers of all files. Columns
    are matched by header name, so drifted files are safe.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    if all(p.rstrip("/").endswith(".parquet") for p in listed):
        return _to_contract(spark.read.option("mergeSchema", True).parquet(*listed))
    frames = []
    for header, files in _headers(spark, listed):
        names = next(csv.reader([header.removeprefix("\ufeff")]))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        frames.append(_to_contract(spark.read.schema(schema).option("header", True).csv(files)))
    return union_by_name(frames)


def _headers(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Distinct headers and their files. A header is the first line of its file; the list is as long as the paths' files."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = (lines.where(F.col("at") == 0).withColumn("row", F.monotonically_increasing_id())
             .groupBy("file").agg(F.min_by("value", "row").alias("header")))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(r.header, r.files) for r in found if r.header]


def _to_contract(raw: DataFrame) -> DataFrame:
    named = raw.withColumnsRenamed({k: v for k, v in EXTRACT_COLUMNS.items() if k in raw.columns})
    return named.select(*[
        (F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in LONG_SCHEMA.fields],
        *[c for c in ("sampling_point_id", "year") if c in named.columns])


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Append frames by column name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_by_sampling_point(
    measurements: DataFrame, sampling_points: DataFrame, first_year: int, last_year: int,
) -> DataFrame:
    """Rows of the requested sampling points and UTC years.

    The year range is stated on the timestamp and, when present, on the ``year`` partition column, so both partition
    pruning and row-group filters apply.
    """
    kept = filter_years(measurements, first_year, last_year)
    return kept.join(sampling_points.select("sampling_point_id").distinct(), "sampling_point_id", "left_semi")


def filter_years(df: DataFrame, first_year: int, last_year: int, ts: str = "begin_ts") -> DataFrame:
    """Rows whose UTC year lies in the range, written as a pushable timestamp range."""
    kind = df.schema[ts].dataType.typeName()
    kept = df.where((F.col(ts) >= F.lit(f"{first_year:04d}-01-01").cast(kind))
                    & (F.col(ts) < F.lit(f"{last_year + 1:04d}-01-01").cast(kind)))
    if "year" in df.columns:
        kept = kept.where(F.col("year").between(first_year, last_year))
    return kept


def scan_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station master from Parquet or CSV, blanks removed from the column names."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else (
        spark.read.option("header", True).option("inferSchema", True).csv(path))
    return normalize_columns(raw)


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "") for c in df.columns])


def scan_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Pollutant vocabulary: code, notation, label, recommended unit. Only the four used columns are read."""
    raw = normalize_columns(spark.read.option("header", True).csv(path))
    return parse_vocabulary(raw.select("URI", "Notation", "Label", "Definition"))


def parse_vocabulary(raw: DataFrame) -> DataFrame:
    return raw.select(
        vocabulary_code("URI").alias("code"), F.col("Notation").alias("notation"),
        F.col("Label").alias("label"), vocabulary_unit("Definition").alias("recommended_unit"))


def scan_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone polygons: Parquet with rings, Parquet with WKT, or GeoJSON features (one per line)."""
    if path.rstrip("/").endswith(".parquet"):
        return with_rings(spark.read.parquet(path))
    position = T.ArrayType(T.DoubleType())
    feature = T.StructType([
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ])
    raw = spark.read.schema(feature).json(path)
    polygon = T.ArrayType(T.ArrayType(position))
    coordinates = F.col("geometry.coordinates")
    parts = F.when(F.col("geometry.type") == "MultiPolygon",
                   F.flatten(F.from_json(coordinates, T.ArrayType(polygon)))
                   ).otherwise(F.from_json(coordinates, polygon))
    rings = F.transform(parts, lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    props = F.col("properties")
    level = F.coalesce(props["LEVL_CODE"].try_cast("int"), F.lit(4))
    return raw.select(
        level.alias("level"),
        F.coalesce(props["NUTS_ID"], props["LAU_ID"]).alias("zone_id"),
        F.coalesce(props["NAME_LATN"], props["LAU_NAME"]).alias("zone_name"),
        props["CNTR_CODE"].alias("country_code"), rings.alias("rings"))


def with_rings(zones: DataFrame) -> DataFrame:
    """Parse a WKT column into rings when the rings are not there yet."""
    if "rings" in zones.columns:
        return zones
    return zones.withColumn("rings", geometry.from_wkt(F.col("wkt"))).drop("wkt")


def import_csv(spark: SparkSession, path: str, zones: DataFrame | None = None) -> Measurements:
    """Wide table written by export_csv; the pollutants are the columns outside the fixed contract."""
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError("expected a .csv path")
    return _imported(spark.read.option("header", True).option("inferSchema", True).csv(path), zones)


def import_txt(spark: SparkSession, path: str, zones: DataFrame | None = None) -> Measurements:
    """Wide table written by export_txt (space separated, quoted, with header)."""
    if not path.rstrip("/").endswith(".txt"):
        raise ValueError("expected a .txt path")
    raw = (spark.read.option("header", True).option("inferSchema", True)
           .option("sep", " ").option("quote", '"').option("nullValue", "NA").csv(path))
    return _imported(raw, zones)


def _imported(df: DataFrame, zones: DataFrame | None) -> Measurements:
    pollutants = infer_pollutants(df)
    typed = df.withColumns({c: F.col(c).cast("timestamp") for c in ("begin_ts", "end_ts") if c in df.columns})
    typed = typed.withColumns({p: F.col(p).cast("double") for p in pollutants})
    return Measurements(typed, tuple(pollutants), zone_df=zones)


def import_zone_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Zone geometry written by export_zone_geometry."""
    return with_rings(spark.read.parquet(path))
