"""Station-shaped views over the driver's tables, in Spark."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from stationweave.functions import geometry
from stationweave.operators.aggregate import pivot_measurements
from stationweave.operators.panel import hourly_panel
from stationweave.session import configure, ensure_checkpoint_dir

# The event types that stand for pollutants, and three that stand for named ones.
POLLUTANTS = ["click", "error", "purchase", "signup", "view"]
TARGET, COVARIATE, SECOND_COVARIATE = "click", "view", "purchase"
# Country of a nation by its number; the last one has no code.
COUNTRIES = ["Italy", "Germany", "France", "Greece", "United Kingdom", "Atlantis"]


class Tables:
    """Views over one data folder; each property is lazy."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A fresh path in the shared checkpoint folder."""
        ensure_checkpoint_dir(self.spark)
        return f"{self.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    @property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @property
    def obs(self) -> DataFrame:
        hour = F.date_trunc("hour", "ts")
        return self.events.select(
            code("S", "user_id", 6).alias("station"), F.col("event_type").alias("pollutant"),
            (F.col("value") - 5.0).alias("concentration"), F.lit("hour").alias("averaging_time"),
            hour.alias("begin_ts"), (hour + F.expr("interval 1 hour")).alias("end_ts"))

    @property
    def wide(self) -> DataFrame:
        return pivot_measurements(self.obs, POLLUTANTS)

    @property
    def station(self) -> DataFrame:
        users = self.read("events").select(F.col("user_id").alias("c_custkey")).distinct()
        return self.read("customer").join(users, "c_custkey", "left_semi").select(
            code("S", "c_custkey", 6).alias("station"), F.col("c_name").alias("station_name"),
            *place("c_custkey"), F.col("c_nationkey").alias("nationkey"))

    @property
    def sampling_point(self) -> DataFrame:
        """One row per (station, pollutant) ever measured; one type is shifted, one has no coordinate."""
        pairs = self.events.groupBy(F.col("user_id").alias("c_custkey"), "event_type").agg(
            F.min("ts").alias("op_begin"), F.max("ts").alias("_end"))
        rows = pairs.join(self.read("customer"), "c_custkey")
        country = F.array(*[F.lit(c) for c in COUNTRIES])[F.col("c_nationkey") % len(COUNTRIES)]
        kind = F.col("event_type")
        lon, lat = place("c_custkey")
        shift = F.when(kind == "error", 0.01).otherwise(0.0)
        station = code("S", "c_custkey", 6)
        zone = zone_code(F.col("c_nationkey"))
        return rows.select(
            F.concat_ws("-", F.lit("SP"), station, kind).alias("sampling_point_id"), station.alias("station"),
            F.when(F.col("c_nationkey") % 7 != 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
            .alias("nat_code"),
            F.col("c_name").alias("station_name"), country.alias("country"), kind.alias("pollutant"),
            F.when(kind != "signup", lon + shift).alias("longitude"),
            F.when(kind != "signup", lat).alias("latitude"),
            F.col("c_acctbal").alias("altitude"), F.col("op_begin"),
            F.when(kind == "click", F.col("_end")).alias("op_end"), F.lit("utc+01").alias("timezone"),
            F.substring(zone, 1, 3).alias("nuts1_id"), zone.alias("nuts2_id"),
            F.lower("c_mktsegment").alias("type"))

    @property
    def zone(self) -> DataFrame:
        """Level-2 rectangles: one per nation."""
        n = self.read("nation")
        key = F.col("n_nationkey")
        column, row = (key % 5).cast("int"), F.floor(key / 5).cast("int")
        x0, y0 = F.lit(5.0) + 2 * column, F.lit(40.0) + 2 * row
        return n.select(
            F.lit(2).alias("level"), zone_code(key).alias("zone_id"), F.col("n_name").alias("zone_name"),
            F.lit("XX").alias("country_code"), geometry.rectangle(x0, y0, x0 + 2, y0 + 2).alias("rings"))

    @property
    def zones(self) -> DataFrame:
        """Levels 0 to 2; the coarser ones are the boxes of their members."""
        fine = self.zone

        def merged(level: int, width: int, name: Column) -> DataFrame:
            box = geometry.bounds(F.col("rings"))
            return (fine.select(F.substring("zone_id", 1, width).alias("zone_id"), box.alias("b"))
                    .groupBy("zone_id").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"),
                                            F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
                    .select(F.lit(level).alias("level"), "zone_id", name.alias("zone_name"),
                            F.lit("XX").alias("country_code"),
                            geometry.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("rings")))
        return (merged(0, 2, F.lit("Everywhere")).unionByName(merged(1, 3, F.concat(F.lit("Strip "), "zone_id")))
                .unionByName(fine))

    @property
    def district(self) -> DataFrame:
        """Level-4 rectangle around every station, often across zone borders."""
        x, y = F.col("lon"), F.col("lat")
        return self.station.select(
            F.lit(4).alias("level"), F.concat(F.lit("L"), "station").alias("zone_id"),
            F.col("station_name").alias("zone_name"), F.lit("XX").alias("country_code"),
            geometry.rectangle(x - 0.305, y - 0.205, x + 0.295, y + 0.195).alias("rings"))

    @property
    def panel_obs(self) -> DataFrame:
        events = self.events
        k = events.agg(F.greatest(F.lit(7), F.floor((F.max("user_id") + 1) / 20))).scalar()
        return (events.select(code("P", F.col("user_id") % k, 4).alias("station"),
                              F.col("event_type").alias("pollutant"), F.date_trunc("hour", "ts").alias("ts"), "value")
                .groupBy("station", "pollutant", "ts").agg(F.avg("value").alias("x")))

    @property
    def panel(self) -> DataFrame:
        return hourly_panel(self.panel_obs)

    @property
    def panel_place(self) -> DataFrame:
        """Coordinates and type of the panel stations, from their number."""
        n = F.substring("station", 2, 4).cast("int")
        return self.panel_obs.select("station").distinct().select(
            "station", (5.0 + ((n * 37) % 100) / 100.0).alias("lon"), (40.0 + ((n * 53) % 100) / 100.0).alias("lat"),
            F.when(n % 2 == 0, "traffic").otherwise("background").alias("type"))

    @property
    def vocabulary(self) -> DataFrame:
        kinds = self.read("events").select("event_type").distinct()
        return kinds.select(F.ascii("event_type").alias("code"), F.col("event_type").alias("notation"))

    @property
    def vocabulary_source(self) -> DataFrame:
        return self.read("part").select(
            F.concat(F.lit("http://vocabulary.test/pollutant/"), F.col("p_partkey").cast("string")).alias("URI"),
            F.col("p_name").alias("Notation"), F.col("p_type").alias("Label"),
            F.when(F.col("p_partkey") % 3 != 0,
                   F.concat(F.col("p_brand"), F.lit(" - recommended unit: ug"), F.col("p_size").cast("string")))
            .otherwise(F.col("p_brand")).alias("Definition"))


def code(prefix: str, number: Column | str, width: int) -> Column:
    n = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def place(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    return ((5.0 + ((k * 37) % 1000) / 100.0 + 0.005).alias("lon"),
            (40.0 + ((k * 53) % 1000) / 100.0 + 0.005).alias("lat"))


def zone_code(nation: Column) -> Column:
    return F.concat(F.lit("XX"), (nation % 5).cast("string"), F.floor(nation / 5).cast("int").cast("string"))
