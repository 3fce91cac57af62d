"""Scans with contracts: ledgers, catalogues, change tables, memories and poses, by Spark's own readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType([T.StructField("ImageID", T.StringType()), T.StructField("TimeStamp", T.LongType())])
CHANGES = T.StructType([T.StructField(c, T.LongType()) for c in ("node_id", "merged_id", "first_absent", "last_absent", "first_persistent", "last_persistent")])
MERGES = T.StructType([T.StructField("from_node", T.LongType()), T.StructField("to_node", T.LongType()), T.StructField("is_valid", T.IntegerType())])
#: The prior of an object's stationarity where its memory has none.
ALPHA, BETA = 2.0, 1.0


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file whose header must name the schema's columns in order; malformed rows are errors."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def ledger_faults(ledger: DataFrame, image: str = "ImageID", ts: str = "TimeStamp", order: str | None = None) -> DataFrame:
    """fault, n: repeated images, repeated stamps and, given the order of the ledger's lines, lines whose stamp is not after the one
    before them. Lines are compared inside ranges of the order, and each range's first with the last before it."""
    repeated = lambda c, name: ledger.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").agg(F.lit(name).alias("fault"), F.count("*").alias("n"))
    out = repeated(image, "repeated image").unionByName(repeated(ts, "repeated stamp"))
    if order is None:
        return out
    from ..plans.scratch import saved

    lines = saved(ledger.select(order, ts).repartitionByRange(order).select(order, ts, F.spark_partition_id().alias("part")), "lines")
    within = lines.withColumn("b", F.lag(ts).over(Window.partitionBy("part").orderBy(order))).where(F.col(ts) <= F.col("b"))
    ends = lines.groupBy("part").agg(F.min_by(ts, order).alias("a"), F.max_by(ts, order).alias("z"))
    between = ends.withColumn("b", F.lag("z").over(Window.orderBy("part"))).where("a <= b")  # a row a range
    n = within.select(F.lit(1).alias("x")).unionByName(between.select(F.lit(1).alias("x"))).agg(F.lit("not increasing").alias("fault"), F.count("*").alias("n"))
    return out.unionByName(n)


def catalog_faults(catalog: DataFrame, identity: str = "physical_instance_id", semantic: str = "semantic_id") -> DataFrame:
    """fault, n: repeated ids, and ids and classes outside their ranges."""
    again = catalog.groupBy(identity).agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("repeated id").alias("fault"), F.count("*").alias("n"))
    out = catalog.agg(F.count_if(~F.col(identity).between(1, 0xFFFF)).alias("i"), F.count_if(~F.col(semantic).between(0, 0xFFFF)).alias("s"))
    rows = F.array(F.struct(F.lit("id out of range").alias("fault"), F.col("i").alias("n")), F.struct(F.lit("class out of range").alias("fault"), F.col("s").alias("n")))
    return again.unionByName(out.select(F.inline(rows)))


def open_ends(changes: DataFrame, columns: Sequence[str] = CHANGES.names[1:]) -> DataFrame:
    """Zeros, which mean none, as nulls."""
    return changes.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in columns})


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return open_ends(read_csv(spark, path, CHANGES))


def read_background_changes(spark: SparkSession, path: str) -> DataFrame:
    """vertex, state (absent, persistent, unobserved) of background vertices; another state is an error."""
    rows = read_csv(spark, path, T.StructType([T.StructField("vertex", T.LongType()), T.StructField("state", T.StringType())]))
    known = F.col("state").isin("absent", "persistent", "unobserved")
    return rows.withColumn("state", F.when(known, F.col("state")).otherwise(F.raise_error(F.lit("unknown vertex state")).cast("string")))


def read_truth_changes(spark: SparkSession, path: str) -> DataFrame:
    """object, appeared, disappeared of true changes: symbols as numbers, zeros as none."""
    from ..functions.labels import symbol_index

    rows = read_csv(spark, path, T.StructType([T.StructField("ObjectSymbol", T.StringType()), T.StructField("AppearedAt", T.LongType()), T.StructField("DisappearedAt", T.LongType())]))
    named = rows.select(symbol_index(F.col("ObjectSymbol")).alias("object"), F.col("AppearedAt").alias("appeared"), F.col("DisappearedAt").alias("disappeared"))
    return open_ends(named, ["appeared", "disappeared"])


def newest_row(spark: SparkSession, path: str, order: str) -> DataFrame:
    """The last row of a metric table by a column, its cells numbers where they are: a run appends a row a time."""
    rows = spark.read.option("header", True).csv(path)
    cells = [F.coalesce(F.col(f"`{c}`").try_cast("double").cast("string"), F.col(f"`{c}`")).alias(c) for c in rows.columns]
    return rows.agg(F.max_by(F.struct(*cells), F.col(order).try_cast("double")).alias("r")).select("r.*")


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MERGES)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """physical_instance_id, semantic_id, name; ids are unique and within 16 bits, else an error."""
    schema = "entities array<struct<physical_instance_id: int, semantic_id: int, name: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select(F.inline("entities"))
    if broken := [r["fault"] for r in catalog_faults(rows).where("n > 0").collect()]:  # a row a rule
        raise ValueError(f"catalogue {path}: {', '.join(broken)}")
    return rows


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """One row per remembered object, with the prior where a memory has no stationarity."""
    objects = "object_id: bigint, semantic_label: int, bbox_center: array<double>, bbox_dimensions: array<double>, stationarity_alpha: double, stationarity_beta: double, session_state: string"
    rows = spark.read.schema(f"version int, objects array<struct<{objects}>>").json(path, multiLine=True)
    return rows.select("version", F.inline("objects")).withColumns({"stationarity_alpha": F.coalesce("stationarity_alpha", F.lit(ALPHA)), "stationarity_beta": F.coalesce("stationarity_beta", F.lit(BETA))})


def read_pose(spark: SparkSession, path: str) -> DataFrame:
    """file, pose: 16 numbers by rows from each text file, a finite rigid transform; anything else is an error."""
    from ..functions.geometry import rigid

    numbers = F.transform(F.split(F.trim(F.regexp_replace("value", r"[\s,]+", " ")), " "), lambda x: x.cast("double"))
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), numbers.alias("pose"))
    fault = F.when(F.size("pose") != 16, "a pose has 16 numbers").when(~rigid(F.col("pose")), "a pose is a rigid transform")
    return rows.withColumn("pose", F.when(fault.isNull(), F.col("pose")).otherwise(F.raise_error(fault).cast("array<double>")))


def unambiguous(files: DataFrame, frame: str, path: str) -> DataFrame:
    """frame, path for frames with exactly one file."""
    return files.groupBy(frame).agg(F.count("*").alias("n"), F.first(path).alias(path)).where("n = 1").drop("n")


def missing_inputs(ledger: DataFrame, files: DataFrame, frame: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """kind, n: how many frames of the ledger lack each kind of input."""
    wanted = ledger.select(frame).withColumn(kind, F.explode(F.array(*map(F.lit, kinds))))
    return wanted.join(files.select(frame, kind).distinct(), [frame, kind], "left_anti").groupBy(kind).agg(F.count("*").alias("n"))


def session_time(token: str = "token", zone: str = "UTC"):
    """Nanoseconds since 1970 of a local acquisition token such as 20240131_235959."""
    digits = F.regexp_extract(F.col(token), r"(\d{8})[_\-T](\d{6})", 0)
    local = F.try_to_timestamp(F.regexp_replace(digits, r"[_\-T]", ""), F.lit("yyyyMMddHHmmss"))
    return F.unix_micros(F.to_utc_timestamp(local, zone)) * 1000
