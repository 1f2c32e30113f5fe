"""Scans: telemetry view over the events table, JSON and CSV readers, synthetic events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import table

#: The envelope of a stored event; payload stays schemaless.
EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("source_ip", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("service", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("payload", T.VariantType()),
    T.StructField("timestamp", T.LongType()),
])


def telemetry(events: DataFrame) -> DataFrame:
    """Telemetry columns for rows (event_id, ts, user_id, event_type, value, props). payload holds the text values of an event."""
    kind, user = F.col("event_type"), F.col("user_id")
    k = F.get_json_object("props", "$.k")
    injected = F.when(F.col("event_id") % 9 == 0, "1 OR 1=1 --").when(F.col("event_id") % 9 == 1, "admin'--").when(F.col("event_id") % 9 == 2, "<script>alert(1)</script>")
    click = kind == "click"
    query = F.when(kind.isin("view", "purchase"), F.coalesce(injected, F.concat(F.lit("q="), F.col("event_id").cast("string"))))
    name = F.when(F.col("event_id") % 23 == 0, "root' or 1=1 --").otherwise(F.concat(F.lit("user-"), (user % 50).cast("string")))
    username = F.when(kind.isin("error", "signup"), name)
    return events.select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string")).alias("source_ip"),
        F.when(user % 4 == 0, "healthcare").when(user % 4 == 1, "agriculture").when(user % 4 == 2, "urban").otherwise("general").alias("domain"),
        F.concat(F.lit("node-"), (user % 12).cast("string")).alias("service"),
        F.when(kind == "error", "auth_failure").when(kind == "signup", "auth_attempt").when(click, "telemetry").when(kind == "view", "http_request").otherwise("database_query").alias("event_type"),
        F.when(click, F.least("value", F.lit(100.0))).alias("cpu"),
        F.when(click, k.cast("double")).alias("memory"),
        F.when(click, F.col("value") * 5).alias("network"),
        F.when(click, k.cast("bigint")).alias("requests"),
        query.alias("query"),
        username.alias("username"),
        F.map_filter(F.map_from_arrays(F.array(F.lit("query"), F.lit("username")), F.array(query, username)), lambda _, v: v.isNotNull()).alias("payload"),
        F.when(kind == "signup", F.col("event_id") % 3 == 0).alias("success"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_id").alias("seq"),
    )


def telemetry_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(table(spark, sf_dir, "events"))


def json_array(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """A file that holds one JSON array of events."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """One event a line; a line that does not parse is kept in _corrupt_record."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(full).json(path)


def batch(texts: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """Items of batches (batch_id, body: a JSON array of events): (batch_id, index, ok, error, event).

    An item that is no event of the schema has an error and no event. A body that
    gives no items says why in one row without an index: it is null, no JSON, no
    array, or an empty one. So no body goes without a row.
    """
    read = F.try_parse_json("body")
    listed = F.try_variant_get(read, "$", "array<variant>")
    start = F.left("body", F.lit(100))
    why = (
        F.when(F.col("body").isNull(), "no body")
        .when(F.col("_read").isNull(), F.concat(F.lit("not json: "), start))
        .when(F.col("_items").isNull(), F.concat(F.lit("not a batch: "), start))
        .when(F.size("_items") == 0, F.concat(F.lit("no events: "), start))
    )
    bodies = texts.select("batch_id", "body", read.alias("_read"), listed.alias("_items"))
    items = bodies.select("batch_id", why.alias("_why"), F.posexplode_outer("_items").alias("index", "item"))
    text = F.to_json("item")
    event = F.from_json(text, schema)
    named = F.coalesce(event["event_type"].isNotNull() & event["source_ip"].isNotNull(), F.lit(False)) & F.col("_why").isNull()
    error = F.when(~named, F.coalesce("_why", F.concat(F.lit("not an event: "), F.coalesce(F.left(text, F.lit(100)), F.lit("null")))))
    return items.select("batch_id", "index", named.alias("ok"), error.alias("error"), F.when(named, event).alias("event"))


def replayed(start_us: int, steps: DataFrame) -> DataFrame:
    """Scenario steps (offset_s, ...) as events at fixed offsets from a start, in order."""
    return steps.withColumn("ts_us", (F.lit(start_us) + F.col("offset_s") * 1_000_000).cast("bigint")).orderBy("ts_us")


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def typed_metric(payload: str, name: str) -> F.Column:
    """A payload metric as double if its JSON type is a number, else null."""
    value = F.try_variant_get(payload, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(payload, f"$.{name}", "double"))


def synthetic(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Made events with the columns of telemetry(): normal metrics and a tenth of attacks."""
    r = [F.rand(seed + i) for i in range(5)]
    attack = F.col("seq") % 10 == 0
    return (
        spark.range(n).withColumnRenamed("id", "seq").select(
            F.concat(F.lit("syn-"), F.col("seq").cast("string")).alias("event_id"),
            F.concat(F.lit("10.1.0."), (F.col("seq") % 50).cast("string")).alias("source_ip"),
            F.element_at(F.array(F.lit("healthcare"), F.lit("agriculture"), F.lit("urban")), (F.col("seq") % 3 + 1).cast("int")).alias("domain"),
            F.concat(F.lit("node-"), (F.col("seq") % 12).cast("string")).alias("service"),
            F.when(attack, "http_request").otherwise("telemetry").alias("event_type"),
            F.when(~attack, 30 + 20 * r[0]).alias("cpu"), F.when(~attack, 40 + 10 * r[1]).alias("memory"), F.when(~attack, 200 + 100 * r[2]).alias("network"),
            F.when(~attack, (50 + 50 * r[3]).cast("bigint")).alias("requests"), F.when(attack, "' OR 1=1; DROP TABLE users; --").alias("query"),
            F.lit(None).cast("boolean").alias("success"), (F.lit(1_700_000_000_000_000) + F.col("seq") * 500_000).alias("ts_us"), "seq",
        )
    )
