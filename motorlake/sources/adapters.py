"""The ten raw sets derived from the given star-schema tables.

Row for row these are whole tables: no table is cut down, values are only renamed and
shifted into the ranges the cleaning rules look at.  ``_row_uid`` is the row's place in its
file and identifies a row together with ``_source_file``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motorlake.session import configure

ORIGIN = "2023-11-01"  # first service, claim and stock day
SPAN_DAYS = 120
SNAPSHOT_DATE = "2024-02-20"
INGESTED_AT = "2024-03-01 00:00:00"
BATCH = "BATCH-1"

_CODES = ["P0217", "P0562", "P0300", "C0035", "P0420", "B0001", "U0100", "C0561"]
_ISSUES = {
    "1-URGENT": "Alternator replacement due to charging failure",
    "2-HIGH": "Coolant leak repair and water pump replacement",
    "3-MEDIUM": "Scheduled routine maintenance and multi-point inspection",
    "4-NOT SPECIFIED": "Cabin filter and wiper check",
    "5-LOW": "Front brake rotor and pad replacement",
}
_MODELS = {"AUTOMOBILE": "Apex", "BUILDING": "Titan", "FURNITURE": "Pulse", "HOUSEHOLD": "Horizon"}
_CLAIMED = ["Alternator", "Coolant", "brake rotor"]


# Column types of the given tables; stating them saves a footer-reading job per scan.
GIVEN = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(c: Column, mapping: dict[str, str], default: Column) -> Column:
    expr = default
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)).otherwise(expr)
    return expr


def _choose(c: Column, values: list[str]) -> Column:
    expr = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        expr = F.when(c == i, F.lit(v)).otherwise(expr)
    return expr


def _audit(df: DataFrame, ingested: Column | None = None) -> DataFrame:
    return df.withColumns(
        {
            "_ingested_at": ingested if ingested is not None else F.lit(INGESTED_AT),
            "_batch_id": F.lit(BATCH),
        }
    )


def _located(df: DataFrame) -> DataFrame:
    return df.select(
        "*", F.col("_metadata.file_name").alias("_source_file"),
        # The whole path: file names repeat between partition folders.
        F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("_row_uid"),
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _day(offset: Column) -> Column:
    return F.date_add(F.lit(ORIGIN).cast("date"), offset.cast("int"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _located(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props", "_metadata"))
    return _audit(
        e.select(
            F.concat(F.lit("VH-"), "user_id").alias("vehicle_id"),
            F.col("ts").alias("timestamp"),
            F.floor(F.col("value") * 30).cast("int").alias("rpm"),
            (F.lit(20) + (F.col("event_id") * 13) % 150).cast("decimal(5,2)").alias("temperature"),
            ((F.lit(90) + _k() % 80).cast("decimal(6,0)") / 10).cast("decimal(4,2)").alias("battery"),
            (((F.col("event_id") * 7) % 170).cast("decimal(6,0)") / 10).cast("decimal(6,3)").alias("vibration"),
            F.col("event_id").alias("_row_seq"),
            "_source_file",
            "_row_uid",
        )
    )


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events.  Severities are unevenly written; one code in a hundred is malformed."""
    e = _located(
        table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props", "_metadata")
    ).where(F.col("event_type") == "error")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    e = e.withColumn("k", _k())
    named = e.join(p, p["p_partkey"] == e["k"] * 2, "left")
    k = F.col("k")
    return _audit(
        named.select(
            F.concat(F.lit("VH-"), "user_id").alias("vehicle_id"),
            F.col("ts").alias("timestamp"),
            F.when(k == 99, F.lit("X999")).otherwise(_choose(k % 8, _CODES)).alias("code"),
            F.when(k % 5 == 0, F.lit("Electrical"))
            .otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit("-"), F.col("p_partkey")))
            .alias("component"),
            F.when(k == 98, F.lit("INFO"))
            .otherwise(_choose(k % 4, ["CRITICAL", " high ", "MEDIUM", "low"]))
            .alias("severity"),
            F.col("event_id").alias("_row_seq"),
            "_source_file",
            "_row_uid",
        )
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without debt own a registered vehicle; readings of the rest have no match."""
    c = _located(table(spark, sf_dir, "customer")).where(F.col("c_acctbal") >= 0)
    return _audit(
        c.select(
            F.concat(F.lit("VH-"), "c_custkey").alias("vehicle_id"),
            _pick(F.col("c_mktsegment"), _MODELS, F.initcap("c_mktsegment")).alias("model"),
            F.concat(F.lit("V"), F.col("c_custkey") % 3).alias("variant"),
            F.date_add(F.lit("2018-01-01").cast("date"), (F.col("c_custkey") % 2500).cast("int")).alias("manufacture_date"),
            F.concat(F.lit("DLR-"), "c_nationkey").alias("dealer_id"),
            F.col("c_custkey").alias("_row_seq"),
            "_source_file",
            "_row_uid",
        )
    )


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations do not grow with the data; left to itself, the planner may broadcast what is joined to them."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name"))


def dealers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _located(table(spark, sf_dir, "supplier"))
    p = _places(spark, sf_dir)
    return _audit(
        s.join(p, s["s_nationkey"] == p["n_nationkey"]).select(
            F.concat(F.lit("DLR-"), "s_suppkey").alias("dealer_id"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("city"),
            (F.lit(5) + F.col("s_suppkey") % 20).cast("int").alias("bays"),
            F.col("s_suppkey").alias("_row_seq"),
            "_source_file",
            "_row_uid",
        )
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _located(table(spark, sf_dir, "part"))
    return _audit(
        p.select(
            F.concat(F.lit("PRT-"), "p_partkey").alias("part_id"),
            F.concat("p_name", F.lit("-"), "p_partkey").alias("name"),
            F.col("p_type").alias("category"),
            (F.col("p_size") * 1000).cast("int").alias("lifespan_km"),
            F.col("p_retailprice").alias("base_cost"),
            (F.lit(1) + F.col("p_size") % 21).cast("int").alias("lead_time_days"),
            F.col("p_partkey").alias("_row_seq"),
            "_source_file",
            "_row_uid",
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _located(table(spark, sf_dir, "customer"))
    p = _places(spark, sf_dir)
    return _audit(
        c.join(p, c["c_nationkey"] == p["n_nationkey"]).select(
            F.concat(F.lit("CUST-"), "c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("region"),
            F.col("c_custkey").alias("_row_seq"),
            "_source_file",
            "_row_uid",
        )
    )


def vehicle_customer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _located(table(spark, sf_dir, "customer"))
    return _audit(
        c.select(
            F.concat(F.lit("VH-"), "c_custkey").alias("vehicle_id"),
            F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(" "))
            .otherwise(F.concat(F.lit("CUST-"), "c_custkey"))
            .alias("customer_id"),
            F.date_add(F.lit("2018-02-01").cast("date"), (F.col("c_custkey") % 2500).cast("int")).alias("registration_date"),
            F.col("c_custkey").alias("_row_seq"),
            "_source_file",
            "_row_uid",
        )
    )


def service(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _located(table(spark, sf_dir, "orders"))
    return _audit(
        o.select(
            F.concat(F.lit("SRV-"), "o_orderkey").alias("service_id"),
            F.concat(F.lit("VH-"), "o_custkey").alias("vehicle_id"),
            F.concat(F.lit("DLR-"), F.col("o_orderkey") % 110).alias("dealer_id"),
            _day(F.col("o_orderkey") % SPAN_DAYS).alias("visit_date"),
            _pick(F.col("o_orderpriority"), _ISSUES, F.lit("Other")).alias("issue"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("cost"),
            F.col("o_orderkey").alias("_row_seq"),
            "_source_file",
            "_row_uid",
        )
    )


def warranty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines.  Claim ids repeat up to five times; untaxed, undiscounted lines are
    credits with a negative amount."""
    li = _located(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_shipdate", "_metadata",
        )
    ).where(F.col("l_returnflag") == "R")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"], "left").join(
        p, li["l_partkey"] == p["p_partkey"], "left"
    )
    credit = (F.col("l_discount") == 0) & (F.col("l_tax") == 0)
    amount = F.col("l_extendedprice").cast("decimal(10,2)")
    return _audit(
        joined.select(
            F.concat(F.lit("CLM-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("claim_id"),
            F.concat(F.lit("VH-"), "o_custkey").alias("vehicle_id"),
            F.concat("p_name", F.lit("-"), "p_partkey").alias("component"),
            _day(F.col("l_orderkey") % SPAN_DAYS + F.col("l_linenumber")).alias("claim_date"),
            F.when(credit, -amount).otherwise(amount).cast("decimal(10,2)").alias("amount"),
            F.struct("l_partkey", "l_suppkey").alias("_row_seq"),
            "_source_file",
            "_row_uid",
            "l_shipdate",
        ),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"),
    ).drop("l_shipdate")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock per part and dealer from the line quantities, less a reserve of five."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    grouped = li.groupBy("l_partkey", "l_suppkey").agg(
        (F.sum(F.col("l_quantity").cast("long")) - 5).cast("int").alias("stock"),
        (F.max("l_linenumber") - 1).cast("int").alias("lead_time"),
        F.min("l_orderkey").alias("first_order"),
    )
    return _audit(
        grouped.select(
            F.concat(F.lit("PRT-"), "l_partkey").alias("part_id"),
            F.concat(F.lit("DLR-"), "l_suppkey").alias("dealer_id"),
            "stock",
            "lead_time",
            _day(F.col("first_order") % SPAN_DAYS).alias("snapshot_date"),
            F.col("first_order").alias("_row_seq"),
            F.lit("lineitem.parquet").alias("_source_file"),
            F.concat_ws("#", "l_partkey", "l_suppkey").alias("_row_uid"),
        )
    )


def same_day_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims dated on the visit they stem from, naming the replaced part in words."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"
    ).where(F.col("l_returnflag") == "R")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.concat_ws("-", F.lit("CLM"), "l_orderkey", "l_linenumber", "l_partkey").alias("claim_id"),
        F.concat(F.lit("VH-"), "o_custkey").alias("vehicle_id"),
        _choose(F.col("l_linenumber") % 3, _CLAIMED).alias("component"),
        _day(F.col("l_orderkey") % SPAN_DAYS).alias("claim_date"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("amount"),
    )


SETS = {
    "telemetry": telemetry,
    "diagnostics": diagnostics,
    "vehicles": vehicles,
    "service": service,
    "warranty": warranty,
    "parts": parts,
    "dealers": dealers,
    "components": components,
    "customers": customers,
    "vehicle_customer_map": vehicle_customer_map,
}


def raw_set(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SETS[name](spark, sf_dir)


def telemetry_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as JSON messages: some cut short, some with an extra field, some with
    transport fields, all inside the limits the data happens to have."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = _k()
    head = F.format_string(
        '{"vehicle_id":"%s","timestamp":"%s","rpm":%s,"temperature":%s,"battery":%s,"vibration":%s',
        F.when(k == 97, F.lit("  ")).otherwise(F.concat(F.lit("VH-"), F.col("user_id"))),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.floor(F.col("value") * 30).cast("string"),
        (F.lit(20) + (F.col("event_id") * 13) % 150).cast("string"),
        (F.lit(40) + k).cast("string"),
        ((F.col("event_id") * 7) % 60).cast("string"),
    )
    tail = (
        F.when(k == 96, F.lit(""))
        .when(k == 95, F.lit(',"driver":"x"}'))
        .when(F.col("event_type") == "view", F.lit(',"_producer_id":"p1","_kafka_partition":2}'))
        .otherwise(F.lit("}"))
    )
    return e.select(
        F.concat(head, tail).alias("value"),
        F.concat(F.lit("VH-"), "user_id").alias("key"),
        F.lit("vehicle-telemetry").alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
    )


def diagnostic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props").where(
        F.col("event_type") == "error"
    )
    k = _k()
    body = F.format_string(
        '{"vehicle_id":"VH-%s","timestamp":"%s","code":"%s","component":"%s","severity":"%s"',
        F.col("user_id").cast("string"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(k == 99, F.lit("X")).otherwise(F.lower(_choose(k % 8, _CODES))),
        F.when(k == 98, F.lit("")).otherwise(F.lit("Electrical")),
        F.when(k == 97, F.lit("SEVERE")).otherwise(_choose(k % 6, ["low", "Medium", " HIGH ", "CRITICAL", "Warning", "INFO"])),
    )
    return e.select(
        F.concat(body, F.when(k == 96, F.lit("")).otherwise(F.lit("}"))).alias("value"),
        F.concat(F.lit("VH-"), "user_id").alias("key"),
        F.lit("diagnostic-events").alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
    )
