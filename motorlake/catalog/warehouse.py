"""Registered dimension, fact and staging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake.catalog.registry import query
from motorlake.catalog.sql import BLOCKS, DAY, STAMP, sql
from motorlake.plans import dimensions as dims, facts, staging
from motorlake.plans.warehouse import (
    DIMENSIONS,
    TABLES,
    Warehouse,
    load_dimensions,
    load_fact,
    open_warehouse,
    reload_dimensions,
    reload_fact,
    row_counts,
    silver_tables,
)
from motorlake.session import scratch_path, settle, side_by_side
from motorlake.sources.adapters import raw_set, table


@query(
    "d1_dim_date",
    sql(f"""SELECT date_key, {DAY.format('calendar_date')} AS calendar_date, day_of_week, day_name, day_of_month, day_of_year,
week_of_year, month_number, month_name, quarter, year, is_weekend, coalesce(n, 0) AS orders
FROM (SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(d AS DATE) AS calendar_date, isodow(d) AS day_of_week,
       dayname(d) AS day_name, day(d) AS day_of_month, dayofyear(d) AS day_of_year, weekofyear(d) AS week_of_year,
       month(d) AS month_number, monthname(d) AS month_name, quarter(d) AS quarter, year(d) AS year, isodow(d) >= 6 AS is_weekend
  FROM (SELECT unnest(generate_series(make_date((SELECT year(min(o_orderdate)) FROM orders), 1, 1),
                                      make_date((SELECT year(max(o_orderdate)) FROM orders), 12, 31), INTERVAL 1 DAY)) AS d)
  UNION ALL SELECT -1, DATE '1900-01-01', 1, 'Monday', 1, 1, 1, 1, 'January', 1, 1900, FALSE)
LEFT JOIN (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS date_key, count(*) AS n FROM orders GROUP BY 1) USING (date_key)"""),
)
def d1(spark, sf_dir):
    """Calendar covering the order dates, with the orders of each day."""
    from motorlake.functions.text import date_key

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    daily = orders.groupBy(date_key(F.col("d")).alias("date_key")).agg(F.count("*").alias("orders"))
    return dims.dim_date_covering(orders, "d").join(daily, "date_key", "left").na.fill({"orders": 0})


@query(
    "d2_unknown_members",
    sql("""SELECT 'dim_date' AS dim, count(*) FILTER (WHERE date_key = -1) AS unknown, count(*) AS rows FROM dim_date
UNION ALL SELECT 'dim_model', count(*) FILTER (WHERE model_key = -1), count(*) FROM dim_model
UNION ALL SELECT 'dim_dealer', count(*) FILTER (WHERE dealer_key = -1), count(*) FROM dim_dealer
UNION ALL SELECT 'dim_customer', count(*) FILTER (WHERE customer_key = -1), count(*) FROM dim_customer
UNION ALL SELECT 'dim_component', count(*) FILTER (WHERE component_key = -1), count(*) FROM dim_component
UNION ALL SELECT 'dim_vehicle', count(*) FILTER (WHERE vehicle_key = -1), count(*) FROM dim_vehicle"""),
)
def d2(spark, sf_dir):
    """Each dimension has exactly one unknown member."""
    w = open_warehouse(spark, sf_dir)
    rows = None
    for name in dims.UNKNOWN:
        key = name.removeprefix("dim_") + "_key"
        one = w.table(name).agg(
            F.lit(name).alias("dim"), F.count_if(F.col(key) == -1).alias("unknown"), F.count("*").alias("rows")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("d3_dim_model", sql("SELECT *, 0.0 AS fuel_capacity_or_kwh, 0.0 AS curb_weight_kg FROM dim_model"))
def d3(spark, sf_dir):
    return dims.dim_model(silver_tables(spark, sf_dir)["vehicles"])


@query("d4_dim_dealer", sql("SELECT * FROM dim_dealer"))
def d4(spark, sf_dir):
    return dims.dim_dealer(silver_tables(spark, sf_dir)["dealers"])


@query("d5_dim_customer", sql("SELECT * FROM dim_customer"))
def d5(spark, sf_dir):
    return dims.dim_customer(silver_tables(spark, sf_dir)["customers"])


@query("d6_dim_component", sql("SELECT * FROM dim_component"))
def d6(spark, sf_dir):
    return dims.dim_component(silver_tables(spark, sf_dir)["components"])


@query("d6_part_lookup", sql("SELECT part_id, component_key FROM cmp JOIN dim_component ON name = component_name"))
def d6_lookup(spark, sf_dir):
    clean = silver_tables(spark, sf_dir)["components"]
    return dims.part_lookup(clean, dims.dim_component(clean))


@query("d7_dim_vehicle", sql(f"""SELECT vehicle_key, vehicle_id, model_key, customer_key, selling_dealer_key, variant,
{DAY.format('manufacture_date')} AS manufacture_date, manufacture_year, status FROM dim_vehicle"""))
def d7(spark, sf_dir):
    t = open_warehouse(spark, sf_dir).table
    s = silver_tables(spark, sf_dir)
    return dims.dim_vehicle(
        s["vehicles"], s["vehicle_customer_map"], t("dim_model"), t("dim_dealer"), t("dim_customer")
    )


@query(
    "d8_surrogate_keys",
    sql("SELECT o_orderkey, row_number() OVER (ORDER BY md5('SRV-' || o_orderkey), o_orderkey) AS service_key FROM orders"),
)
def d8(spark, sf_dir):
    """Dense keys for every order, numbered bucket by bucket."""
    from motorlake.operators.keys import assign_keys

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("SRV-"), "o_orderkey").alias("service_id"))
    return assign_keys(o, "service_id", "service_key").select("o_orderkey", "service_key")


@query(
    "d9_upsert",
    sql("""SELECT coalesce(b.claim_id, a.claim_id) AS claim_id, coalesce(a.fid, -1) > 0 AS kept_id,
CASE WHEN b.claim_id IS NOT NULL THEN b.cents ELSE a.cents END / 100.0 AS amount
FROM (SELECT claim_id, cents, 1 AS fid FROM wrn_raw WHERE rn = 1 AND claim_date <= DATE '2024-01-15') a
FULL JOIN (SELECT claim_id, max(cents) AS cents FROM wrn_raw WHERE claim_date > DATE '2024-01-10' GROUP BY 1) b ON a.claim_id = b.claim_id"""),
)
def d9(spark, sf_dir):
    """Later claim versions over an earlier load: latest attributes win, the id stays."""
    raw = raw_set(spark, sf_dir, "warranty")
    from motorlake.operators.dedup import tag_kept

    first = tag_kept(raw, ["claim_id"], [F.col("_ingested_at"), F.col("_row_seq")], ["_source_file", "_row_uid"]).where("_kept")
    target = first.where(F.col("claim_date") <= "2024-01-15").select("claim_id", "amount", F.lit(1).alias("fact_id"))
    source = (
        raw.where(F.col("claim_date") > "2024-01-10")
        .groupBy("claim_id")
        .agg(F.max("amount").alias("amount"))
        .withColumn("fact_id", F.lit(-1))
    )
    out = dims.upsert(target, source, ["claim_id"], keep=["fact_id"])
    return out.select("claim_id", (F.col("fact_id") > 0).alias("kept_id"), "amount")


# ---- a second load ---------------------------------------------------------------------
#
# An earlier state of the company is loaded first: the members whose md5 starts below 8, with older
# attributes, one dealer that has closed since, and no model Titan.  Then everything is loaded again as it is.

_EARLY = "md5({}) < '8'"


def _members(dim, natural, attribute, source, early, retired=""):
    """SQL of a dimension after both loads: keys of the first in order, then those of the second."""
    order = "nat" if dim == "dim_model" else "md5(nat), nat"
    return f"""
SELECT '{dim}' AS dim, nat AS natural_key, CASE WHEN early THEN 0 ELSE count(*) FILTER (WHERE early) OVER () END
  + row_number() OVER (PARTITION BY early ORDER BY {order}) AS member_key, attribute
FROM (SELECT {natural} AS nat, {attribute} AS attribute, {early} AS early FROM {source}{retired})"""


BLOCKS["again_model"] = _members("dim_model", "model_name", "powertrain_type", "dim_model WHERE model_key > 0", "model_name IN (SELECT model FROM veh WHERE md5(vehicle_id) < '8' AND model <> 'Titan')")
BLOCKS["again_dealer"] = _members("dim_dealer", "dealer_id", "name", "dlr", _EARLY.format("dealer_id"), " UNION ALL SELECT 'DLR-CLOSED', 'Closed', TRUE")
BLOCKS["again_customer"] = _members("dim_customer", "customer_id", "customer_name", "cus", _EARLY.format("customer_id"))
BLOCKS["again_component"] = _members("dim_component", "name", "category", "cmp", _EARLY.format("name"))
BLOCKS["again_vehicle"] = _members("dim_vehicle", "vehicle_id", "variant", "veh", "md5(vehicle_id) < '8' AND model <> 'Titan'")


class _Before:
    """The earlier state of every silver set."""

    def __init__(self, clean):
        self._clean = clean

    def __getitem__(self, name):
        rows = self._clean[name]
        early = lambda c: F.md5(F.col(c)) < "8"
        old = lambda df, c: df.withColumn(c, F.concat(F.lit("Old "), c))
        if name == "dealers":
            closed = rows.sparkSession.createDataFrame([("DLR-CLOSED", "Closed", "X", "Y")], "dealer_id string, name string, city string, region string")
            return old(rows.where(early("dealer_id")), "name").unionByName(closed, allowMissingColumns=True)
        if name == "customers":
            return old(rows.where(early("customer_id")), "customer_name")
        if name == "components":
            return old(rows.where(early("name")), "category")
        if name == "vehicles":
            return old(rows.where(early("vehicle_id") & (F.col("model") != "Titan")), "variant")
        return old(rows, "component") if name == "diagnostics" else rows


_loaded_twice: dict[tuple[str, str], tuple[Warehouse, dict, dict]] = {}


def loaded_twice(spark, sf_dir, *names):
    """A warehouse after both loads of all dimensions and of the facts ``names``, and these facts after the first."""
    clean = silver_tables(spark, sf_dir)
    before = _Before(clean)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _loaded_twice:
        open_warehouse(spark, sf_dir, *[f"silver/{n}" for n in ("vehicles", "vehicle_customer_map", "dealers", "customers", "components")])
        w = Warehouse(spark, scratch_path(spark, "twice"))
        load_dimensions(w, before)
        members = {n: w.table(n) for n in DIMENSIONS}
        reload_dimensions(w, clean)
        _loaded_twice[key] = w, members, {}
    w, members, first = _loaded_twice[key]

    def both(n):
        load_fact(w, before, n, members.__getitem__)
        first[n] = w.table(n)
        reload_fact(w, clean, n)

    side_by_side([lambda n=n: both(n) for n in names if n not in first])
    return w, first


@query("d9_second_load", sql("\nUNION ALL ".join(f"SELECT * FROM again_{d}" for d in ("model", "dealer", "customer", "component", "vehicle"))))
def d9_second(spark, sf_dir):
    """All members after the second load: old ones keep their keys and have new attributes, new ones come after them."""
    w, _ = loaded_twice(spark, sf_dir)
    shown = {"dim_model": "powertrain_type", "dim_dealer": "dealer_name", "dim_customer": "customer_name", "dim_component": "category", "dim_vehicle": "variant"}
    rows = None
    for name, attribute in shown.items():
        natural, key = dims.RENEWED[name][0], name.removeprefix("dim_") + "_key"
        one = w.table(name).where(F.col(key) > 0).select(
            F.lit(name).alias("dim"), F.col(natural).alias("natural_key"), F.col(key).alias("member_key"), F.col(attribute).alias("attribute")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "d9_second_load_facts",
    sql("""SELECT 'service' AS fact, service_id AS id, coalesce(v.member_key, -1) AS vehicle_key, coalesce(d.member_key, -1) AS other_key, TRUE AS kept_id,
coalesce(md5(s.vehicle_id) < '8' AND x.model <> 'Titan', FALSE) AS known_before
FROM srv s LEFT JOIN again_vehicle v ON s.vehicle_id = v.natural_key LEFT JOIN again_dealer d ON s.dealer_id = d.natural_key LEFT JOIN veh x ON s.vehicle_id = x.vehicle_id
UNION ALL SELECT 'warranty', claim_id, coalesce(v.member_key, -1), coalesce(c.member_key, -1), TRUE, coalesce(md5(s.vehicle_id) < '8' AND x.model <> 'Titan', FALSE)
FROM wrn s LEFT JOIN again_vehicle v ON s.vehicle_id = v.natural_key LEFT JOIN again_component c ON s.component = c.natural_key LEFT JOIN veh x ON s.vehicle_id = x.vehicle_id"""),
)
def d9_facts(spark, sf_dir):
    """Visits and claims after the second load: unknown members of the first are resolved, the facts' ids stay."""
    w, first = loaded_twice(spark, sf_dir, "fact_service", "fact_warranty")
    rows = None
    for name, own, key, fact_id in (("service", "service_id", "dealer_key", "service_fact_id"), ("warranty", "claim_id", "component_key", "warranty_fact_id")):
        before = first[f"fact_{name}"].select(own, F.col(fact_id).alias("_id"), F.col("vehicle_key").alias("_vehicle"))
        one = w.table(f"fact_{name}").join(before, own, "left").select(
            F.lit(name).alias("fact"), F.col(own).alias("id"), "vehicle_key", F.col(key).alias("other_key"),
            (F.col(fact_id) == F.col("_id")).alias("kept_id"), (F.col("_vehicle") > 0).alias("known_before"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("d17_bridge_second_load", sql(f"SELECT diagnostic_id, vehicle_id, {STAMP.format('ts')} AS timestamp, code, component, severity FROM bridge"))
def d17_second(spark, sf_dir):
    """The bridge after the second load: one row an id, with the renewed component."""
    w, _ = loaded_twice(spark, sf_dir, "silver_diagnostics")
    return w.table("silver_diagnostics").select("diagnostic_id", "vehicle_id", "timestamp", "code", "component", "severity")


@query(
    "d10_insert_absent",
    sql("""SELECT vehicle_id, model, 'old' AS origin FROM veh WHERE made <= DATE '2019-06-30'
UNION ALL SELECT vehicle_id, model, 'new' FROM veh WHERE made > DATE '2019-06-30'"""),
)
def d10(spark, sf_dir):
    """Vehicles of a second load enter only where the first load does not have them."""
    v = silver_tables(spark, sf_dir)["vehicles"].select("vehicle_id", "model", "manufacture_date")
    old = v.where(F.col("manufacture_date") <= "2019-06-30").select("vehicle_id", "model", F.lit("old").alias("origin"))
    return dims.insert_absent(old, v.select("vehicle_id", "model", F.lit("new").alias("origin")), ["vehicle_id"])


@query(
    "d11_lookup_fallback",
    sql("""SELECT vehicle_id, coalesce(d.vehicle_key, -1) AS vehicle_key, count(*) AS readings
FROM tel LEFT JOIN dim_vehicle d USING (vehicle_id) GROUP BY 1, 2"""),
)
def d11(spark, sf_dir):
    """Readings per vehicle with the resolved key; unregistered vehicles get -1."""
    w = open_warehouse(spark, sf_dir)
    counted = silver_tables(spark, sf_dir)["telemetry"].groupBy("vehicle_id").agg(F.count("*").alias("readings"))
    return dims.lookup(counted, w.table("dim_vehicle"), "vehicle_id", "vehicle_id", "vehicle_key")


@query(
    "d12_fact_telemetry",
    sql(f"""SELECT vehicle_key, date_key, {STAMP.format('ts')} AS timestamp, rpm, CAST(temp AS DOUBLE) AS temperature, bat10 / 10.0 AS battery,
vib10 / 10.0 AS vibration FROM ft WHERE ts > TIMESTAMP '2024-01-15'"""),
)
def d12(spark, sf_dir):
    """Second load of all readings over a fact that ends on January 15: only the rest is new."""
    w = open_warehouse(spark, sf_dir)
    resolved = facts.resolve_telemetry(silver_tables(spark, sf_dir)["telemetry"], w.table("dim_vehicle"))
    loaded = w.table("fact_telemetry").where(F.col("timestamp") <= F.lit("2024-01-15").cast("timestamp_ntz"))
    return facts.new_telemetry(resolved, loaded).drop("_silver_batch_id")


@query(
    "d13_fact_service",
    sql(f"SELECT service_id, vehicle_key, dealer_key, date_key, {DAY.format('visit_date')} AS visit_date, issue, cents / 100.0 AS cost FROM fs"),
)
def d13(spark, sf_dir):
    t = open_warehouse(spark, sf_dir).table
    return facts.resolve_service(silver_tables(spark, sf_dir)["service"], t("dim_vehicle"), t("dim_dealer")).drop("_silver_batch_id")


@query(
    "d14_fact_warranty",
    sql(f"SELECT claim_id, vehicle_key, component_key, date_key, {DAY.format('claim_date')} AS claim_date, cents / 100.0 AS amount FROM fw"),
)
def d14(spark, sf_dir):
    t = open_warehouse(spark, sf_dir).table
    return facts.resolve_warranty(silver_tables(spark, sf_dir)["warranty"], t("dim_vehicle"), t("dim_component")).drop("_silver_batch_id")


@query(
    "d15_fact_parts",
    sql(f"SELECT part_id, dealer_key, component_key, date_key, {DAY.format('snapshot_date')} AS snapshot_date, stock, lead_time FROM fp"),
)
def d15(spark, sf_dir):
    t = open_warehouse(spark, sf_dir).table
    return facts.resolve_parts(silver_tables(spark, sf_dir)["parts"], t("part_lookup"), t("dim_dealer")).drop("_silver_batch_id")


@query(
    "d16_date_key",
    sql("SELECT CAST(strftime(visit_date, '%Y%m%d') AS INT) AS date_key, count(*) AS visits FROM srv_raw GROUP BY 1"),
)
def d16(spark, sf_dir):
    from motorlake.functions.text import date_key

    return raw_set(spark, sf_dir, "service").groupBy(date_key(F.col("visit_date")).alias("date_key")).agg(F.count("*").alias("visits"))


@query(
    "d17_diagnostics_bridge",
    sql(f"SELECT diagnostic_id, vehicle_id, {STAMP.format('ts')} AS timestamp, code, component, severity FROM bridge"),
)
def d17(spark, sf_dir):
    bridge = facts.diagnostics_bridge(silver_tables(spark, sf_dir)["diagnostics"])
    return bridge.select("diagnostic_id", "vehicle_id", "timestamp", "code", "component", "severity")


@query(
    "d18_load_counts",
    sql("\nUNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows FROM {b}"
        for n, b in [(x, x) for x in ("dim_date", "dim_model", "dim_dealer", "dim_customer", "dim_component", "dim_vehicle")]
        + [("fact_telemetry", "ft"), ("fact_service", "fs"), ("fact_warranty", "fw"), ("fact_parts", "fp"), ("silver_diagnostics", "bridge")]
    )),
)
def d18(spark, sf_dir):
    """Rows of every table after the full load."""
    return row_counts(open_warehouse(spark, sf_dir))


_STAGED = {
    "diagnostics": ("silver_diagnostics", ["diagnostic_id", "vehicle_id", "timestamp", "dtc_code", "component", "severity", "_bronze_batch_id", "_silver_batch_id"],
                    f"SELECT diagnostic_id, vehicle_id, {STAMP.format('ts')} AS timestamp, code AS dtc_code, component, severity, 'BATCH-1' AS _bronze_batch_id, 'BATCH-SILVER-1' AS _silver_batch_id FROM bridge"),
    "dim_component": ("dim_component", None, "SELECT * FROM dim_component"),
    "dim_customer": ("dim_customer", None, "SELECT * FROM dim_customer"),
    "dim_dealer": ("dim_dealer", None, "SELECT * FROM dim_dealer"),
    "dim_model": ("dim_model", None, "SELECT *, 0.0 AS fuel_capacity_or_kwh, 0.0 AS curb_weight_kg FROM dim_model"),
    "dim_vehicle": ("dim_vehicle", None, f"SELECT vehicle_key, vehicle_id, model_key, customer_key, selling_dealer_key, variant, {DAY.format('manufacture_date')} AS manufacture_date, manufacture_year, status FROM dim_vehicle"),
    "fact_parts": ("fact_parts", ["part_id", "dealer_key", "component_key", "date_key", "stock", "lead_time", "_silver_batch_id"],
                   "SELECT part_id, dealer_key, component_key, date_key, stock, lead_time, 'BATCH-SILVER-1' AS _silver_batch_id FROM fp"),
    "fact_service": ("fact_service", ["service_id", "vehicle_key", "dealer_key", "date_key", "issue", "cost", "_silver_batch_id"],
                     "SELECT service_id, vehicle_key, dealer_key, date_key, issue, cents / 100.0 AS cost, 'BATCH-SILVER-1' AS _silver_batch_id FROM fs"),
    "fact_telemetry": ("fact_telemetry", ["vehicle_key", "date_key", "timestamp", "rpm", "temperature", "battery", "vibration"],
                       f"SELECT vehicle_key, date_key, {STAMP.format('ts')} AS timestamp, rpm, CAST(temp AS DOUBLE) AS temperature, bat10 / 10.0 AS battery, vib10 / 10.0 AS vibration FROM ft"),
    "fact_warranty": ("fact_warranty", ["claim_id", "vehicle_key", "component_key", "date_key", "amount"],
                      "SELECT claim_id, vehicle_key, component_key, date_key, cents / 100.0 AS amount FROM fw"),
}


def _register_staging(name):
    source, columns, text = _STAGED[name]

    @query(f"d19_stg_{name}", sql(text))
    def run(spark, sf_dir):
        # generated ids and load times are left out of the comparison, not of the model
        staged = staging.stage(open_warehouse(spark, sf_dir).table(source), name)
        return staged.select(*columns) if columns else staged


for _name in _STAGED:
    _register_staging(_name)


@query(
    "d19_stg_dim_date",
    sql(f"""SELECT date_key, {DAY.format('calendar_date')} AS calendar_date, day_of_week, day_name, day_of_month, day_of_year, week_of_year,
month_number, month_name, quarter, year, is_weekend, coalesce(n, 0) AS readings
FROM dim_date LEFT JOIN (SELECT date_key, count(*) AS n FROM ft GROUP BY 1) USING (date_key)"""),
)
def d19_dates(spark, sf_dir):
    """Staged calendar with the readings of each day."""
    t = open_warehouse(spark, sf_dir).table
    daily = t("fact_telemetry").groupBy("date_key").agg(F.count("*").alias("readings"))
    return staging.stage(t("dim_date"), "dim_date").join(daily, "date_key", "left").na.fill({"readings": 0})
