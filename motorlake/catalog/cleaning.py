"""Registered cleaning, validation and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlake import config
from motorlake.catalog.registry import query
from motorlake.catalog.sql import BLOCKS, DAY, STAMP, sql
from motorlake.operators import quality
from motorlake.operators.slots import non_increasing
from motorlake.plans import models, silver
from motorlake.plans.warehouse import PROCESSED_AT, SILVER_BATCH, TABLES, open_warehouse
from motorlake.sources.adapters import SETS, SNAPSHOT_DATE, raw_set, same_day_claims

UID = ["_source_file", "_row_uid"]


def tagged(spark, sf_dir, name):
    return silver.tag_rows(raw_set(spark, sf_dir, name), name, SNAPSHOT_DATE, UID)


@query(
    "b1_dedup_latest",
    sql("SELECT claim_id, vehicle_id, component, strftime(claim_date, '%Y-%m-%d') AS claim_date, cents / 100.0 AS amount FROM wrn_raw WHERE rn = 1"),
)
def b1(spark, sf_dir):
    """Latest copy of every claim."""
    from motorlake.operators.dedup import tag_kept

    df = tag_kept(
        raw_set(spark, sf_dir, "warranty"), ["claim_id"], [F.col("_ingested_at"), F.col("_row_seq")], UID
    )
    return df.where("_kept").select("claim_id", "vehicle_id", "component", "claim_date", "amount")


@query(
    "b2_duplicates_quarantined",
    sql("SELECT claim_id, count(*) AS superseded, sum(cents) / 100.0 AS amount FROM wrn_tag WHERE rule = 'DUPLICATE_KEY' GROUP BY 1"),
)
def b2(spark, sf_dir):
    """Superseded copies per claim."""
    lost = tagged(spark, sf_dir, "warranty").where(F.col(silver.RULE) == config.DUPLICATE_RULE)
    return lost.groupBy("claim_id").agg(F.count("*").alias("superseded"), F.sum("amount").alias("amount"))


_TAGGED = {
    "telemetry": ("tel_tag", f"vehicle_id, {STAMP.format('ts')} AS timestamp, rpm, CAST(temp AS DOUBLE) AS temperature, "
                  "bat10 / 10.0 AS battery, vib10 / 10.0 AS vibration"),
    "diagnostics": ("diag_tag", f"vehicle_id, {STAMP.format('ts')} AS timestamp, code, component, severity"),
    "vehicles": ("veh_tag", f"vehicle_id, model, variant, {DAY.format('made')} AS manufacture_date, dealer_id"),
    "service": ("srv_tag", f"service_id, vehicle_id, dealer_id, {DAY.format('visit_date')} AS visit_date, issue, cents / 100.0 AS cost"),
    "warranty": ("wrn_tag", f"claim_id, vehicle_id, component, {DAY.format('claim_date')} AS claim_date, cents / 100.0 AS amount"),
    "parts": ("prt_tag", f"part_id, dealer_id, stock, lead_time, {DAY.format('snapshot_date')} AS snapshot_date"),
    "dealers": ("dlr", "dealer_id, name, region, city, bays"),
    "components": ("cmp", "part_id, name, category, lifespan_km, base_cost, lead_time_days"),
    "customers": ("cus", "customer_id, customer_name, segment, region"),
    "vehicle_customer_map": ("own_raw", "vehicle_id, customer_id"),
}
_RULE = {
    "dealers": "''",
    "components": "''",
    "customers": "''",
    "vehicle_customer_map": "CASE WHEN trim(customer_id) = '' THEN 'RULE_VCM_NOT_NULL' ELSE '' END",
}


def _register_validation(name):
    block, columns = _TAGGED[name]
    rule = _RULE.get(name, "coalesce(rule, '')")

    @query(f"b3_validate_{name}", sql(f"SELECT {columns}, {rule} AS rule FROM {block}"))
    def run(spark, sf_dir):
        df = tagged(spark, sf_dir, name)
        keep = [c for c in df.columns if not c.startswith("_") and c != "registration_date"]
        return df.select(*keep, F.coalesce(F.col(silver.RULE), F.lit("")).alias("rule"))


for _name in _TAGGED:
    _register_validation(_name)


@query(
    "b3_reasons",
    sql("""SELECT rule, reason, count(*) AS n FROM (
SELECT rule, CASE rule
  WHEN 'RULE_TEL_RPM_RANGE' THEN 'RPM value ' || rpm || ' outside valid range [0, 9000]'
  WHEN 'RULE_TEL_TEMP_RANGE' THEN 'Temperature ' || CAST(CAST(temp AS DOUBLE) AS VARCHAR) || '°C outside valid range [-40.0, 160.0]'
  WHEN 'RULE_TEL_BATTERY_RANGE' THEN 'Battery voltage ' || CAST(bat10 / 10.0 AS VARCHAR) || 'V outside valid range [9.0, 16.0]'
  ELSE 'Vibration index ' || CAST(vib10 / 10.0 AS VARCHAR) || ' mm/s outside valid range [0.0, 15.0]' END AS reason
FROM tel_tag WHERE rule IS NOT NULL) GROUP BY 1, 2"""),
)
def b3_reasons(spark, sf_dir):
    """Rejected readings by rule and reason text."""
    bad = tagged(spark, sf_dir, "telemetry").where(F.col(silver.RULE).isNotNull())
    return bad.groupBy(F.col(silver.RULE).alias("rule"), F.col(silver.REASON).alias("reason")).agg(
        F.count("*").alias("n")
    )


@query(
    "b4_standardize",
    sql(f"SELECT vehicle_id, {STAMP.format('ts')} AS timestamp, code, component, severity FROM diag"),
)
def b4(spark, sf_dir):
    """Clean diagnostics with trimmed text and upper-case severity."""
    df = silver.clean_rows(tagged(spark, sf_dir, "diagnostics"), "diagnostics", SILVER_BATCH, PROCESSED_AT)
    return df.select("vehicle_id", "timestamp", "code", "component", "severity")


@query(
    "b5_silver_lineage",
    sql("""SELECT '2024-03-01 00:00:00' AS _bronze_ingested_at, 'BATCH-1' AS _bronze_batch_id,
'2024-03-02 00:00:00' AS _silver_processed_at, 'BATCH-SILVER-1' AS _silver_batch_id, 'orders.parquet' AS _source_file,
count(*) AS n FROM srv"""),
)
def b5(spark, sf_dir):
    """Lineage columns carried by clean rows."""
    df = silver.clean_rows(tagged(spark, sf_dir, "service"), "service", SILVER_BATCH, PROCESSED_AT)
    return df.groupBy(
        "_bronze_ingested_at", "_bronze_batch_id", "_silver_processed_at", "_silver_batch_id", "_source_file"
    ).agg(F.count("*").alias("n"))


def _report_sql():
    arms = []
    for name, (block, _) in _TAGGED.items():
        rule = _RULE.get(name, "coalesce(rule, '')")
        arms.append(
            f"SELECT '{name}' AS dataset, count(*) AS bronze_count, count(*) FILTER (WHERE {rule} = '') AS clean_count, "
            f"count(*) FILTER (WHERE {rule} <> '') AS quarantine_count, TRUE AS conserved FROM {block}"
        )
    return sql("\nUNION ALL ".join(arms))


@query(
    "b6_row_conservation",
    sql("""SELECT count(*) AS bronze_rows, count(*) FILTER (WHERE rule IS NULL) AS clean_rows,
count(*) FILTER (WHERE rule IS NOT NULL) AS quarantine_rows FROM wrn_tag"""),
)
def b6(spark, sf_dir):
    """Input rows against the rows of the two outputs, taken from each on its own."""
    raw = raw_set(spark, sf_dir, "warranty").agg(F.count("*").alias("bronze_rows"))
    t = tagged(spark, sf_dir, "warranty")
    clean = silver.clean_rows(t, "warranty", SILVER_BATCH, PROCESSED_AT).agg(F.count("*").alias("n")).scalar()
    bad = silver.quarantine_rows(t, PROCESSED_AT).agg(F.count("*").alias("n")).scalar()
    return raw.withColumns({"clean_rows": clean, "quarantine_rows": bad})


@query("b7_silver_report", _report_sql())
def b7(spark, sf_dir):
    """Per-set summary of one cleaning run over all ten sets."""
    rows = None
    for name in SETS:
        one = silver.outcome(tagged(spark, sf_dir, name), name)
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "b8_quarantine_by_rule",
    sql("\nUNION ALL ".join(
        f"SELECT '{n}' AS dataset, {_RULE.get(n, 'rule')} AS _quarantine_rule, count(*) AS rows FROM {b} WHERE coalesce({_RULE.get(n, 'rule')}, '') <> '' GROUP BY 1, 2"
        for n, (b, _) in _TAGGED.items()
    )),
)
def b8(spark, sf_dir):
    """Rejected rows per rule, over all ten sets."""
    rows = None
    for name in SETS:
        one = quality.by_rule(silver.quarantine_rows(tagged(spark, sf_dir, name), PROCESSED_AT)).select(
            F.lit(name).alias("dataset"), "_quarantine_rule", "rows"
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "b9_fact_bounds",
    sql("""SELECT count(*) FILTER (WHERE NOT rpm BETWEEN 0 AND 9000) AS rpm,
count(*) FILTER (WHERE NOT temp BETWEEN -40 AND 160) AS temperature,
count(*) FILTER (WHERE NOT bat10 BETWEEN 90 AND 160) AS battery,
count(*) FILTER (WHERE NOT vib10 BETWEEN 0 AND 150) AS vibration FROM tel_raw"""),
)
def b9(spark, sf_dir):
    """Violations of the physical limits in the raw readings."""
    return quality.out_of_bounds(raw_set(spark, sf_dir, "telemetry"), quality.telemetry_bounds())


@query("b10_unique", sql("SELECT claim_id, count(*) AS copies FROM wrn_raw GROUP BY 1 HAVING count(*) > 1"))
def b10_unique(spark, sf_dir):
    """Claim ids that occur more than once in the raw set."""
    return quality.duplicates(raw_set(spark, sf_dir, "warranty"), ["claim_id"])


@query(
    "b10_not_null",
    sql(f"SELECT vehicle_id, {STAMP.format('ts')} AS timestamp, code FROM diag_raw WHERE component IS NULL"),
)
def b10_not_null(spark, sf_dir):
    """Diagnostics naming no component."""
    return quality.nulls(raw_set(spark, sf_dir, "diagnostics"), "component").select("vehicle_id", "timestamp", "code")


@query(
    "b10_accepted_values",
    sql("SELECT severity, count(*) AS rows FROM diag_raw WHERE severity NOT IN ('LOW','MEDIUM','HIGH','CRITICAL') GROUP BY 1"),
)
def b10_accepted(spark, sf_dir):
    """Raw severities outside the accepted list."""
    return quality.not_accepted(raw_set(spark, sf_dir, "diagnostics"), "severity", config.SEVERITIES)


@query(
    "b10_relationships",
    sql("SELECT service_id, dealer_id FROM srv_raw WHERE dealer_id NOT IN (SELECT dealer_id FROM dlr)"),
)
def b10_relationships(spark, sf_dir):
    """Visits at dealers that are not in the dealer set."""
    return quality.orphans(
        raw_set(spark, sf_dir, "service"), "dealer_id", raw_set(spark, sf_dir, "dealers")
    ).select("service_id", "dealer_id")


@query(
    "b11_revenue_reconciles",
    sql("""SELECT CAST(sum(revenue_cents) AS BIGINT) / 100.0 AS mart_revenue, (SELECT CAST(sum(cents) AS BIGINT) FROM fs) / 100.0 AS fact_cost,
count(*) AS dealer_months FROM srv_month JOIN dim_dealer USING (dealer_key)"""),
)
def b11_revenue(spark, sf_dir):
    """The two totals of the revenue reconciliation."""
    w = open_warehouse(spark, sf_dir)
    service = w.table("fact_service")
    monthly = models.service_monthly(service).join(w.table("dim_dealer").select("dealer_key"), "dealer_key")
    total = service.agg(F.sum("cost").alias("x")).scalar()
    return monthly.agg(F.sum("total_service_revenue").alias("mart_revenue"), F.count("*").alias("dealer_months")).withColumn(
        "fact_cost", total
    )


@query(
    "b11_reconciliation_tests",
    sql("""SELECT 'revenue_matches' AS test_name, 0 AS failing_rows, (SELECT count(*) FROM srv) > 0 AS had_input
UNION ALL SELECT 'hours_logical', (SELECT count(*) FROM sess WHERE active < 0 OR active > 86400000000), (SELECT count(*) FROM tel) > 0
UNION ALL SELECT 'claims_positive', (SELECT count(*) FROM (SELECT sum(cents) AS c FROM fw GROUP BY component_key, date_key // 100) WHERE c <= 0), (SELECT count(*) FROM wrn) > 0
UNION ALL SELECT 'stock_non_negative', (SELECT count(*) FROM prt_month WHERE total_parts_stock < 0), (SELECT count(*) FROM prt) > 0"""),
)
def b11(spark, sf_dir):
    """Failing rows of each of the four reconciliation tests (zero is a pass)."""
    w = open_warehouse(spark, sf_dir)
    t = w.table
    summary = models.dealer_summary(models.dealer_rollup(t("fact_service"), t("fact_parts")), t("dim_dealer"))
    cost = models.warranty_cost(t("fact_warranty"), t("dim_component"))
    health = models.vehicle_health_daily(
        models.trip_sessions(t("fact_telemetry")), *[t(f"dim_{x}") for x in ("date", "vehicle", "model", "customer", "dealer")]
    )
    checks = {
        "revenue_matches": (models.revenue_mismatch(summary, t("fact_service")), "fact_service"),
        "hours_logical": (models.illogical_hours(health), "fact_telemetry"),
        "claims_positive": (models.non_positive_claims(cost), "fact_warranty"),
        "stock_non_negative": (models.negative_stock(summary), "fact_parts"),
    }
    rows = None
    for name, (failing, source) in checks.items():
        fed = t(source).agg((F.count("*") > 0).alias("x")).scalar()
        one = failing.agg(F.lit(name).alias("test_name"), F.count("*").alias("failing_rows")).withColumn("had_input", fed)
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "b12_orphan_keys",
    sql("""SELECT 'service.vehicle_id' AS reference, (SELECT count(*) FROM srv WHERE vehicle_id NOT IN (SELECT vehicle_id FROM veh)) AS orphans
UNION ALL SELECT 'telemetry.vehicle_id', (SELECT count(*) FROM tel WHERE vehicle_id NOT IN (SELECT vehicle_id FROM veh))
UNION ALL SELECT 'fact_telemetry.vehicle_key', (SELECT count(*) FROM ft WHERE vehicle_key NOT IN (SELECT vehicle_key FROM dim_vehicle))
UNION ALL SELECT 'fact_telemetry.date_key', (SELECT count(*) FROM ft WHERE date_key NOT IN (SELECT date_key FROM dim_date))
UNION ALL SELECT 'fact_warranty.component_key', (SELECT count(*) FROM fw WHERE component_key NOT IN (SELECT component_key FROM dim_component))
UNION ALL SELECT 'fact_parts.dealer_key', (SELECT count(*) FROM fp WHERE dealer_key NOT IN (SELECT dealer_key FROM dim_dealer))"""),
)
def b12(spark, sf_dir):
    """Orphan references: raw ids may be orphans, resolved keys never are."""
    t = open_warehouse(spark, sf_dir, "fact_telemetry", "fact_warranty", "fact_parts", "dim_date").table
    clean = {n: silver.clean_rows(tagged(spark, sf_dir, n), n, SILVER_BATCH, PROCESSED_AT) for n in ("service", "telemetry", "vehicles")}
    checks = {
        "service.vehicle_id": quality.orphans(clean["service"], "vehicle_id", clean["vehicles"]),
        "telemetry.vehicle_id": quality.orphans(clean["telemetry"], "vehicle_id", clean["vehicles"]),
        "fact_telemetry.vehicle_key": quality.orphans(t("fact_telemetry"), "vehicle_key", t("dim_vehicle")),
        "fact_telemetry.date_key": quality.orphans(t("fact_telemetry"), "date_key", t("dim_date")),
        "fact_warranty.component_key": quality.orphans(t("fact_warranty"), "component_key", t("dim_component")),
        "fact_parts.dealer_key": quality.orphans(t("fact_parts"), "dealer_key", t("dim_dealer")),
    }
    rows = None
    for name, lost in checks.items():
        one = lost.agg(F.lit(name).alias("reference"), F.count("*").alias("orphans"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "b13_freshness",
    sql("""SELECT max(date_key) AS latest_key, count(*) AS rows,
date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-20') AS lag_days, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-20') <= 30 AS met FROM ft"""),
)
def b13(spark, sf_dir):
    """Latest reading, row count and lag."""
    return quality.freshness(open_warehouse(spark, sf_dir).table("fact_telemetry"), "date_key", SNAPSHOT_DATE, 30)


@query("b14_quarantine_volume", sql("SELECT count(*) AS rows, TRUE AS has_files FROM prt_tag WHERE rule IS NOT NULL"))
def b14(spark, sf_dir):
    """Rows and files in a written quarantine folder."""
    from motorlake.session import scratch_path
    from motorlake.sources.lake import write_quarantine

    path = scratch_path(spark, "quarantine")
    write_quarantine(silver.quarantine_rows(tagged(spark, sf_dir, "parts"), PROCESSED_AT), path)
    volume = quality.quarantine_volume(spark, path)
    return volume.select("rows", (F.col("files") > 0).alias("has_files"))


@query(
    "b15_layer_reconciliation",
    sql("\nUNION ALL ".join(
        f"SELECT '{f}' AS check_name, (SELECT count(*) FROM {s}) AS left_rows, (SELECT count(*) FROM {f_}) AS right_rows, TRUE AS equal"
        for f, s, f_ in (("fact_telemetry", "tel", "ft"), ("fact_service", "srv", "fs"), ("fact_warranty", "wrn", "fw"), ("fact_parts", "prt", "fp"), ("silver_diagnostics", "diag", "bridge"))
    )),
)
def b15(spark, sf_dir):
    """Clean rows against loaded fact rows."""
    t = open_warehouse(spark, sf_dir, "fact_telemetry", "fact_service", "fact_warranty", "fact_parts", "silver_diagnostics").table
    rows = None
    for name in ("telemetry", "service", "warranty", "parts"):
        clean = silver.clean_rows(tagged(spark, sf_dir, name), name, SILVER_BATCH, PROCESSED_AT)
        one = quality.reconcile(clean, t(f"fact_{name}"), f"fact_{name}")
        rows = one if rows is None else rows.unionByName(one)
    clean = silver.clean_rows(tagged(spark, sf_dir, "diagnostics"), "diagnostics", SILVER_BATCH, PROCESSED_AT)
    return rows.unionByName(quality.reconcile(clean, t("silver_diagnostics"), "silver_diagnostics"))


@query(
    "b16_monotonic_timestamps",
    sql("""SELECT order_line, l_partkey AS part, previous, shipped FROM (
SELECT l_orderkey AS order_line, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS shipped,
strftime(lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), '%Y-%m-%d') AS previous FROM lineitem)
WHERE shipped <= previous"""),
)
def b16(spark, sf_dir):
    """Lines not shipped later than the line before them in the order."""
    from motorlake.sources.adapters import table

    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position")
    )
    late = non_increasing(li, "l_orderkey", "l_shipdate", "position", F.col("position.l_linenumber"))
    return late.select(
        F.col("l_orderkey").alias("order_line"), F.col("l_partkey").alias("part"),
        F.col("previous").cast("date").alias("previous"), F.col("l_shipdate").cast("date").alias("shipped"),
    )


@query(
    "b16_reading_order",
    sql("""SELECT count(*) AS out_of_order FROM (
SELECT ts, lag(ts) OVER (PARTITION BY vehicle_id ORDER BY seq) AS p FROM tel_raw) WHERE ts <= p"""),
)
def b16_readings(spark, sf_dir):
    """Readings not later than the previous reading of the vehicle in arrival order."""
    return non_increasing(raw_set(spark, sf_dir, "telemetry"), "vehicle_id", "timestamp", "_row_seq").agg(
        F.count("*").alias("out_of_order")
    )


@query(
    "b17_unsupported_diagnostics",
    sql(f"""SELECT d.vehicle_id, {STAMP.format('d.ts')} AS timestamp, d.code,
CASE WHEN t.vehicle_id IS NULL THEN 'NO_READING' ELSE 'NOT_SHOWN' END AS problem
FROM diag d LEFT JOIN tel t ON d.vehicle_id = t.vehicle_id AND d.ts = t.ts
WHERE t.vehicle_id IS NULL OR NOT CASE WHEN code IN ('P0217','P0420') THEN temp >= 55
  WHEN code IN ('P0562','B0001','U0100') THEN bat10 <= 116 WHEN code IN ('P0300','C0035','C0561') THEN vib10 >= 42 ELSE TRUE END"""),
)
def b17(spark, sf_dir):
    """Diagnostics that no reading at that moment supports."""
    clean = {n: silver.clean_rows(tagged(spark, sf_dir, n), n, SILVER_BATCH, PROCESSED_AT) for n in ("diagnostics", "telemetry")}
    return quality.unsupported_diagnostics(clean["diagnostics"], clean["telemetry"]).select(
        "vehicle_id", "timestamp", "code", "problem"
    )


@query(
    "b18_unsupported_claims",
    sql(f"""SELECT claim_id, vehicle_id, component, {DAY.format('claim_date')} AS claim_date, cents / 100.0 AS amount
FROM same_day c WHERE NOT EXISTS (SELECT 1 FROM srv_raw s WHERE s.vehicle_id = c.vehicle_id AND s.visit_date = c.claim_date
AND s.cents > 35000 AND contains(s.issue, c.component) AND c.cents <= s.cents)""",
        same_day="""SELECT 'CLM-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS claim_id, 'VH-' || o_custkey AS vehicle_id,
['Alternator', 'Coolant', 'brake rotor'][l_linenumber % 3 + 1] AS component,
DATE '2023-11-01' + CAST(l_orderkey % 120 AS INT) AS claim_date, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"""),
)
def b18(spark, sf_dir):
    """Claims without a matching repair visit."""
    return quality.unsupported_claims(same_day_claims(spark, sf_dir), raw_set(spark, sf_dir, "service"))


@query(
    "b19_profile",
    sql(f"""SELECT count(*) AS rows, 0 AS nulls_service_id, 0 AS nulls_vehicle_id, 0 AS nulls_dealer_id, 0 AS nulls_visit_date,
0 AS nulls_issue, 0 AS nulls_cost, {DAY.format('min(visit_date)')} AS min_visit_date, {DAY.format('max(visit_date)')} AS max_visit_date,
printf('%.2f', min(cents) / 100.0) AS min_cost, printf('%.2f', max(cents) / 100.0) AS max_cost, count(DISTINCT service_id) AS distinct_keys FROM srv_raw"""),
)
def b19(spark, sf_dir):
    """Nulls, key uniqueness and ranges of the visits."""
    df = raw_set(spark, sf_dir, "service")
    return quality.profile(df.select(*[c for c in df.columns if not c.startswith("_")]), ["service_id"], ["visit_date", "cost"])
