"""Building blocks of the check SQL, written independently of the Spark code.

Every block is one CTE.  ``sql(body)`` finds the blocks a statement names and puts them,
with what they need in turn, in front of it.
"""

from __future__ import annotations

import re

DAY = "strftime({}, '%Y-%m-%d')"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def ratio(numerator: str, denominator: str, digits: int) -> str:
    """Half away from zero, on integers; ``numerator`` must already be scaled by 10^digits."""
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return (
        f"(CAST(CASE WHEN {n} < 0 THEN -1 ELSE 1 END * ((2 * abs({n}) + {d}) // (2 * {d})) AS BIGINT)"
        f" / {float(10**digits)})"
    )


BLOCKS: dict[str, str] = {}


def _rules(arms: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{code}'" for code, c in arms) + " END"


BLOCKS["ev"] = """
SELECT event_id, ts, user_id, event_type, value,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events"""

# readings; hundredths and thousandths kept as integers
BLOCKS["tel_raw"] = """
SELECT 'VH-' || user_id AS vehicle_id, ts, CAST(floor(value * 30) AS BIGINT) AS rpm,
       20 + (event_id * 13) % 150 AS temp, 90 + k % 80 AS bat10, (event_id * 7) % 170 AS vib10,
       event_id AS seq
FROM ev"""
BLOCKS["tel_tag"] = f"""
SELECT *, {_rules([
    ('RULE_TEL_RPM_RANGE', 'rpm < 0 OR rpm > 9000'),
    ('RULE_TEL_TEMP_RANGE', 'temp < -40 OR temp > 160'),
    ('RULE_TEL_BATTERY_RANGE', 'bat10 < 90 OR bat10 > 160'),
    ('RULE_TEL_VIB_RANGE', 'vib10 < 0 OR vib10 > 150')])} AS rule
FROM tel_raw"""
BLOCKS["tel"] = "SELECT * FROM tel_tag WHERE rule IS NULL"

BLOCKS["diag_raw"] = """
SELECT 'VH-' || user_id AS vehicle_id, ts,
       CASE WHEN k = 99 THEN 'X999' ELSE
         ['P0217','P0562','P0300','C0035','P0420','B0001','U0100','C0561'][CAST(k % 8 AS INT) + 1] END AS code,
       CASE WHEN k % 5 = 0 THEN 'Electrical' ELSE ' ' || upper(p_name) || '-' || p_partkey END AS component,
       CASE WHEN k = 98 THEN 'INFO' ELSE ['CRITICAL',' high ','MEDIUM','low'][CAST(k % 4 AS INT) + 1] END AS severity,
       event_id AS seq
FROM ev LEFT JOIN part ON p_partkey = k * 2
WHERE event_type = 'error'"""
BLOCKS["diag_tag"] = f"""
SELECT *, {_rules([
    ('RULE_DTC_PK_NOT_NULL', "trim(vehicle_id) = '' OR trim(code) = ''"),
    ('RULE_DTC_CODE_REGEX', "NOT regexp_matches(trim(code), '^[PCBU][0-9]{4}$')"),
    ('RULE_DTC_SEVERITY', "upper(trim(severity)) NOT IN ('LOW','MEDIUM','HIGH','CRITICAL')")])} AS rule
FROM diag_raw"""
BLOCKS["diag"] = """
SELECT vehicle_id, ts, trim(code) AS code, trim(component) AS component, upper(trim(severity)) AS severity, seq
FROM diag_tag WHERE rule IS NULL"""

BLOCKS["veh_raw"] = """
SELECT 'VH-' || c_custkey AS vehicle_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Apex' WHEN 'BUILDING' THEN 'Titan' WHEN 'FURNITURE' THEN 'Pulse'
            WHEN 'HOUSEHOLD' THEN 'Horizon' ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS model,
       'V' || (c_custkey % 3) AS variant,
       DATE '2018-01-01' + CAST(c_custkey % 2500 AS INT) AS made, 'DLR-' || c_nationkey AS dealer_id
FROM customer WHERE c_acctbal >= 0"""
BLOCKS["veh_tag"] = """
SELECT *, CASE WHEN made > DATE '2024-02-20' THEN 'RULE_VEH_DATE_RANGE' END AS rule FROM veh_raw"""
BLOCKS["veh"] = "SELECT * FROM veh_tag WHERE rule IS NULL"

BLOCKS["dlr"] = """
SELECT 'DLR-' || s_suppkey AS dealer_id, s_name AS name, r_name AS region, n_name AS city, 5 + s_suppkey % 20 AS bays
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
BLOCKS["cmp"] = """
SELECT 'PRT-' || p_partkey AS part_id, p_name || '-' || p_partkey AS name, p_type AS category,
       p_size * 1000 AS lifespan_km, p_retailprice AS base_cost, 1 + p_size % 21 AS lead_time_days
FROM part"""
BLOCKS["cus"] = """
SELECT 'CUST-' || c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, r_name AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
BLOCKS["own_raw"] = """
SELECT 'VH-' || c_custkey AS vehicle_id,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ' ELSE 'CUST-' || c_custkey END AS customer_id
FROM customer"""
BLOCKS["own"] = "SELECT * FROM own_raw WHERE trim(customer_id) <> ''"

BLOCKS["srv_raw"] = """
SELECT 'SRV-' || o_orderkey AS service_id, 'VH-' || o_custkey AS vehicle_id, 'DLR-' || (o_orderkey % 110) AS dealer_id,
       DATE '2023-11-01' + CAST(o_orderkey % 120 AS INT) AS visit_date,
       CASE o_orderpriority
         WHEN '1-URGENT' THEN 'Alternator replacement due to charging failure'
         WHEN '2-HIGH' THEN 'Coolant leak repair and water pump replacement'
         WHEN '3-MEDIUM' THEN 'Scheduled routine maintenance and multi-point inspection'
         WHEN '4-NOT SPECIFIED' THEN 'Cabin filter and wiper check'
         WHEN '5-LOW' THEN 'Front brake rotor and pad replacement' ELSE 'Other' END AS issue,
       CAST(round(o_totalprice * 100) AS BIGINT) AS cents
FROM orders"""
BLOCKS["srv_tag"] = f"""
SELECT *, {_rules([
    ('RULE_SRV_COST_RANGE', 'cents < 0'),
    ('RULE_SRV_DATE_VALID', "visit_date > DATE '2024-02-20'")])} AS rule
FROM srv_raw"""
BLOCKS["srv"] = "SELECT * FROM srv_tag WHERE rule IS NULL"

BLOCKS["wrn_raw"] = """
SELECT 'CLM-' || l_orderkey || '-' || l_linenumber AS claim_id, 'VH-' || o_custkey AS vehicle_id,
       p_name || '-' || p_partkey AS component,
       DATE '2023-11-01' + CAST(l_orderkey % 120 + l_linenumber AS INT) AS claim_date,
       CASE WHEN l_discount = 0 AND l_tax = 0 THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                          ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R'"""
BLOCKS["wrn_tag"] = f"""
SELECT *, {_rules([
    ('DUPLICATE_KEY', 'rn > 1'),
    ('RULE_WRN_AMOUNT_POS', 'cents <= 0'),
    ('RULE_WRN_DATE_VALID', "claim_date > DATE '2024-02-20'")])} AS rule
FROM wrn_raw"""
BLOCKS["wrn"] = "SELECT * FROM wrn_tag WHERE rule IS NULL"

BLOCKS["prt_raw"] = """
SELECT 'PRT-' || l_partkey AS part_id, 'DLR-' || l_suppkey AS dealer_id,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) - 5 AS stock, max(l_linenumber) - 1 AS lead_time,
       DATE '2023-11-01' + CAST(min(l_orderkey) % 120 AS INT) AS snapshot_date
FROM lineitem GROUP BY l_partkey, l_suppkey"""
BLOCKS["prt_tag"] = f"""
SELECT *, {_rules([('RULE_PRT_STOCK_RANGE', 'stock < 0'), ('RULE_PRT_LEAD_RANGE', 'lead_time < 1')])} AS rule
FROM prt_raw"""
BLOCKS["prt"] = "SELECT * FROM prt_tag WHERE rule IS NULL"

# dimensions
BLOCKS["dim_model"] = """
SELECT -1 AS model_key, 'UNKNOWN MODEL' AS model_name, 'UNKNOWN' AS vehicle_class, 'UNKNOWN' AS powertrain_type
UNION ALL
SELECT row_number() OVER (ORDER BY model), model, 'UNKNOWN',
       CASE model WHEN 'Apex' THEN 'ICE-Gasoline' WHEN 'Titan' THEN 'Diesel' WHEN 'Pulse' THEN 'EV'
                  WHEN 'Horizon' THEN 'Hybrid' ELSE 'UNKNOWN' END
FROM (SELECT DISTINCT model FROM veh)"""
BLOCKS["dim_dealer"] = """
SELECT -1 AS dealer_key, 'UNKNOWN_DLR' AS dealer_id, 'UNKNOWN DEALER' AS dealer_name, 'UNKNOWN' AS city,
       'UNKNOWN' AS state, 'UNKNOWN' AS region, 'UNKNOWN' AS tier
UNION ALL
SELECT row_number() OVER (ORDER BY md5(dealer_id), dealer_id), dealer_id, name, city, 'UNKNOWN', region, 'UNKNOWN'
FROM dlr"""
BLOCKS["dim_customer"] = """
SELECT -1 AS customer_key, 'UNKNOWN_CUST' AS customer_id, 'UNKNOWN CUSTOMER' AS customer_name,
       'unknown@customers.local' AS email, '000-000-0000' AS phone, 'UNKNOWN' AS address, 'UNKNOWN' AS city,
       'UNKNOWN' AS state, CAST(NULL AS VARCHAR) AS created_at
UNION ALL
SELECT row_number() OVER (ORDER BY md5(customer_id), customer_id), customer_id, customer_name,
       lower(customer_id) || '@customers.local', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', region, '2024-03-02 00:00:00.000000'
FROM cus"""
BLOCKS["dim_component"] = """
SELECT -1 AS component_key, 'UNKNOWN COMPONENT' AS component_name, 'UNKNOWN' AS category,
       0 AS expected_lifespan_km, 0 AS warranty_period_months
UNION ALL
SELECT row_number() OVER (ORDER BY md5(name), name), name, category, lifespan_km, 0 FROM cmp"""
BLOCKS["dim_vehicle"] = """
SELECT -1 AS vehicle_key, 'UNKNOWN_VH' AS vehicle_id, -1 AS model_key, -1 AS customer_key, -1 AS selling_dealer_key,
       'UNKNOWN' AS variant, DATE '1900-01-01' AS manufacture_date, 1900 AS manufacture_year, 'UNKNOWN' AS status
UNION ALL
SELECT row_number() OVER (ORDER BY md5(v.vehicle_id), v.vehicle_id), v.vehicle_id, coalesce(m.model_key, -1),
       coalesce(c.customer_key, -1), coalesce(d.dealer_key, -1), v.variant, v.made, year(v.made), 'ACTIVE'
FROM veh v LEFT JOIN own o ON v.vehicle_id = o.vehicle_id
LEFT JOIN dim_model m ON v.model = m.model_name LEFT JOIN dim_dealer d ON v.dealer_id = d.dealer_id
LEFT JOIN dim_customer c ON o.customer_id = c.customer_id"""
BLOCKS["dim_date"] = """
SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(d AS DATE) AS calendar_date, isodow(d) AS day_of_week,
       dayname(d) AS day_name, day(d) AS day_of_month, dayofyear(d) AS day_of_year, weekofyear(d) AS week_of_year,
       month(d) AS month_number, monthname(d) AS month_name, quarter(d) AS quarter, year(d) AS year,
       isodow(d) >= 6 AS is_weekend
FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS d)
UNION ALL SELECT -1, DATE '1900-01-01', 1, 'Monday', 1, 1, 1, 1, 'January', 1, 1900, FALSE"""

# facts
BLOCKS["ft"] = """
SELECT coalesce(v.vehicle_key, -1) AS vehicle_key, CAST(strftime(ts, '%Y%m%d') AS INT) AS date_key,
       t.vehicle_id AS source_vehicle, ts, rpm, temp, bat10, vib10, seq
FROM tel t LEFT JOIN dim_vehicle v ON t.vehicle_id = v.vehicle_id"""
BLOCKS["fs"] = """
SELECT s.service_id, coalesce(v.vehicle_key, -1) AS vehicle_key, coalesce(d.dealer_key, -1) AS dealer_key,
       CAST(strftime(visit_date, '%Y%m%d') AS INT) AS date_key, visit_date, issue, cents
FROM srv s LEFT JOIN dim_vehicle v ON s.vehicle_id = v.vehicle_id LEFT JOIN dim_dealer d ON s.dealer_id = d.dealer_id"""
BLOCKS["fw"] = """
SELECT w.claim_id, coalesce(v.vehicle_key, -1) AS vehicle_key, coalesce(c.component_key, -1) AS component_key,
       CAST(strftime(claim_date, '%Y%m%d') AS INT) AS date_key, claim_date, cents
FROM wrn w LEFT JOIN dim_vehicle v ON w.vehicle_id = v.vehicle_id
LEFT JOIN dim_component c ON w.component = c.component_name"""
BLOCKS["fp"] = """
SELECT p.part_id, coalesce(d.dealer_key, -1) AS dealer_key, coalesce(c.component_key, -1) AS component_key,
       CAST(strftime(snapshot_date, '%Y%m%d') AS INT) AS date_key, snapshot_date, stock, lead_time
FROM prt p LEFT JOIN cmp x ON p.part_id = x.part_id LEFT JOIN dim_component c ON x.name = c.component_name
LEFT JOIN dim_dealer d ON p.dealer_id = d.dealer_id"""
BLOCKS["bridge"] = """
SELECT md5(vehicle_id || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
           CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END
           || '|' || code) AS diagnostic_id, vehicle_id, ts, code, component, severity
FROM diag"""

# models
BLOCKS["sess_deltas"] = """
SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY vehicle_key, date_key ORDER BY ts, seq)) AS d FROM ft"""


def sessions(gap: int, vib10: int, temp: int, low10: int, high10: int) -> str:
    return f"""
SELECT vehicle_key, date_key, count(*) AS pings,
       CAST(sum(CASE WHEN d > 0 AND d <= {gap * 1_000_000} AND rpm > 0 THEN d ELSE 0 END) AS BIGINT) AS active,
       sum(rpm) AS s_rpm, max(rpm) AS max_rpm, sum(temp) AS s_temp, max(temp) AS max_temp,
       sum(bat10) AS s_bat, min(bat10) AS min_bat, sum(vib10) AS s_vib, max(vib10) AS max_vib,
       count(*) FILTER (WHERE vib10 >= {vib10}) AS vib_alerts, count(*) FILTER (WHERE temp >= {temp}) AS temp_alerts,
       count(*) FILTER (WHERE bat10 < {low10} OR bat10 > {high10}) AS bat_alerts
FROM sess_deltas GROUP BY vehicle_key, date_key"""


BLOCKS["sess"] = sessions(300, 25, 105, 118, 150)
BLOCKS["sess_wide"] = sessions(21600, 150, 158, 95, 158)

SESSION_COLUMNS = f"""
pings AS total_telemetry_pings, {ratio('active', '360000', 0).replace('/ 1.0', '/ 10000.0')} AS daily_operating_hours,
{ratio('s_rpm * 100', 'pings', 2)} AS avg_rpm, max_rpm, {ratio('s_temp * 100', 'pings', 2)} AS avg_temperature,
CAST(max_temp AS DOUBLE) AS max_temperature, {ratio('s_bat * 10', 'pings', 2)} AS avg_battery_voltage,
min_bat / 10.0 AS min_battery_voltage, {ratio('s_vib * 100', 'pings', 3)} AS avg_vibration,
max_vib / 10.0 AS max_vibration, vib_alerts AS vibration_alert_count, temp_alerts AS temperature_alert_count,
bat_alerts AS battery_alert_count"""

BLOCKS["diag_resolved"] = """
SELECT b.*, coalesce(v.vehicle_key, -1) AS vehicle_key, coalesce(v.model_key, -1) AS model_key,
       coalesce(c.component_key, -1) AS component_key, CAST(strftime(ts, '%Y%m') AS INT) AS month_key
FROM bridge b LEFT JOIN dim_vehicle v ON b.vehicle_id = v.vehicle_id
LEFT JOIN dim_component c ON lower(trim(b.component)) = lower(trim(c.component_name))"""
BLOCKS["diag_month"] = """
SELECT component_key, model_key, month_key, count(*) AS total_dtc_count,
       count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_dtc_count,
       count(*) FILTER (WHERE severity = 'HIGH') AS high_dtc_count,
       count(DISTINCT vehicle_key) AS unique_vehicles_with_dtc
FROM diag_resolved GROUP BY ALL"""
BLOCKS["wrn_month"] = f"""
SELECT w.component_key, v.model_key, CAST(strftime(claim_date, '%Y%m') AS INT) AS month_key,
       count(*) AS warranty_claim_count, CAST(sum(cents) AS BIGINT) AS total_cents,
       {ratio('sum(cents)', 'count(*)', 2)} AS avg_warranty_claim_amount
FROM fw w JOIN dim_vehicle v ON w.vehicle_key = v.vehicle_key GROUP BY 1, 2, 3"""
BLOCKS["failures"] = """
SELECT component_key, model_key, month_key, coalesce(total_dtc_count, 0) AS total_dtc_count,
       coalesce(critical_dtc_count, 0) AS critical_dtc_count, coalesce(high_dtc_count, 0) AS high_dtc_count,
       coalesce(unique_vehicles_with_dtc, 0) AS unique_vehicles_with_dtc,
       coalesce(warranty_claim_count, 0) AS warranty_claim_count, coalesce(total_cents, 0) AS total_cents,
       coalesce(avg_warranty_claim_amount, 0.0) AS avg_warranty_claim_amount
FROM (SELECT component_key, model_key, month_key FROM diag_month UNION
      SELECT component_key, model_key, month_key FROM wrn_month)
LEFT JOIN diag_month USING (component_key, model_key, month_key)
LEFT JOIN wrn_month USING (component_key, model_key, month_key)"""
BLOCKS["srv_month"] = f"""
SELECT dealer_key, CAST(strftime(visit_date, '%Y%m') AS INT) AS month_key, count(*) AS total_service_invoices,
       CAST(sum(cents) AS BIGINT) AS revenue_cents, {ratio('sum(cents)', 'count(*)', 2)} AS avg_service_invoice_cost,
       count(DISTINCT vehicle_key) AS unique_vehicles_serviced
FROM fs GROUP BY 1, 2"""
BLOCKS["prt_month"] = f"""
SELECT dealer_key, CAST(strftime(snapshot_date, '%Y%m') AS INT) AS month_key,
       CAST(sum(stock) AS BIGINT) AS total_parts_stock, {ratio('sum(lead_time) * 100', 'count(*)', 2)} AS avg_parts_lead_time_days,
       count(*) FILTER (WHERE stock < 10) AS low_stock_sku_count, count(*) FILTER (WHERE stock = 0) AS out_of_stock_sku_count
FROM fp GROUP BY 1, 2"""
BLOCKS["rollup"] = """
SELECT dealer_key, month_key, coalesce(total_service_invoices, 0) AS total_service_invoices,
       coalesce(revenue_cents, 0) / 100.0 AS total_service_revenue,
       coalesce(avg_service_invoice_cost, 0.0) AS avg_service_invoice_cost,
       coalesce(unique_vehicles_serviced, 0) AS unique_vehicles_serviced,
       coalesce(total_parts_stock, 0) AS total_parts_stock,
       coalesce(avg_parts_lead_time_days, 0.0) AS avg_parts_lead_time_days,
       coalesce(low_stock_sku_count, 0) AS low_stock_sku_count, coalesce(out_of_stock_sku_count, 0) AS out_of_stock_sku_count
FROM (SELECT dealer_key, month_key FROM srv_month UNION SELECT dealer_key, month_key FROM prt_month)
LEFT JOIN srv_month USING (dealer_key, month_key) LEFT JOIN prt_month USING (dealer_key, month_key)"""


def sql(body: str, **extra: str) -> str:
    """The statement with the blocks it needs in front."""
    blocks = {**BLOCKS, **extra}
    order: list[str] = []

    def need(text: str, path: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*([a-z_][a-z_0-9]*)", text)):
            if word in blocks and word not in order and word not in path:
                need(blocks[word], (*path, word))
                order.append(word)

    need(body, ())
    if not order:
        return body
    head = ",\n".join(f"{name} AS ({blocks[name]})" for name in order)
    return f"WITH {head}\n{body}"
