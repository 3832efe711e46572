"""SQL blocks that grow and apply the isolation forest: the draws are md5 values, so both engines grow the same trees."""

from __future__ import annotations

from motorlake import config
from motorlake.catalog.sql import BLOCKS

LEVELS = 8  # log2 of the sample


def _unit(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def add_forest(name: str, features: int, trees: int = config.N_TREES, sample: int = config.IFOREST_SAMPLE, seed: int = config.SEED) -> None:
    """Blocks ``<name>_nodes`` and ``<name>_scored``.

    Given: ``<name>_train`` (uid, x) and ``<name>_all`` (uid, x), x being the list of features.
    """
    n = name
    BLOCKS[f"{n}_size"] = f"""
SELECT n, size, greatest(1, CAST(ceil(log2(greatest(2, size))) AS BIGINT)) AS depth_limit,
CASE WHEN size > 2 THEN 2 * (ln(size - 1.0) + 0.5772156649015329) - 2 * (size - 1.0) / size WHEN size = 2 THEN 1.0 ELSE 0.0 END AS norm
FROM (SELECT count(*) AS n, least({sample}, count(*)) AS size FROM {n}_train)"""
    BLOCKS[f"{n}_pool"] = f"""
SELECT uid, x FROM (SELECT uid, x, row_number() OVER (ORDER BY md5('{seed}:' || uid), uid) AS rn FROM {n}_train) WHERE rn <= {trees * sample}"""
    BLOCKS[f"{n}_l0"] = f"""
SELECT tree, uid, x, CAST(1 AS BIGINT) AS heap FROM (
  SELECT tree, uid, x, row_number() OVER (PARTITION BY tree ORDER BY md5('{seed}:' || tree || ':' || uid), uid) AS rn
  FROM {n}_pool, (SELECT unnest(range({trees})) AS tree)) WHERE rn <= {sample}"""
    low = ", ".join(f"min(x[{k}])" for k in range(1, features + 1))
    high = ", ".join(f"max(x[{k}])" for k in range(1, features + 1))
    key = f"'{seed}:' || tree || ':' || heap || "
    for d in range(LEVELS + 1):
        feature, cut = key + "':feature'", key + "':cut'"
        BLOCKS[f"{n}_n{d}"] = f"""
SELECT tree, heap, size, {d} AS depth, f, low[f] + (high[f] - low[f]) * {_unit(cut)} AS cut FROM (
  SELECT *, CASE WHEN size > 1 AND len(varying) > 0 AND {d} < (SELECT depth_limit FROM {n}_size)
                 THEN varying[1 + CAST(floor({_unit(feature)} * len(varying)) AS BIGINT)] END AS f
  FROM (SELECT *, [k FOR k IN range(1, {features + 1}) IF high[k] > low[k]] AS varying
        FROM (SELECT tree, heap, count(*) AS size, [{low}] AS low, [{high}] AS high FROM {n}_l{d} GROUP BY tree, heap)))"""
        BLOCKS[f"{n}_l{d + 1}"] = f"""
SELECT tree, uid, x, 2 * heap + CASE WHEN x[f] <= cut THEN 0 ELSE 1 END AS heap FROM {n}_l{d} JOIN {n}_n{d} USING (tree, heap) WHERE f IS NOT NULL"""
    every = "\nUNION ALL ".join(f"SELECT * FROM {n}_n{d}" for d in range(LEVELS + 1))
    BLOCKS[f"{n}_nodes"] = f"""
SELECT *, CAST(round(1e9 * (depth + CASE WHEN size > 2 THEN 2 * (ln(size - 1.0) + 0.5772156649015329) - 2 * (size - 1.0) / size WHEN size = 2 THEN 1.0 ELSE 0.0 END)) AS BIGINT) AS path
FROM ({every})"""
    BLOCKS[f"{n}_w0"] = f"SELECT uid, x, tree, CAST(1 AS BIGINT) AS heap FROM {n}_all, (SELECT unnest(range({trees})) AS tree)"
    for d in range(LEVELS):
        BLOCKS[f"{n}_w{d + 1}"] = f"""
SELECT uid, x, tree, CASE WHEN f IS NULL THEN heap WHEN x[f] <= cut THEN 2 * heap ELSE 2 * heap + 1 END AS heap FROM {n}_w{d} JOIN {n}_nodes USING (tree, heap)"""
    BLOCKS[f"{n}_raw"] = f"""
SELECT uid, -pow(2.0, -(sum(path) / 1e9 / {float(trees)}) / (SELECT norm FROM {n}_size)) AS raw FROM {n}_w{LEVELS} JOIN {n}_nodes USING (tree, heap) GROUP BY uid"""
    BLOCKS[f"{n}_span"] = f"SELECT min(raw) AS lo, max(raw) AS hi FROM {n}_raw JOIN {n}_train USING (uid)"
    BLOCKS[f"{n}_scored"] = f"""
SELECT uid, raw, greatest(0.0, least(1.0, (hi - raw) / CASE WHEN hi - lo > 1e-9 THEN hi - lo ELSE 1.0 END)) AS score FROM {n}_raw, (SELECT * FROM {n}_span)"""


_Q = "(SELECT quantile_cont({0}, {1}) FROM tel_v)"


def _scaled(value: str) -> str:
    return f"({value} - {_Q.format(value, 0.5)}) / ({_Q.format(value, 0.75)} - {_Q.format(value, 0.25)} + 1e-5)"


_RPM, _TEMP, _VIB = "CAST(rpm AS DOUBLE)", "CAST(temp AS DOUBLE)", "vib10 / 10.0"
BLOCKS["sensor_rows"] = f"""
SELECT vehicle_id, ts, is_fault_window, rpm, temp, vib10, vehicle_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS uid,
[{_RPM}, {_TEMP}, bat10 / 10.0, {_VIB}, {_scaled(_RPM)}, {_scaled(_TEMP)}, {_scaled(_VIB)}, vib10 / 10.0 / (rpm + 1.0)] AS x FROM near_fault"""
BLOCKS["sensor_nominal"] = """
SELECT *, CASE WHEN rn <= floor(n * 0.70 + 1e-9) THEN 0 WHEN rn <= floor(n * 0.85 + 1e-9) THEN 1 ELSE 2 END AS split
FROM (SELECT *, row_number() OVER (ORDER BY ts, uid) AS rn, count(*) OVER () AS n FROM sensor_rows WHERE NOT is_fault_window)"""
BLOCKS["sensor_train"] = "SELECT uid, x FROM sensor_nominal WHERE split = 0"
#: The stream has its own, fixed scaling; its events are told by their number.
BLOCKS["sensor_stream"] = """
SELECT *, 'e' || seq AS uid, [CAST(rpm AS DOUBLE), CAST(temp AS DOUBLE), bat10 / 10.0, vib10 / 10.0, (rpm - {}) / {}, (temp - {}) / {},
(vib10 / 10.0 - {}) / {}, vib10 / 10.0 / (rpm + 1.0)] AS x FROM tel_raw""".format(*[v for c in ("rpm", "temperature", "vibration") for v in config.STREAM_CENTRES[c]])
BLOCKS["sensor_all"] = "SELECT uid, x FROM sensor_rows UNION ALL SELECT uid, x FROM sensor_stream"
add_forest("sensor", 8)
BLOCKS["sensor_limit"] = f"""
SELECT quantile_cont(score, {config.CALIBRATION_PERCENTILE / 100.0}) AS threshold FROM sensor_nominal JOIN sensor_scored USING (uid) WHERE split = 1"""

BLOCKS["claim_train"] = "SELECT claim_id AS uid, [CAST(claim_amount AS DOUBLE), median_ratio, iqr_distance, CAST(vehicle_claims AS DOUBLE)] AS x FROM cfeat"
BLOCKS["claim_all"] = "SELECT uid, x FROM claim_train"
add_forest("claim", 4)
