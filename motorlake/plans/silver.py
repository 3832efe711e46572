"""Cleaning: keep-latest, first failing rule, standardised survivors, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from motorlake import config
from motorlake.functions.text import blank, strip
from motorlake.operators.dedup import tag_kept

RULE = "_quarantine_rule"
REASON = "_quarantine_reason"
HIDDEN = ["_row_seq", "_row_uid"]


def _number(df: DataFrame, name: str, kind: str) -> Column:
    """The value as a number, null when it cannot be one.

    Whole-number readings given as fractions are cut towards zero, as an int conversion does;
    text must already be a whole number.
    """
    return F.col(name).try_cast(kind)


def _outside(value: Column, low: float, high: float) -> Column:
    # NaN sorts above every number, so it fails the upper bound.
    return ~((value >= low) & (value <= high))


def rules(df: DataFrame, dataset: str, snapshot_date: str) -> list[tuple[str, Column, Column | None]]:
    """(rule code, failing condition, offending value) in the order they are tried."""
    text = {f.name: F.col(f.name).cast("string") for f in df.schema.fields}

    def after(column: str) -> Column:
        return strip(F.coalesce(text[column], F.lit(""))) > F.lit(snapshot_date)

    if dataset == "telemetry":
        kinds = {"rpm": "int", "temperature": "double", "battery": "double", "vibration": "double"}
        values = {c: _number(df, c, k) for c, k in kinds.items()}
        unreadable = F.lit(False)
        for v in values.values():
            unreadable = unreadable | v.isNull()
        codes = {"rpm": "RPM", "temperature": "TEMP", "battery": "BATTERY", "vibration": "VIB"}
        return [
            ("RULE_TEL_PK_NOT_NULL", blank("vehicle_id") | F.col("timestamp").isNull(), None),
            ("RULE_TEL_TYPE_ERROR", unreadable, None),
        ] + [
            (f"RULE_TEL_{code}_RANGE", _outside(values[c], *config.TELEMETRY_BOUNDS[c]), values[c])
            for c, code in codes.items()
        ]
    if dataset == "diagnostics":
        code = strip(F.coalesce(text["code"], F.lit("")))
        severity = F.upper(strip(F.coalesce(text["severity"], F.lit(""))))
        return [
            ("RULE_DTC_PK_NOT_NULL", blank("vehicle_id") | F.col("timestamp").isNull() | blank("code"), None),
            ("RULE_DTC_CODE_REGEX", ~code.rlike(config.DTC_PATTERN), code),
            ("RULE_DTC_SEVERITY", ~severity.isin(*config.SEVERITIES), text["severity"]),
        ]
    if dataset == "vehicles":
        return [
            ("RULE_VEH_NOT_NULL", blank("vehicle_id") | blank("model") | blank("dealer_id"), None),
            ("RULE_VEH_DATE_RANGE", after("manufacture_date"), text["manufacture_date"]),
        ]
    if dataset == "service":
        cost = _number(df, "cost", "double")
        return [
            ("RULE_SRV_TYPE_ERROR", cost.isNull(), None),
            ("RULE_SRV_PK_NOT_NULL", blank("service_id") | blank("vehicle_id"), None),
            ("RULE_SRV_COST_RANGE", cost < 0, F.format_string("%.2f", cost)),
            ("RULE_SRV_DATE_VALID", after("visit_date"), text["visit_date"]),
        ]
    if dataset == "warranty":
        amount = _number(df, "amount", "double")
        return [
            ("RULE_WRN_TYPE_ERROR", amount.isNull(), None),
            ("RULE_WRN_PK_NOT_NULL", blank("claim_id") | blank("vehicle_id"), None),
            ("RULE_WRN_AMOUNT_POS", amount <= 0, F.format_string("%.2f", amount)),
            ("RULE_WRN_DATE_VALID", after("claim_date"), text["claim_date"]),
        ]
    if dataset == "parts":
        stock, lead = _number(df, "stock", "int"), _number(df, "lead_time", "int")
        return [
            ("RULE_PRT_TYPE_ERROR", stock.isNull() | lead.isNull(), None),
            ("RULE_PRT_PK_NOT_NULL", blank("part_id") | blank("dealer_id"), None),
            ("RULE_PRT_STOCK_RANGE", stock < 0, stock),
            ("RULE_PRT_LEAD_RANGE", lead < 1, lead),
        ]
    single = {
        "dealers": ("RULE_DLR_NOT_NULL", ["dealer_id"]),
        "components": ("RULE_CMP_NOT_NULL", ["part_id"]),
        "customers": ("RULE_CUST_NOT_NULL", ["customer_id"]),
        "vehicle_customer_map": ("RULE_VCM_NOT_NULL", ["vehicle_id", "customer_id"]),
    }
    code, columns = single[dataset]
    missing = F.lit(False)
    for c in columns:
        missing = missing | blank(c)
    return [(code, missing, None)]


def validate(df: DataFrame, dataset: str, snapshot_date: str) -> DataFrame:
    """Add the first failing rule and its reason; both null for a valid row."""
    rule, reason = None, None
    for code, failing, value in rules(df, dataset, snapshot_date):
        template = config.REASONS[code]
        said = F.lit(template)
        if value is not None:
            head, tail = template.split("%s")
            said = F.concat(F.lit(head), F.coalesce(value.cast("string"), F.lit("None")), F.lit(tail))
        rule = F.when(failing, code) if rule is None else rule.when(failing, code)
        reason = F.when(failing, said) if reason is None else reason.when(failing, said)
    return df.withColumns({RULE: rule, REASON: reason})


def tag_rows(
    df: DataFrame,
    dataset: str,
    snapshot_date: str,
    uid: list[str],
    order: list[Column] | None = None,
) -> DataFrame:
    """Every input row once, tagged with the rule that rejects it (null: clean).

    Copies other than the latest are DUPLICATE_KEY whatever their values.
    """
    keys = config.BUSINESS_KEYS[dataset]
    order = order or [F.coalesce(F.col("_ingested_at").cast("string"), F.lit("")), F.col("_row_seq")]
    checked = validate(tag_kept(df, keys, order, uid), dataset, snapshot_date)
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("None"))) for k in keys])
    head, tail = config.REASONS[config.DUPLICATE_RULE].split("%s")
    return checked.withColumns(
        {
            RULE: F.when(~F.col("_kept"), config.DUPLICATE_RULE).otherwise(F.col(RULE)),
            REASON: F.when(~F.col("_kept"), F.concat(F.lit(head), shown, F.lit(tail))).otherwise(F.col(REASON)),
        }
    ).drop("_kept")


def standardize(df: DataFrame, dataset: str) -> DataFrame:
    """Trim every text column; diagnostics severity becomes upper case."""
    changes = {
        f.name: strip(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    }
    if dataset == "diagnostics" and "severity" in df.columns:
        changes["severity"] = F.upper(strip(F.col("severity")))
    return df.withColumns(changes) if changes else df


def with_silver_lineage(df: DataFrame, batch_id: str, processed_at: str) -> DataFrame:
    return df.withColumnsRenamed(
        {"_ingested_at": "_bronze_ingested_at", "_batch_id": "_bronze_batch_id"}
    ).withColumns({"_silver_processed_at": F.lit(processed_at), "_silver_batch_id": F.lit(batch_id)})


def clean_rows(tagged: DataFrame, dataset: str, batch_id: str, processed_at: str) -> DataFrame:
    kept = tagged.where(F.col(RULE).isNull()).drop(RULE, REASON, *HIDDEN)
    return with_silver_lineage(standardize(kept, dataset), batch_id, processed_at)


def quarantine_rows(tagged: DataFrame, processed_at: str) -> DataFrame:
    return (
        tagged.where(F.col(RULE).isNotNull())
        .drop(*HIDDEN)
        .withColumn("_quarantined_at", F.lit(processed_at))
    )


def outcome(tagged: DataFrame, dataset: str) -> DataFrame:
    """One row: bronze, clean and quarantine counts and whether they add up."""
    return tagged.agg(
        F.lit(dataset).alias("dataset"),
        F.count("*").alias("bronze_count"),
        F.count_if(F.col(RULE).isNull()).alias("clean_count"),
        F.count_if(F.col(RULE).isNotNull()).alias("quarantine_count"),
    ).withColumn("conserved", F.col("bronze_count") == F.col("clean_count") + F.col("quarantine_count"))


def assert_conserved(bronze_rows: int, clean_count: int, quarantine_count: int, dataset: str) -> None:
    """Fail the batch when rows were lost or invented between input and the two outputs."""
    if clean_count + quarantine_count != bronze_rows:
        raise ValueError(
            f"rows not conserved for {dataset}: {bronze_rows} in, {clean_count} clean, {quarantine_count} rejected"
        )
