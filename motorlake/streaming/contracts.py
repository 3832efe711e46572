"""Event contracts as columns: the same functions serve batch frames and streams.

Input rows hold a JSON text ``value`` plus key, topic, partition and offset.  Output rows
add the typed business fields and ``_reject``, null where the event meets its contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from motorlake import config
from motorlake.functions.text import strip

_ORIGIN = ["value", "key", "topic", "partition", "offset"]
_MS_LIMIT = 2e10  # fixed value: larger epoch numbers are milliseconds


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("_json", f"$.{name}", kind)


def _kind(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("_json", f"$.{name}", "variant"))


def _text(name: str) -> Column:
    """The field when it is JSON text; other JSON types are not turned into text."""
    return F.when(_kind(name) == "STRING", _field(name, "string"))


def _moment(name: str) -> Column:
    """ISO text, with or without zone, or epoch seconds or milliseconds; UTC."""
    number = _field(name, "double")
    seconds = F.when(F.abs(number) > _MS_LIMIT, number / 1000).otherwise(number)
    epoch = F.when(_kind(name).isin("BIGINT", "DOUBLE") | _kind(name).startswith("DECIMAL"), F.timestamp_seconds(seconds))
    return F.coalesce(_text(name).try_cast("timestamp"), epoch).cast("timestamp_ntz")


def _check(df: DataFrame, typed: dict[str, Column], broken: dict[str, Column], allowed: list[str]) -> DataFrame:
    """Classify every message: unusable, unparseable, or listing the fields that break the contract."""
    parsed = df.withColumn("_json", F.try_parse_json("value"))
    known = F.array(*[F.lit(a) for a in allowed])
    extra = F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), known)
    fields = parsed.withColumns(typed)
    wrong = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in broken.items()]))
    listed = F.concat(wrong, extra)
    reject = (
        F.when(F.col("value").isNull(), "PROCESSING_ERROR: empty payload")
        .when(F.col("_json").isNull(), "CORRUPT_JSON: not parseable")
        .when(F.size(listed) > 0, F.concat(F.lit("VALIDATION_ERROR: "), F.array_join(listed, ", ")))
    )
    return fields.withColumn("_reject", reject).drop("_json")


def parse_telemetry(df: DataFrame) -> DataFrame:
    numbers = list(config.CONTRACT_TELEMETRY_BOUNDS)
    typed = {
        "vehicle_id": strip(_text("vehicle_id")),
        "event_time": _moment("timestamp"),
        **{c: _field(c, "double") for c in numbers},
    }
    broken = {
        "vehicle_id": F.col("vehicle_id") == "",
        "timestamp": F.col("event_time").isNull(),
        **{
            c: ~((F.col(c) >= low) & (F.col(c) <= high))
            for c, (low, high) in config.CONTRACT_TELEMETRY_BOUNDS.items()
        },
    }
    return _check(df, typed, broken, config.TELEMETRY_FIELDS + config.TRANSPORT_FIELDS)


def parse_diagnostics(df: DataFrame) -> DataFrame:
    """Code and severity become trimmed upper case; lengths are those of the text as sent."""
    short, long = config.CONTRACT_CODE_LENGTH
    typed = {
        "vehicle_id": strip(_text("vehicle_id")),
        "event_time": _moment("timestamp"),
        "_code_length": F.length(_text("code")),
        "code": F.upper(strip(_text("code"))),
        "component": _text("component"),
        "severity": F.upper(strip(_text("severity"))),
    }
    broken = {
        "vehicle_id": F.col("vehicle_id") == "",
        "timestamp": F.col("event_time").isNull(),
        "code": ~F.col("_code_length").between(short, long) | (F.col("code") == ""),
        "component": F.length("component") < 1,
        "severity": ~F.col("severity").isin(*config.CONTRACT_SEVERITIES),
    }
    checked = _check(df, typed, broken, config.DIAGNOSTIC_FIELDS + config.TRANSPORT_FIELDS)
    return checked.drop("_code_length")


PARSERS = {"telemetry": parse_telemetry, "diagnostics": parse_diagnostics}


def business_cols(parsed: DataFrame, kind: str) -> DataFrame:
    """Valid events with their business columns only."""
    names = config.TELEMETRY_FIELDS if kind == "telemetry" else config.DIAGNOSTIC_FIELDS
    columns = [F.col("event_time").alias("timestamp") if n == "timestamp" else F.col(n) for n in names]
    return parsed.where(F.col("_reject").isNull()).select(*columns)


def to_dlq(parsed: DataFrame, rejected_at: Column | None = None) -> DataFrame:
    """Rejected messages in their envelope, payload verbatim."""
    at = rejected_at if rejected_at is not None else F.current_timestamp()
    return parsed.where(F.col("_reject").isNotNull()).select(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("_dlq_timestamp"),
        F.col("_reject").alias("_dlq_reason"),
        F.col("topic").alias("_original_topic"),
        F.col("partition").alias("_original_partition"),
        F.col("offset").alias("_original_offset"),
        F.col("key").alias("_original_key"),
        F.col("value").alias("_raw_payload"),
        dlq_topic(F.col("topic")).alias("_dlq_topic"),
    )


def dlq_topic(topic: Column) -> Column:
    """Dead-letter topic by the name of the source topic."""
    return F.when(topic.contains("diagnostic"), config.DIAGNOSTICS_TOPIC + "-dlq").otherwise(
        config.TELEMETRY_TOPIC + "-dlq"
    )


def severe_events(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Severe codes straight from messages that may name their fields differently.

    The code may come as dtc_code or code, the severity as severity or diagnostic_severity
    (LOW when missing); an unreadable time becomes the processing time.
    """
    at = (now if now is not None else F.current_timestamp()).cast("timestamp_ntz")
    v = df.withColumn("_json", F.try_parse_json("value"))

    def said(*names: str) -> Column:
        return F.coalesce(*[F.nullif(_field(n, "string"), F.lit("")) for n in names])

    rows = v.select(
        said("vehicle_id").alias("vehicle_id"),
        F.coalesce(_moment("timestamp"), at).alias("timestamp"),
        said("dtc_code", "code").alias("code"),
        F.coalesce(said("severity", "diagnostic_severity"), F.lit("LOW")).alias("severity"),
        F.coalesce(said("description"), F.lit("")).alias("description"),
    )
    usable = rows.where(F.col("vehicle_id").isNotNull() & F.col("code").isNotNull())
    return usable.where(F.upper(F.trim("severity")).isin(*config.SEVERE))
