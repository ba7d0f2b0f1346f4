"""The stateless event transform, identical in batch and streaming.

No step shuffles. The clock is a parameter so that values can be tested; by default it
is the per-row wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contract import INPUT_EVENT, OUTPUT_EVENT
from tidemark.functions import records as R
from tidemark.functions.clock import wall_clock

OUTPUT_COLUMNS = tuple(OUTPUT_EVENT.fieldNames())

# Result of a missing or undecodable field under missing="default".
MISSING_DEFAULTS = {T.LongType: 0, T.DoubleType: 0.0, T.StringType: ""}


def _check_missing(missing: str) -> None:
    if missing not in ("null", "default"):
        raise ValueError(f"missing must be 'null' or 'default', not {missing!r}")


def _record(on_error: str, coerce: bool, value: Column | str = "value") -> Column:
    return R.decode_coerced(value, on_error=on_error) if coerce else R.decode(value, on_error=on_error)


def _fill_missing(df: DataFrame, missing: str) -> DataFrame:
    if missing == "null":
        return df
    filled = {f.name: F.coalesce(F.col(f.name), F.lit(MISSING_DEFAULTS[type(f.dataType)])) for f in INPUT_EVENT}
    return df.withColumns(filled)


def decode_events(raw: DataFrame, on_error: str = "null", missing: str = "null", coerce: bool = False) -> DataFrame:
    """Raw records (``value``) to typed columns; a bad record becomes a row of nulls."""
    _check_missing(missing)
    return _fill_missing(raw.select(_record(on_error, coerce).alias("e")).select("e.*"), missing)


def rejects(raw: DataFrame) -> DataFrame:
    """Side output: the records that do not decode cleanly, as received.

    A record counts as rejected if it is null, blank or not an object, or if a declared
    field holds a value of another type.
    """
    text = F.col("value").cast("string")
    entry = R.decode("value", keep_corrupt=True)
    return (
        raw.select(text.alias("value"), entry.alias("e"))
        .filter(F.col("e").isNull() | F.col(f"e.{R.CORRUPT}").isNotNull())
        .select("value", F.when(F.col("value").isNull(), "null")
                .when(F.col("e").isNull(), "blank").otherwise("undecodable").alias("reason"))
    )


def filter_purchase_intent(events: DataFrame) -> DataFrame:
    """Keep purchases and cart additions with a positive amount; nulls are dropped."""
    return events.filter(R.is_purchase_intent(F.col("event_type"), F.col("amount")))


def add_amount_with_tax(events: DataFrame, rounding: str = "decimal") -> DataFrame:
    if rounding == "decimal":
        return events.withColumn("amount_with_tax", R.amount_with_tax(F.col("amount")))
    if rounding == "scaled":
        return events.withColumn("amount_with_tax", R.amount_with_tax_scaled_round(F.col("amount")))
    raise ValueError(f"rounding must be 'decimal' or 'scaled', not {rounding!r}")


def upper_country(events: DataFrame) -> DataFrame:
    return events.withColumn("country", F.upper("country"))


def stamp_out_ts(events: DataFrame, clock: Column | None = None) -> DataFrame:
    return events.withColumn("out_ts", wall_clock() if clock is None else clock)


def carry_ts(events: DataFrame) -> DataFrame:
    """Output columns in contract order, ``ts`` unchanged."""
    return events.select(*OUTPUT_COLUMNS)


def encode_events(events: DataFrame, keep_nulls: bool = False) -> DataFrame:
    return events.select(R.encode(OUTPUT_COLUMNS, keep_nulls).alias("value"))


def key_by_user(events: DataFrame, key_format: str = "string") -> DataFrame:
    return events.withColumn("key", R.user_key("user_id", key_format))


def pad_payload(events: DataFrame, payload_bytes: int) -> DataFrame:
    """Filler column that inflates each encoded record; decoders ignore it."""
    if payload_bytes < 0:
        raise ValueError("payload_bytes must not be negative")
    return events.withColumn("pad", F.repeat(F.lit("x"), F.lit(payload_bytes))) if payload_bytes else events


def enrich(events: DataFrame, clock: Column | None = None, rounding: str = "decimal") -> DataFrame:
    """Filtered events to output events: tax, country, stamp, column order."""
    taxed = add_amount_with_tax(events, rounding)
    return carry_ts(stamp_out_ts(upper_country(taxed), clock))


def _decoded_and_filtered(raw: DataFrame, on_error: str, missing: str, coerce: bool) -> DataFrame:
    """Decode and filter with one JSON parse per candidate record.

    A filter written after ``from_json`` is pushed below it and parses each record again
    for every field it reads. Here a record is a one-element array that is thinned out
    inside one projection: text without a wanted type goes first, unparsed, and what
    remains is parsed once. With ``on_error="fail"`` every record must be parsed, so the
    text is not looked at.
    """
    text = F.array(F.col("value").cast("string"))
    if on_error != "fail":
        text = F.filter(text, R.may_be_purchase_intent)
    records = F.transform(text, lambda value: _record(on_error, coerce, value))
    kept = F.filter(records, lambda e: R.is_purchase_intent(e["event_type"], e["amount"]))
    # Defaults cannot turn a dropped record into a kept one: "" and 0.0 both fail the filter.
    return _fill_missing(raw.select(F.inline(kept)), missing)


def transform_decoded(raw: DataFrame, clock: Column | None = None, on_error: str = "null", missing: str = "null",
                      coerce: bool = False, rounding: str = "decimal") -> DataFrame:
    """The transform up to, and without, encoding: raw records to output columns."""
    _check_missing(missing)
    return enrich(_decoded_and_filtered(raw, on_error, missing, coerce), clock, rounding)


def transform_events(raw: DataFrame, clock: Column | None = None, on_error: str = "null", missing: str = "null",
                     coerce: bool = False, rounding: str = "decimal", key_format: str = "string",
                     keep_nulls: bool = False) -> DataFrame:
    """Raw records to keyed output records: the whole transform as one narrow query."""
    events = transform_decoded(raw, clock, on_error, missing, coerce, rounding)
    return events.select(
        R.user_key("user_id", key_format).alias("key"),
        R.encode(OUTPUT_COLUMNS, keep_nulls).alias("value"),
    )


COUNTS = ("received", "decoded", "rejected_null", "rejected_blank", "rejected_undecodable", "passed")


def transform_counted(raw: DataFrame, counts: Observation | str, clock: Column | None = None, rounding: str = "decimal",
                      key_format: str = "string", keep_nulls: bool = False) -> DataFrame:
    """``transform_events`` that counts what it does in the same pass over the records.

    ``counts`` is an ``Observation`` for a batch, or a name under which a stream's progress reports (see
    ``execute.observed_counts``). Counted are the records received, decoded cleanly, rejected by reason (as
    ``rejects`` tells them apart) and passed on. A rejected record may pass: one with a bad optional field is
    kept. Every record is parsed once; the look at the undecoded text, which spares ``transform_events`` most
    of the parsing, is not taken. Spark evaluates the counts once per finished job or batch; a job that is
    run again counts again.
    """
    text = F.col("value").cast("string")
    missing = F.col("value").isNull()

    def judged(e: Column) -> Column:
        reason = F.when(missing, "null").when(e.isNull(), "blank").when(e[R.CORRUPT].isNotNull(), "undecodable")
        passed = F.coalesce(R.is_purchase_intent(e["event_type"], e["amount"]), F.lit(False))
        return F.struct(reason.alias("__reason"), passed.alias("__passed"), *[e[f].alias(f) for f in INPUT_EVENT.fieldNames()])

    # One-element array, as in the transform: one JSON parse per record.
    records = raw.select(F.inline(F.transform(F.array(R.decode(text, keep_corrupt=True)), judged)))
    reason = F.col("__reason")
    figures = [F.count("*"), F.count_if(reason.isNull()), *[F.count_if(reason == r) for r in ("null", "blank", "undecodable")], F.count_if(F.col("__passed"))]
    observed = records.observe(counts, *[f.alias(n) for f, n in zip(figures, COUNTS)])
    events = enrich(observed.filter("__passed").drop("__reason", "__passed"), clock, rounding)
    return events.select(R.user_key("user_id", key_format).alias("key"), R.encode(OUTPUT_COLUMNS, keep_nulls).alias("value"))


def transform_events_sql(spark: SparkSession, view: str, out_ts: str | None = None) -> DataFrame:
    """The same transform as SQL text over a view with a ``value`` column."""
    stamp = out_ts or "CAST(reflect('java.lang.System', 'currentTimeMillis') AS DOUBLE) / 1000D"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INPUT_EVENT)
    return spark.sql(f"""
        WITH decoded AS (
          SELECT inline(filter(transform(
              filter(array(CAST(value AS STRING)),
                     v -> contains(v, 'purchase') OR contains(v, 'add_to_cart') OR contains(v, '\\\\')),
              v -> from_json(v, '{schema}')),
            e -> e.event_type IN ('purchase', 'add_to_cart') AND e.amount > 0))
          FROM {view}
        ), enriched AS (
          SELECT event_id, user_id, event_type, upper(country) AS country, amount,
                 round(amount * 1.21D, 2) AS amount_with_tax, ts, {stamp} AS out_ts
          FROM decoded
        )
        SELECT CAST(user_id AS STRING) AS key,
               to_json(named_struct('event_id', event_id, 'user_id', user_id, 'event_type', event_type,
                 'country', country, 'amount', amount, 'amount_with_tax', amount_with_tax,
                 'ts', ts, 'out_ts', out_ts)) AS value
        FROM enriched
    """)
