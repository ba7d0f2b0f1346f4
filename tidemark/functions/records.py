"""Decode, predicate, derive, encode and key: the pieces of the event transform."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.contract import INPUT_EVENT, PURCHASE_INTENT, TAX_FACTOR

CORRUPT = "_corrupt_record"


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def decode(value: Column | str = "value", schema: T.StructType = INPUT_EVENT, on_error: str = "null",
           keep_corrupt: bool = False) -> Column:
    """JSON bytes or text to a struct; unknown fields are ignored.

    ``on_error="null"`` nulls what cannot be decoded, ``"fail"`` stops the query.
    ``keep_corrupt`` adds the original text of a record that did not decode cleanly.
    """
    if on_error not in ("null", "fail"):
        raise ValueError(f"on_error must be 'null' or 'fail', not {on_error!r}")
    # Spark prunes the schema to the fields in use only where no option is set.
    options = {"mode": "FAILFAST"} if on_error == "fail" else {}
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        options["columnNameOfCorruptRecord"] = CORRUPT
    return F.from_json(_text(value), schema, options)


def decode_coerced(value: Column | str = "value", schema: T.StructType = INPUT_EVENT,
                   on_error: str = "null") -> Column:
    """As ``decode``, but numbers written as text, and 1.0 for a long, are accepted."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = decode(value, texts, on_error)

    def typed(whole: Column) -> Column:
        fields = []
        for f in schema.fields:
            text = whole[f.name]
            if isinstance(f.dataType, T.LongType):
                # Through double only when needed: it is exact below 2**53 alone.
                number = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
            elif isinstance(f.dataType, T.DoubleType):
                number = text.try_cast("double")
            else:
                number = text
            fields.append(number.alias(f.name))
        return F.struct(*fields)

    # One-element array: the record is decoded once, not once per field.
    return F.transform(F.array(raw), typed)[0]


def is_purchase_intent(event_type: Column, amount: Column) -> Column:
    """The transform's predicate; null when a side is null, which a filter drops."""
    return event_type.isin(*PURCHASE_INTENT) & (amount > 0)


def may_be_purchase_intent(value: Column | str = "value") -> Column:
    """Cheap superset of the predicate on undecoded text.

    A JSON string equal to a wanted type either contains it literally or uses a backslash
    escape, so no passing record is lost.
    """
    text = _text(value)
    return reduce(lambda a, b: a | b, [text.contains(kind) for kind in (*PURCHASE_INTENT, "\\")])


def amount_with_tax(amount: Column) -> Column:
    """Tax-inclusive amount, half up on the decimal text of the product."""
    return F.round(amount * F.lit(TAX_FACTOR), 2)


def amount_with_tax_scaled_round(amount: Column) -> Column:
    """The other rounding dialect: scale, add a half, floor, scale back."""
    return F.floor(amount * F.lit(TAX_FACTOR) * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def encode(columns, keep_nulls: bool = False) -> Column:
    """Struct of the named columns as JSON text; nulls are left out unless kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if keep_nulls else "true"})


def user_key(user_id: Column | str = "user_id", key_format: str = "string") -> Column:
    """Record key: the user id as text, or as a one-field JSON object."""
    column = F.col(user_id) if isinstance(user_id, str) else user_id
    if key_format == "string":
        return column.cast("string")
    if key_format == "json":
        return F.to_json(F.struct(column.alias("user_id")), {"ignoreNullFields": "false"})
    raise ValueError(f"key_format must be 'string' or 'json', not {key_format!r}")
