"""Strict JSON decoding as Column expressions.

A record is parsed once into a variant, as the first element of an array:
trailing text and bare tokens such as NaN then fail, and a second document
shows up as one more element. The type of the parsed document is then tested once, as a whole. A
record that has the usual shape is read with one typed cast; only the others
are taken apart field by field, to find the fault or a field spelt in another
case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch import schemas

# The RFC 3339 timestamp form, and the wire form of "no time given".
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
ZERO_TIME = "0001-01-01T00:00:00Z"

_NAMES = schemas.TRANSACTION.fieldNames()
_NUMBER = r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)|VOID)"
_TEXT = "(STRING|VOID)"
# Type of a document with our fields only, any of them left out, keys in order.
USUAL_SHAPE = (
    "^OBJECT<"
    + "".join(f"({n}: {_NUMBER if n == 'amount' else _TEXT}(, |>$))?" for n in sorted(_NAMES))
    + "$"
)
_WIRE = "struct<" + ",".join(f"`{n}`:{'double' if n == 'amount' else 'string'}" for n in _NAMES) + ">"
_LOOSE = "struct<" + ",".join(f"`{n}`:variant" for n in _NAMES) + ">"


def _kind(variant: Column) -> Column:
    """JSON type of a variant; VOID for null and for an absent value."""
    return F.coalesce(F.regexp_replace(F.schema_of_variant(variant), "[(<].*$", ""), F.lit("VOID"))


def _any_case(doc: Column, name: str) -> Column:
    """The field under another spelling of its name."""
    entries = F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>"))
    return F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]


def _usual(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc).rlike(USUAL_SHAPE), F.lit(False))


def _typed(doc: Column) -> Column:
    return F.try_variant_get(doc, "$", _WIRE)


def _loosen(doc: Column) -> Column:
    """An odd document with one variant per field, exact name first."""
    exact = F.try_variant_get(doc, "$", _LOOSE)
    return F.struct(doc.alias("doc"), F.transform(F.array(exact), lambda e: _by_name(doc, e))[0].alias("loose"))


def _by_name(doc: Column, exact: Column) -> Column:
    return F.struct(*[F.coalesce(exact[n], _any_case(doc, n)).alias(n) for n in _NAMES])


def _odd_values(odd: Column) -> Column:
    """Values of an odd document, and the fault in its shape if there is one."""
    loose = odd["loose"]
    values = [
        F.try_variant_get(loose[n], "$", "double" if n == "amount" else "string").alias(n) for n in _NAMES
    ]
    return F.struct(_odd_cause(odd).alias("cause"), F.struct(*values).alias("values"))


def _odd_cause(odd: Column) -> Column:
    """Fault in the shape of an odd document. A null one is the zero transaction."""
    loose = odd["loose"]
    cause = F.when(~_kind(odd["doc"]).isin("OBJECT", "VOID"), F.lit("not a JSON object"))
    for name in schemas.TEXT_FIELDS:
        cause = cause.when(~_kind(loose[name]).isin("STRING", "VOID"), F.lit(f"{name} is not a string"))
    number = _kind(loose["amount"]).isin("BIGINT", "DOUBLE", "DECIMAL", "VOID")
    cause = cause.when(~number, F.lit("amount is not a number"))
    return cause.when(~_kind(loose["timestamp"]).isin("STRING", "VOID"), F.lit("timestamp is not RFC 3339"))


def _value_cause(values: Column) -> Column:
    """Fault in a typed value; null where there is none."""
    text = values["timestamp"]
    bad_time = text.isNotNull() & ~(text.rlike(RFC3339) & text.try_cast("timestamp").isNotNull())
    return F.when(F.abs(values["amount"]) == float("inf"), F.lit("amount is out of range")).when(
        bad_time, F.lit("timestamp is not RFC 3339")
    )


def _transaction(values: Column, default_time: Column) -> Column:
    """Typed fields; an absent field takes its zero value, an absent time the default."""
    out = []
    for field in schemas.TRANSACTION:
        got = values[field.name]
        if field.name == "timestamp":
            given = F.when(got != ZERO_TIME, got.try_cast("timestamp"))
            out.append(F.coalesce(given, default_time).alias("timestamp"))
        else:
            zero = F.lit(0.0 if field.name == "amount" else "")
            out.append(F.coalesce(got, zero).alias(field.name))
    return F.struct(*out)


def _emit(df: DataFrame, columns: list[str], cause: Column, value: Column, name: str) -> DataFrame:
    """Add ``cause`` and the value of a good row.

    The generator keeps a filter on ``cause`` above the parsing: each record is
    parsed once, whichever side of a split reads it.
    """
    df = df.select(*columns, F.inline(F.array(F.struct(cause.alias("cause"), value.alias("_value")))))
    return df.select(*columns, "cause", F.when(F.col("cause").isNull(), F.col("_value")).alias(name))


def decode_records(raw: DataFrame, value: str = "value", record_time: str = "timestamp") -> DataFrame:
    """Add ``cause`` (null for a good record) and ``tx`` (null for a bad one).

    An absent time takes the time of the record, since a record always has one.
    """
    text = F.col(value).cast("string")
    # The parser stops at the end of the first value and ignores what follows.
    # A closing mark that depends on the text shows that it came to the end.
    mark = F.md5(text.cast("binary"))
    df = raw.withColumn("_all", F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))))
    df = df.withColumns(
        {
            "_doc": F.try_variant_get("_all", "$[0]", "variant"),
            "_more": F.try_variant_get("_all", "$[2]", "variant").isNotNull(),
            "_whole": F.coalesce(F.try_variant_get("_all", "$[1]", "string") == mark, F.lit(False)),
        }
    )
    df = df.withColumn("_usual", _usual(F.col("_doc")))
    odd = F.when(F.col("_usual"), F.array().cast("array<variant>")).otherwise(F.array("_doc"))
    df = df.withColumns(
        {
            "_typed": F.when(F.col("_usual"), _typed(F.col("_doc"))),
            "_odd": F.get(F.transform(F.transform(odd, _loosen), _odd_values), F.lit(0)),
        }
    )
    df = df.withColumn("_values", F.coalesce("_typed", F.col("_odd")["values"]))
    values = F.col("_values")
    cause = (
        F.when(F.col("_usual") & F.col("_whole") & ~F.col("_more"), _value_cause(values))
        .when(text.isNull() | (F.trim(text) == ""), F.lit("empty record"))
        .when(F.col("_all").isNull() | ~(F.col("_whole") | F.col("_more")), F.lit("invalid JSON"))
        .when(F.col("_more"), F.lit("more than one JSON document"))
        .otherwise(F.coalesce(F.col("_odd")["cause"], _value_cause(values)))
    )
    return _emit(df, raw.columns, cause, _transaction(values, F.col(record_time).cast("timestamp")), "tx")


def decode_bodies(bodies: DataFrame, ingest_time: Column, value: str = "value") -> DataFrame:
    """Decode one JSON array of transactions per row.

    Adds ``cause`` (the first fault; one bad element rejects the whole body)
    and ``txs`` (the transactions of a good body). Row-local: no shuffle ties
    the elements of a body together again.
    """
    df = bodies.withColumn("_all", F.try_parse_json(F.col(value)))
    df = df.withColumn("_docs", F.try_variant_get("_all", "$", "array<variant>"))

    def read(doc: Column) -> Column:
        usual = F.struct(F.lit(None).cast("string").alias("cause"), _typed(doc).alias("values"))
        return F.when(_usual(doc), usual).otherwise(_odd_values(_loosen(doc)))

    df = df.withColumn("_read", F.transform("_docs", read))
    faults = F.transform("_read", lambda r: F.coalesce(r["cause"], _value_cause(r["values"])))
    cause = (
        F.when(F.col("_all").isNull(), F.lit("invalid JSON"))
        .when(F.col("_docs").isNull() & (_kind(F.col("_all")) != "VOID"), F.lit("not a JSON array"))
        .otherwise(F.try_element_at(F.filter(faults, lambda c: c.isNotNull()), F.lit(1)))
    )
    txs = F.transform("_read", lambda r: _transaction(r["values"], ingest_time))
    return _emit(df, bodies.columns, cause, txs, "txs")
