"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardwatch import constants as K


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def is_flagged(decision: Column | None = None) -> Column:
    return (F.col("decision") if decision is None else decision) != K.APPROVE


def flag_text(flags: Column) -> Column:
    """Flags as shown to people: joined, or ``clean`` when there are none."""
    return F.when(F.size(flags) > 0, F.array_join(flags, ", ")).otherwise(F.lit("clean"))


def is_valid_resolution(resolution: Column) -> Column:
    return F.coalesce(resolution.isin(K.CONFIRMED_FRAUD, K.FALSE_POSITIVE), F.lit(False))


def queue_status(requested: str | None) -> str:
    """``resolved`` on request; anything else means the open queue."""
    return K.RESOLVED if requested == K.RESOLVED else K.OPEN


def escape_label(value: Column) -> Column:
    slash = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    quote = F.replace(slash, F.lit('"'), F.lit('\\"'))
    return F.replace(quote, F.lit("\n"), F.lit("\\n"))


def label(key: str, value: Column) -> Column:
    return F.concat(F.lit("{" + key + '="'), escape_label(value), F.lit('"}'))
