"""Dimension lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import constants as K


def bin_table(spark: SparkSession) -> DataFrame:
    """The built-in BIN dimension: nine rows, one per BIN."""
    rows = ", ".join(f"('{b}', '{c}')" for b, c in K.BIN_COUNTRY.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS bins(card_bin, issuer)")


def mcc_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{m}')" for m in K.HIGH_RISK_MCC)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS mccs(mcc)")


def with_issuer(tx: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Left lookup of the issuer country; an unknown BIN gets null.

    The built-in table is broadcast because its size is fixed. Spark sizes a
    table passed in before it chooses the join. Of a repeated BIN there the
    smallest country counts, so a lookup never multiplies transactions.
    """
    if bins is None:
        return tx.join(F.broadcast(bin_table(tx.sparkSession)), "card_bin", "left")
    one = bins.groupBy("card_bin").agg(F.min("issuer").alias("issuer"))
    return tx.join(one, "card_bin", "left")


def in_high_risk_mcc(tx: DataFrame, mccs: DataFrame | None = None) -> DataFrame:
    """Transactions whose category is in the table (existence lookup)."""
    lookup = F.broadcast(mcc_table(tx.sparkSession)) if mccs is None else mccs.select("mcc").distinct()
    return tx.join(lookup, "mcc", "left_semi")
