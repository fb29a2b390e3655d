"""Subscriber identity and the router / extender a device hangs on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homescore.schemas import GROUP_ROOT

INSTALLED = "INSTALL COMPLETE"


def device_groups(groups: DataFrame, root: str = GROUP_ROOT) -> DataFrame:
    """Group members as rows: one per (home key, mac, model) with its latest parent and firmware.

    Members move once, by the keys `attach_topology` joins on, so neither the grouping nor the join
    moves them again. They are not combined before: a greatest text is found by sorting, and the few
    repeats are not worth a sort of everything a map task read, whose size no shuffle bounds.
    """
    members = groups.select(F.col("rowkey").alias("dg_rowkey"), F.inline(root)).select(
        "dg_rowkey", F.col("mac").alias("RouExt_mac"), F.col("model").alias("dg_model"), "parent_mac", "fw"
    )
    placed = members.repartition("dg_rowkey", "RouExt_mac")
    return placed.groupBy("dg_rowkey", "RouExt_mac", "dg_model").agg(
        F.max("parent_mac").alias("parent_mac"), F.max("fw").alias("firmware")
    )


def subscriber_identity(
    mapping: DataFrame, status: str | None = INSTALLED, distinct: bool = True
) -> DataFrame:
    """Serial to subscriber; `status=None` takes every row, `distinct=False` keeps repeated rows.

    Variant A joins the mapping as it is, so repeated rows count there; B and C roll them up.
    """
    if status is not None:
        mapping = mapping.where(F.col("status") == status)
    identity = mapping.select(
        F.col("serialnumber").alias("serial_num"), F.col("mdn_5g").alias("mdn"), "cust_id"
    )
    return identity.distinct() if distinct else identity


def attach_identity(df: DataFrame, identity: DataFrame, how: str = "left") -> DataFrame:
    """A serial mapped to several subscribers gives a row for each of them."""
    return df.join(identity, "serial_num", how)


def attach_topology(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Each (device, parent) with its parent's group entry; `Rou_Ext` is 1 behind an extender."""
    match = (F.col("dg_rowkey") == F.col("rk_row_sn")) & (F.col("RouExt_mac") == F.col("parent_id"))
    return (
        df.join(groups, match, "left")
        .withColumn("Rou_Ext", F.when(F.col("parent_mac").isNotNull(), 1).otherwise(0))
        .drop("dg_rowkey")
    )


def attach_identity_as_of(df: DataFrame, mapping: DataFrame, status: str | None = INSTALLED, how: str = "left") -> DataFrame:
    """Rows of many days, each with the subscribers that its own day's snapshot names.

    `df` has `date`; `mapping` is a mapping of several days with the day it serves as `as_of`
    (`days.as_of`).
    """
    kept = mapping if status is None else mapping.where(F.col("status") == status)
    identity = kept.select(
        F.col("as_of").alias("date"), F.col("serialnumber").alias("serial_num"), F.col("mdn_5g").alias("mdn"), "cust_id"
    ).distinct()
    return df.join(identity, ["date", "serial_num"], how)


def attach_topology_as_of(df: DataFrame, groups: DataFrame, root: str = GROUP_ROOT) -> DataFrame:
    """`attach_topology` for rows of many days, each with its own day's group records (with `as_of`)."""
    members = groups.select("as_of", F.col("rowkey").alias("dg_rowkey"), F.inline(root))
    latest = members.groupBy("as_of", "dg_rowkey", F.col("mac").alias("RouExt_mac"), F.col("model").alias("dg_model")).agg(
        F.max("parent_mac").alias("parent_mac"), F.max("fw").alias("firmware")
    )
    match = (F.col("as_of") == F.col("date")) & (F.col("dg_rowkey") == F.col("rk_row_sn")) & (F.col("RouExt_mac") == F.col("parent_id"))
    return (
        df.join(latest, match, "left")
        .withColumn("Rou_Ext", F.when(F.col("parent_mac").isNotNull(), 1).otherwise(0))
        .drop("dg_rowkey", "as_of")
    )
