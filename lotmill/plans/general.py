"""Queries of the general data-quality problem on the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotmill.functions.names import plain_lot, sql_plain_lot
from lotmill.operators.orphans import Child, Parent, orphan_report, orphans
from lotmill.session import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lot = plain_lot(F.col("lot_id"))
    register = Parent("lot_register", table(spark, sf_dir, "lot_register"), lot, F.col("registered_at"), F.col("withdrawn_at"))
    kids = [Child(t, table(spark, sf_dir, t), "lot_register", lot, F.col("row_id"), F.col("arrived_at")) for t in ("manifest", "mes")]
    return orphans([register], kids)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "row_id")


def p1_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


_LOT = sql_plain_lot("lot_id")
_FOUND = f"""
with child as (
  select 'manifest' as table_name, row_id, {_LOT} as lot, arrived_at from manifest
  union all select 'mes', row_id, {_LOT}, arrived_at from mes),
reg as (select {_LOT} as lot, registered_at, withdrawn_at from lot_register),
bad as (
  select * from child c where lot is not null and not exists (
    select 1 from reg r where r.lot = c.lot and r.registered_at <= c.arrived_at
      and (r.withdrawn_at is null or r.withdrawn_at > c.arrived_at)))
"""

QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report}
SQL = {
    "p1_found": _FOUND + "select table_name, row_id from bad",
    "p1_orphan_report": _FOUND + """select table_name, strftime(arrived_at, '%Y-%m') as month,
      count(*) as orphan_rows, count(distinct lot) as orphan_keys from bad group by 1, 2""",
}
