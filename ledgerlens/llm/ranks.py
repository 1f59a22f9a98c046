"""Positions and running totals within groups, also where one group is most of the rows.

Rows are range-partitioned by group and order, so a large group spreads over many
partitions. Each partition numbers its own rows; only a group that crosses a border
needs to know what came before, and a partition has at most two such groups. So the
carries are two rows a partition at most, and are broadcast with that bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, staged


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], to: str = "pos",
             sums: dict[str, str] | None = None, xors: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with the position ``to`` (from 0) in their group, ascending by ``order``, nulls first.

    ``sums`` and ``xors`` map new columns to columns that are added up, or combined by
    exclusive or, from the group's first row to this one. Rows that agree in group and
    order lie in one partition: where many may, ``order`` ends in a column that tells them
    apart. ``rows`` is read twice, so it should be a stored table. Without ``group`` all
    rows are one group.
    """
    part = fresh(rows, "__part")
    ranged = staged(
        rows.repartitionByRange(*[F.asc_nulls_first(c) for c in [*group, *order]])
        .withColumn(part, F.spark_partition_id()), "ranged")
    added = {name: F.sum(column) for name, column in (sums or {}).items()}
    mixed = {name: F.bit_xor(column) for name, column in (xors or {}).items()}
    carried = _carries(ranged, part, group, {to: F.count(F.lit(1))} | added, mixed)
    local = Window.partitionBy(part, *group).orderBy(*[F.asc_nulls_first(c) for c in order])
    so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumns(
        {to: F.row_number().over(local).cast("bigint") - 1}
        | {name: total.over(so_far) for name, total in (added | mixed).items()})
    joined = inside.alias("r").join(F.broadcast(carried).alias("c"), _same([part, *group]), "left")

    def carried_in(name: str) -> Column:
        before = F.coalesce(F.col(f"c.{name}"), F.lit(0).cast("bigint"))
        own = F.col(f"r.{name}")
        return (own.bitwiseXOR(before) if name in mixed else own + before).alias(name)

    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], *map(carried_in, [to, *added, *mixed]))


def _same(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in columns]


def _carries(ranged: DataFrame, part: str, group: Sequence[str], added: dict[str, Column],
             mixed: dict[str, Column]) -> DataFrame:
    """What the earlier partitions hold of a partition's first and last group."""
    if group:
        whole = F.struct(*group)
        ends = ranged.groupBy(part).agg(F.array(F.min(whole), F.max(whole)).alias("ends"))
        ends = ends.select(part, F.explode("ends").alias("end")).select(part, "end.*").distinct()
    else:
        ends = ranged.select(part).distinct()
    held = ranged.alias("r").join(F.broadcast(ends).alias("c"), _same([part, *group]), "left_semi")
    held = held.groupBy(part, *group).agg(*[total.alias(name) for name, total in (added | mixed).items()])
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return staged(held.select(
        part, *group,
        *[F.sum(name).over(before).alias(name) for name in added],
        *[F.bit_xor(name).over(before).alias(name) for name in mixed]), "carries")
