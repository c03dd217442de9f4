"""Selections under a budget, in rounds over running sums, so that no group has to fit into one task.

A sequential walk would take rows in order while they fit. Here each round takes, of every group
at once, the longest run of rows that fits, and then drops what can no longer fit; a walk over the
rest would decide the same. Running sums are taken within ranges of the order, whose own sums are added up in a
small table. In descending order of size, or wherever sizes vary little, the budget's
rest at least halves in a round, so there are about log2(cap / least size) rounds; orders in which every second row nearly
fills the rest can take a round for each row they skip.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.sources.places import stored

ORDER = "_order"


def running(rows: DataFrame, order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Rows with `run_<c>`: the sum of c over the rows of the group `_g` up to each, by ranges of the order."""
    dealt = rows.repartitionByRange("_g", *order).withColumn("_at", F.spark_partition_id())
    dealt = stored(dealt, "budget")
    before = Window.partitionBy("_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_g", "_at").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    base = ranges.select("_g", "_at", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    within = Window.partitionBy("_g", "_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.select("*", *[F.sum(c).over(within).alias(f"_w_{c}") for c in sums])
    own = own.withColumnsRenamed({"_g": "_gl", "_at": "_al"}).join(base, F.col("_gl").eqNullSafe(F.col("_g")) & (F.col("_al") == F.col("_at"))).drop("_g", "_al").withColumnRenamed("_gl", "_g").withColumns({f"run_{c}": F.col(f"_b_{c}") + F.col(f"_w_{c}") for c in sums})
    return own.drop("_at", *[f"_{k}_{c}" for k in "bw" for c in sums])


def budgeted(rows: DataFrame, group: str, order: Sequence[Column], size: str, cap: Column, gain: str | None = None, target: int | None = None, unit: str | None = None) -> DataFrame:
    """The rows that a walk through each group keeps while their sizes add up to `cap` at most.

    size, gain and cap are whole numbers, so sums are exact; cap is a column that is the same in a whole group. A row that doesn't fit is
    skipped and later ones are tried. With a target, a group ends once the gains of kept rows reach it.
    With a unit, the first row of a unit that doesn't fit ends the unit (not the group), and nothing is kept once the cap is reached.
    `order` is ascending and unique in a group. Rows with null or negative sizes, gains or caps or a null group are left out; an empty table stays empty.
    """
    gains = F.col(gain) if gain else F.lit(0)
    names, order = rows.columns, list(order)
    every = rows.select(F.struct(*names).alias("_row"), F.col(group).alias("_g"), F.col(size).cast("long").alias("_n"), gains.cast("long").alias("_y"), cap.cast("long").alias("_cap"),
                        (F.col(unit) if unit else F.lit(None)).alias("_u"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    left = every.where("_g IS NOT NULL AND _n >= 0 AND _y >= 0 AND _cap >= 0")
    by = [F.col(f"_o{i}") for i in range(len(order))]
    left, kept = left.withColumns({"_used": F.lit(0).cast("long"), "_got": F.lit(0).cast("long")}), []
    while True:
        now = stored(running(left, by, ["_n", "_y"]), "budget")
        fits = F.col("_used") + F.col("run__n") <= F.col("_cap")
        if unit:
            fits &= F.col("_used") + F.col("run__n") - F.col("_n") < F.col("_cap")
        if target is not None:
            fits &= F.col("_got") + F.col("run__y") - F.col("_y") < target
        taken = now.where(fits)
        kept.append(taken.select("_row.*"))
        sums = taken.groupBy("_g").agg(F.sum("_n").alias("_tn"), F.sum("_y").alias("_ty"))
        rest = now.where(~fits).drop("run__n", "run__y")
        if unit:  # the unit whose row didn't fit is closed
            shut = rest.groupBy("_g").agg(F.min(F.struct(*by, F.col("_u"))).getField("_u").alias("_shut"))
            rest = rest.join(shut, "_g").where("NOT _u <=> _shut").drop("_shut")
        rest = rest.join(sums, "_g", "left")
        rest = rest.withColumns({"_used": F.col("_used") + F.coalesce("_tn", F.lit(0)), "_got": F.col("_got") + F.coalesce("_ty", F.lit(0))}).drop("_tn", "_ty")
        if unit:  # as is every unit whose next row is too large
            first = rest.groupBy("_g", "_u").agg(F.min(F.struct(*by, F.col("_n"))).getField("_n").alias("_first"))
            rest = rest.join(first, ["_g", "_u"]).where("_used + _first <= _cap AND _used < _cap").drop("_first")
        else:
            rest = rest.where("_used + _n <= _cap")
        if target is not None:
            rest = rest.where(F.col("_got") < target)
        left = stored(rest, "budget")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, kept)


def placed(rows: DataFrame, group: str | None, order: Sequence[str]) -> DataFrame:
    """`rows` with `place`: the place of each in its group (None: of all rows), from 1, in ascending order; ties must not occur."""
    own = rows.select("*", (F.col(group) if group else F.lit(0)).alias("_g"), F.lit(1).alias("_one"))
    return running(own, [F.col(c) for c in order], ["_one"]).select(*rows.columns, F.col("run__one").cast("long").alias("place"))
