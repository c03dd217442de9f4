"""Greedy selections as rounds of distributed steps: fair shares of channels, and samples that cover facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.sources.places import stored

from .budget import budgeted, placed, running


def fair_shares(episodes: DataFrame, target: int, most: int, share: float) -> DataFrame:
    """Whole episodes of channels in fair order until they add up to `target`: (episode_id, channel, size, place).

    episodes has episode_id, channel, size (a whole number, as target and most are), weight and priority. The channel that
    has the least size per weight comes next, with its first episode by digest that neither takes the total beyond
    `most` nor the channel beyond share x target; equals go by priority, channel and digest. An episode without channel, size or weight is left out;
    a channel's weight is the greatest of its episodes'.

    A channel's episodes come up when what the channel has before them, per weight, is the least anywhere: in the order of
    that number. So a round sorts by it, takes the longest run that fits, and drops what no longer can;
    only then a channel's later episodes move up, and the next round sorts anew what is behind. There are a few rounds, as misfits come near the end.
    """
    known = episodes.where("channel IS NOT NULL AND channel <> '' AND size > 0 AND weight > 0")
    known = known.withColumn("digest", F.sha2(F.col("episode_id").cast("string"), 256))
    weights = known.groupBy("channel").agg(F.max("weight").alias("_weight"))
    left = stored(known.select("episode_id", "channel", "size", "priority", "digest"), "episodes")
    while True:
        open_ = budgeted(left, "channel", [F.col("digest"), F.col("episode_id")], "size", F.lit(int(target * share)))
        by = ["digest", "episode_id"]
        open_ = running(open_.withColumn("_g", F.col("channel")), [F.col(c) for c in by], ["size"]).join(weights, "channel")
        due = ((F.col("run_size") - F.col("size")) / F.col("_weight")).alias("due")
        line = open_.select("episode_id", "channel", "size", "priority", "digest", due, F.lit(0).alias("_g"))
        order = [F.col(c) for c in ("due", "priority", "channel", "digest", "episode_id")]
        line = running(line, order, ["size"])
        line = stored(line.drop("_g"), "episodes")
        run = F.col("run_size")
        fits = (run <= most) & (run - F.col("size") < target)
        taken = line.where(fits)
        total = taken.agg(F.coalesce(F.max("run_size"), F.lit(0))).first()[0]
        misfits = line.where(~fits & (F.col("size") > most - total))
        if total >= target or misfits.isEmpty():
            return placed(taken, None, ["due", "priority", "channel", "digest", "episode_id"]).select("episode_id", "channel", "size", "place")
        left = stored(left.join(misfits.select("episode_id"), "episode_id", "left_anti"), "episodes")


def covering(rows: DataFrame, facets: list[str], size: int) -> DataFrame:
    """(id, place) of `size` rows, each with the most facet values that none before it has; equals go by the greater digest of id.

    Each round is one aggregate over the rows, of which one comes to the driver, until no row has anything new; the others are then taken by digest
    at once. Of rows that share all facets only `size` can be chosen, so the others are left out first. Null facets are values of their own.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    named = [F.concat_ws(":", F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f"_f{i}") for i, f in enumerate(facets)]
    few = rows.select("id", digest.alias("digest"), *named)
    alike = Window.partitionBy(*[f"_f{i}" for i in range(len(facets))]).orderBy(F.desc("digest"))
    few = stored(few.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= size).drop("_r"), "facets")
    seen, chosen = [], []
    while len(chosen) < size:
        left = few.where(~F.col("id").isin(chosen)) if chosen else few
        fresh = reduce(lambda a, b: a + b, [F.when(F.col(f"_f{i}").isin(seen), 0).otherwise(1) if seen else F.lit(1) for i in range(len(facets))])
        best = left.agg(F.max(F.struct(fresh.alias("new"), "digest", "id", *[f"_f{i}" for i in range(len(facets))])).alias("b")).first()["b"]
        if best is None:
            break
        if not best["new"]:
            chosen += [r["id"] for r in left.orderBy(F.desc("digest")).limit(size - len(chosen)).collect()]
            break
        chosen.append(best["id"])
        seen = sorted({*seen, *[best[f"_f{i}"] for i in range(len(facets))]})
    spark = rows.sparkSession
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(chosen)], f"id {rows.schema['id'].dataType.simpleString()}, place long")
