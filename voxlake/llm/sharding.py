"""Sharding by a permutation-filled lookup table, in DataFrame functions only."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Slots of the table, a prime; the table has this many rows whatever the data.
SLOTS = 8191
SHARDS = 64


def lookup(shards: int | list[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Slot -> shard: shards take turns, each claiming the next free slot of its own preference order.

    A shard prefers slots offset, offset + skip, ... modulo the prime number of
    slots, which visits all. Shards own equal numbers of slots, one apart at
    most, and few slots move when a shard is added or removed.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    if not 0 < len(names) <= slots:
        raise ValueError("the number of shards must be from 1 to the number of slots")
    draw = lambda *x: int(md5("|".join(x).encode()).hexdigest(), 16)
    at = [draw(n, "offset") % slots for n in names]
    skip = [draw(n, "skip") % (slots - 1) + 1 for n in names]
    owner, left = [-1] * slots, slots
    while left:
        for i in range(len(names)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]], left = i, left - 1
            if not left:
                break
    return owner


def sharded(docs: DataFrame, shards: int | list[str] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """(key, slot, shard) of every row: placement costs one hash and one lookup, and no shuffle.

    A null key is placed like an empty one; rows of equal key meet in one shard;
    repeated rows each give a row; an empty table gives no rows. Other columns,
    texts of any length among them, are not read. Preferences that tie for a slot
    go to the shard whose turn it is. The broadcast table has `slots` rows.
    """
    owners = F.from_json(F.lit(str(lookup(shards, slots))), "array<int>")
    t = docs.sparkSession.range(1).select(F.posexplode(owners).alias("slot", "shard"))
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots
    rows = docs.select(F.col(key), slot.cast("int").alias("slot"))
    return rows.join(F.broadcast(t), "slot").select(key, F.col("slot").cast("long"), F.col("shard").cast("long"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


SQL = f"""
SELECT doc_id, s AS slot, ({lookup()})[s + 1]::BIGINT AS shard
FROM (SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT % {SLOTS} AS s FROM documents)
"""
