"""Mixing sources to target weights by blocks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK, saved, table

#: Words of a block at most, and blocks of a source at least, if it has as many words: small sources have small blocks.
BLOCK, LEAST_BLOCKS = 32, 4_096
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words wanted, as a multiple of all words; no source gives more than REPEAT times its own.
SHARE, REPEAT = 1.5, 2
#: Runs that each source's stream is cut into, so that no window holds a whole source.
RUNS = 4096
#: Slots of an output shard, on average.
SHARD_SLOTS = 4096
#: Steps of a walk back into the blocks; see `permuted`.
WALK = 40
#: Slots that one row is exploded into at most.
DEALT = 1_000


def _part(*cols: Column) -> Column:
    """60 bits of md5, as a long; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 15), 16, 10).cast("long")


def _rounds(x: Column, a: Column, b: Column, key: Column) -> Column:
    """A keyed permutation of 0..a*b: four Feistel rounds on the two digits of x, which stay below a and b."""
    div = lambda p, q: F.call_function("div", p, q)  # noqa: E731  of longs, exact
    turn = lambda digit, by, k, size: (digit + _part(key, F.lit(k), by) % size) % size
    left, right = div(x, b), x % b
    left = turn(left, right, 1, a)
    right = turn(right, left, 2, b)
    left = turn(left, right, 3, a)
    right = turn(right, left, 4, b)
    return left * b + right


def permuted(rows: DataFrame, slot: Column, n: Column, key: Column, name: str) -> DataFrame:
    """`rows` with the column `name`: where a keyed permutation of 0..n puts slot, 0 <= slot < n.

    With a = ceil(sqrt(n)) and b = ceil(n / a), a*b exceeds n by less than a, so
    a step leaves 0..n with a chance below 1/sqrt(n); it is then repeated until
    it is back, which takes at most a*b - n + 1 steps. WALK steps are enough
    for n <= WALK^2 in any case; beyond, more are needed with a chance below
    WALK^-WALK, and would raise an error. Longs suffice to 2^62 blocks.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    rows = rows.select("*", slot.alias("_x"), n.alias("_n"), key.alias("_key"), a.alias("_a"))
    rows = rows.select("*", F.call_function("div", F.col("_n") + F.col("_a") - 1, F.col("_a")).alias("_b"))
    step = lambda x: _rounds(x, F.col("_a"), F.col("_b"), F.col("_key"))
    rows = rows.select("*", step(F.col("_x")).alias("_y"))
    inside = lambda y: y < F.col("_n")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_y"), lambda y, _: F.when(inside(y), y).otherwise(step(y)))
    rows = rows.select("*", F.when(inside(F.col("_y")), F.col("_y")).otherwise(walked).alias("_z"))
    lost = F.raise_error(F.lit("a walk of the permutation did not end")).cast("long")
    return rows.select("*", F.when(inside(F.col("_z")), F.col("_z")).otherwise(lost).alias(name)).drop("_x", "_n", "_key", "_a", "_b", "_y", "_z")


def draw_counts(t: DataFrame, shard_slots: int) -> DataFrame:
    """(sid, nb, shard, first, n): how many of a source's slots each output shard draws, and from which on.

    Every slot falls into a shard at random, so the counts of a source are
    multinomial given its total, and those of a shard are so nearly, with the
    sources' shares as chances. Slots are counted where they are made: what is
    shuffled are the counts.
    """
    total = F.greatest(F.ceil(F.sum("slots") / shard_slots), F.lit(1)).cast("long")
    shards = t.agg(total.alias("shards"))  # one row
    head = t.where("slots > 0").select("sid", "nb", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(slots - 1) div %d" % DEALT))).alias("k"))
    # a stated number of partitions: by bytes these few rows look like work for one task
    head = head.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "k")
    low = F.col("k") * DEALT
    slots = head.select("sid", "nb", F.explode(F.sequence(low, F.least(low + DEALT, F.col("slots")) - 1)).alias("slot"))
    fall = _part(F.lit("shard"), F.col("sid"), F.col("slot")) % F.col("shards")
    counts = slots.crossJoin(F.broadcast(shards)).groupBy("sid", "nb", fall.alias("shard")).agg(F.count("*").alias("n"))
    # first slots by running sums, over groups of shards and then within them
    counts = counts.withColumn("part", F.expr("shard div 4096"))
    by = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("sid", "part").agg(F.sum("n").alias("all")).select("sid", "part", F.coalesce(F.sum("all").over(by), F.lit(0)).alias("before"))
    by = Window.partitionBy("sid", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("*", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("within")).join(parts, ["sid", "part"])
    return counts.select("sid", "nb", "shard", (F.col("before") + F.col("within")).alias("first"), "n")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size) with source numbers and targets: weighted shares held below repeat x size.

    target = min(cap, level x weight) at the level where targets sum to the
    budget. With sources sorted by cap / weight, the level that the first k
    caps leave to the others is greatest at the right k, so one running sum over
    this table (a row per source) finds it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), number % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(repeat))
    t = sources.select("source", "source_size", number.alias("sid"), w.alias("w"), cap.alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    every = Window.partitionBy()
    open_ = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.select("*", ((F.sum("source_size").over(every) * F.lit(share) - full) / open_).alias("level"))
    t = t.select("*", F.max("level").over(every).alias("top"))
    return t.select("source", "source_size", "sid", F.least("cap", F.col("top") * F.col("w")).alias("target"))


def plan(docs: DataFrame, block: int = BLOCK, runs: int = RUNS, shard_slots: int = SHARD_SLOTS, least_blocks: int = LEAST_BLOCKS, **how) -> tuple:
    """(documents, slots): where each document lies and what is drawn of it; the output shards.

    documents: doc_id, text_hash, source, size, source_size, target, taken and
    pieces, an array of (from, len, draws): words from..from+len of the text are
    drawn `draws` times; shards counts the output shards that hold any of them.
    slots: shard, sid, slot, block, pass - the layout of the output shards.

    A source's documents form one stream, cut into `runs` by a hash of doc_id,
    and the stream is cut into blocks, of fewer words in a small source. Each output shard draws how many slots it
    has of each source (multinomial counts, given the sources' totals, so that
    every source meets its target within a few blocks); its slots are the next ones
    of the source, and slot j takes the block where a keyed permutation of the
    source's blocks puts j: another permutation for each pass, so no block is
    drawn twice before all are drawn once. Slots meet blocks in a join by index.

    Null text has size 0; a null source is a source of its own, the last; a null
    doc_id is an id like others; repeated rows are mixed one by one. An empty
    table gives empty tables. Other columns are ignored. Rows that tie in doc_id
    are ordered by a hash of their texts. A very long text is a row like others: its
    blocks are rows of a few numbers.
    """
    base = docs.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(CHUNK)), F.lit(0)).cast("long").alias("size"),
        # rows without an id are dealt by their texts
        (_part(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))) % runs).alias("run"),
    )
    base = saved(base, "sizes")
    by_run = base.groupBy("source", "run").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    by_run = by_run.select("source", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    t = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    t = t.withColumn("blk", F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {least_blocks}"))).cast("long"))
    nb = F.ceil(F.col("source_size") / F.col("blk"))
    most = F.lit(how.get("repeat", REPEAT)) * nb
    t = t.select("*", nb.alias("nb"), F.least(F.round(F.col("target") / F.col("blk")).cast("long"), most).alias("slots"))
    t = saved(t, "targets")
    within = Window.partitionBy("source", "run").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.select("*", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("at"))
    r = by_run.select(F.col("source").alias("_s"), F.col("run").alias("_r"), "ahead")
    placed = placed.join(r, placed.source.eqNullSafe(r._s) & (placed.run == r._r))
    s = t.select(F.col("source").alias("_t"), "source_size", "sid", "target", "blk")
    placed = placed.join(s, placed.source.eqNullSafe(s._t)).select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "sid", "blk", (F.col("ahead") + F.col("at")).alias("start")
    )
    placed = saved(placed, "placed")
    counts = saved(draw_counts(t, shard_slots), "counts")
    # slots of a shard, by thousands first, dealt over all tasks
    head = counts.select("sid", "nb", "shard", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div %d" % DEALT))).alias("k"))
    head = head.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "shard", "k")
    low = F.col("k") * DEALT
    slot = F.explode(F.sequence(F.col("first") + low, F.col("first") + F.least(low + DEALT, F.col("n")) - 1))
    slots = head.select("shard", "sid", "nb", slot.alias("slot")).withColumn("pass", F.expr("slot div nb"))
    slots = permuted(slots, F.col("slot") % F.col("nb"), F.col("nb"), F.concat_ws("|", "sid", "pass"), "block")
    slots = slots.select("shard", "sid", "slot", "block", "pass")
    draws = slots.groupBy("sid", "block").agg(F.count("*").alias("draws"), F.collect_set("shard").alias("to"))  # one a pass
    to = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select(
        "doc_id", "text_hash", "sid", "start", "size", "blk", to.alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / F.col("blk")), F.floor((to - 1) / F.col("blk")))).alias("block"),
    )
    low = F.greatest(F.col("block") * F.col("blk"), F.col("start"))
    # merge: rows that explode makes are not in the size estimate, which would have all draws broadcast
    pieces = pieces.join(draws.hint("merge"), ["sid", "block"]).select(
        "doc_id", "text_hash", "sid", "start", "draws", "to",
        (low - F.col("start")).alias("from"), (F.least((F.col("block") + 1) * F.col("blk"), F.col("end")) - low).alias("len"),
    )
    drawn = pieces.groupBy("doc_id", "text_hash", "sid", "start").agg(
        F.sum(F.col("len") * F.col("draws")).alias("taken"),
        F.array_sort(F.collect_list(F.struct("from", "len", "draws"))).alias("pieces"),
        F.size(F.array_distinct(F.flatten(F.collect_list("to")))).cast("long").alias("shards"),
    )
    d = drawn.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "text_hash", "sid", "start")], "taken", "pieces", "shards")
    keys = [placed[c].eqNullSafe(d[f"_{c}"]) for c in ("doc_id", "text_hash", "sid", "start")]
    out = placed.join(d, (placed["size"] > 0) & keys[0] & keys[1] & keys[2] & keys[3], "left").select(
        "doc_id", "text_hash", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "pieces", F.coalesce("shards", F.lit(0)).cast("long").alias("shards"),
    )
    return out, slots


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row for each time that words of a document are taken.

    Columns are those of `docs`. The text keeps the words drawn at least once,
    and again, in a second row, those drawn twice; wholly drawn texts stay as
    they are. Documents of which nothing is drawn, or that have no words, give
    no row. Rows of equal doc_id and text are mixed one by one.
    """
    out, _ = plan(docs, **how)
    out = out.where("taken > 0").groupBy("doc_id", "text_hash").agg(F.collect_list("pieces").alias("each"), F.first("size").alias("_size"))
    out = out.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "each", "_size")
    # the document stays one struct, so that no name of its columns meets one of these
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")).dropDuplicates(["id", "hash"])
    got = own.join(out, own.id.eqNullSafe(out._d) & (own.hash == out._h))
    repeat = how.get("repeat", REPEAT)
    got = got.select("row", "_size", F.explode("each").alias("pieces"))
    got = got.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("pass"))
    got = got.select("row", "_size", F.filter("pieces", lambda p: p["draws"] >= F.col("pass")).alias("own"), F.regexp_extract_all("row.text", F.lit(CHUNK), F.lit(0)).alias("words"))
    n = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, p: a + p["len"])
    parts = F.flatten(F.transform("own", lambda p: F.slice("words", (p["from"] + 1).cast("int"), p["len"].cast("int"))))
    text = F.when(n == F.col("_size"), F.col("row.text")).otherwise(F.array_join(parts, " "))
    got = got.where(F.size("own") > 0).select("row", text.alias("text"))
    return got.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "shards")


def _sql_part(*parts: str) -> str:
    return "('0x' || md5(concat_ws('|', " + ", ".join(parts) + "))[1:15])::BIGINT"


def _sql_round(digit: str, by: str, k: int, size: str) -> str:
    return f"({digit} + {_sql_part('key', str(k), by)} % {size}) % {size}"


SQL = rf"""
WITH RECURSIVE b AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         {_sql_part("coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))")} % {RUNS} AS run FROM documents),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY run, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM b),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size) AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM b GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][sid % 3 + 1] AS w FROM s),
-- shares at each number of sources that stop at their cap, smallest cap per weight first; the right one gives the most
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap, max(level) OVER () * w)::DOUBLE AS target, greatest(1, least({BLOCK}, source_size // {LEAST_BLOCKS}))::BIGINT AS blk, ceil(source_size / blk)::BIGINT AS nb FROM l),
q AS (SELECT *, least(round(target / blk)::BIGINT, 2 * nb) AS slots, ceil(sqrt(nb))::BIGINT AS a FROM t),
j AS (
  SELECT sid, nb, slot, a, (nb + a - 1) // a AS b, sid || '|' || (slot // nb) AS key,
         {_sql_part("'shard'", "sid", "slot")} % greatest(ceil((SELECT sum(slots) FROM q) / {SHARD_SLOTS}.0), 1)::BIGINT AS fall
  FROM (SELECT sid, nb, a, unnest(range(0, slots::BIGINT)) AS slot FROM q)),
-- the shard of a slot: as many of the lowest slots go to each shard, in order, as fell into it
c AS (SELECT sid, fall AS shard, sum(count(*)) OVER (PARTITION BY sid ORDER BY fall) AS stop FROM j GROUP BY sid, fall),
f AS (
  SELECT sid, nb, slot, a, b, key, slot % nb AS x, true AS going FROM j
  UNION ALL
  SELECT sid, nb, slot, a, b, key, y, y >= nb FROM (
    SELECT *, l2 * b + ({_sql_round("r1", "l2", 4, "b")}) AS y FROM (
      SELECT *, {_sql_round("l1", "r1", 3, "a")} AS l2 FROM (
        SELECT *, {_sql_round("r0", "l1", 2, "b")} AS r1 FROM (
          SELECT *, {_sql_round("x // b", "r0", 1, "a")} AS l1 FROM (
            SELECT *, x % b AS r0 FROM f WHERE going)))))),
d AS (
  SELECT f.sid, f.x AS block, count(*) AS draws, list(c.shard) AS shards
  FROM f ASOF JOIN c ON f.sid = c.sid AND f.slot < c.stop WHERE NOT going GROUP BY ALL),
x AS (
  SELECT doc_id, size, start, sid, blk, unnest(range(start // blk, (start + size - 1) // blk + 1)) AS block
  FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source WHERE size > 0),
y AS (
  SELECT doc_id, sum(draws * (least((block + 1) * blk, start + size) - greatest(block * blk, start))) AS taken,
         len(list_distinct(flatten(list(shards)))) AS shards
  FROM x JOIN d USING (sid, block) GROUP BY doc_id)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shards, 0)::BIGINT AS shards
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source LEFT JOIN y USING (doc_id)
"""
