"""Filter interaction audit: what every filter removes in every order in which the filters can run.

The orders form a trie of prefixes. A prefix matters as a set only: documents
that survive filters A and B are the same whichever ran first. So the walk goes
depth first, applies one filter at a time to the persisted survivors of its
parent, and visits each unordered prefix once; every edge of the trie that
leads out of a visited prefix has its removals counted there. Survivors are
narrow rows (part, flags), only those on the way down are held, and a lost
executor's share of them is made again from the flags in the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

FILTERS = "ABCDE"
#: ASCII white space, between which words stand.
SPACE = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"


def count(condition: Column) -> Column:
    return F.count(F.when(condition, True))


# ---- the walk ------------------------------------------------------------------------------------


def edges(flags: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """Removals at every edge of the trie, by part.

    `flags` has a string column `part`, a boolean column for each filter (true:
    the row fails it; null counts as false) and for each mark. Returns a row for
    each part, prefix and filter outside the prefix with survivors there: part,
    mask (bits of the prefix's filters), filter (its place), seen (survivors
    before), removed, and lost_<mark> (removed rows with that mark).
    Parts without survivors at a prefix have no row there. No filters or no rows: no rows.
    """
    names, visited, counted = list(filters), set(), []
    own = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in (*names, *marks)]

    def visit(mask: int, survivors: DataFrame) -> None:
        visited.add(mask)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [i for i in range(len(names)) if not mask >> i & 1]
        here = survivors.groupBy("part").agg(
            F.count("*").alias("seen"),
            *[count(F.col(names[i])).alias(f"r{i}") for i in left],
            *[count(F.col(names[i]) & F.col(m)).alias(f"m{i}_{j}") for i in left for j, m in enumerate(marks)],
        )
        each = [F.struct(F.lit(i).alias("filter"), F.col(f"r{i}").alias("removed"), *[F.col(f"m{i}_{j}").alias(f"lost_{m}") for j, m in enumerate(marks)]) for i in left]
        counted.append(saved(here.select("part", F.lit(mask).alias("mask"), "seen", F.inline(F.array(*each))), "edges"))
        for i in left:
            if mask | 1 << i not in visited and mask | 1 << i != (1 << len(names)) - 1:  # nothing leaves the full prefix
                visit(mask | 1 << i, survivors.where(~F.col(names[i])))
        survivors.unpersist()

    visit(0, flags.select("part", *own))
    return reduce(DataFrame.unionByName, counted)


def interactions(flags: DataFrame, filters: Sequence[str] = FILTERS, marks: Sequence[str] = ()) -> DataFrame:
    """A row per part, order of the filters and step: what that step keeps, removes and finds gone.

    Columns: part, filter_order (the names joined), step (from 1), kept, removed,
    redundant (rows that fail the step's filter and went earlier), unique_fails
    (rows that fail this filter alone), <mark>_lost for each mark, and shapley
    (rows its filter removes, over all orders). Zeros are rows too. See `edges`
    for `flags`; ties and repeated rows each count; an empty table gives no rows.
    """
    names, n = list(filters), len(filters)
    edge = saved(edges(flags, names, marks), "trie")
    fails = [F.coalesce(F.col(c), F.lit(False)) for c in names]
    only = [reduce(lambda a, b: a & b, [f if i == k else ~f for i, f in enumerate(fails)]) for k in range(n)]
    parts = flags.groupBy("part").agg(
        F.count("*").alias("rows"),
        F.array(*[count(f) for f in fails]).alias("fails"),
        F.array(*[count(o) for o in only]).alias("only"),
    )
    # orders that go through an edge: those of its prefix, times those of what follows
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("mask") + 1)
    shares = edge.groupBy("part").agg(F.array(*[F.sum(F.when(F.col("filter") == i, F.col("removed") * ways).otherwise(0)) for i in range(n)]).alias("shares"))
    # every step of every order, a constant of n! * n rows, beside each part
    steps = [
        F.struct(F.lit("".join(names[i] for i in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(sum(1 << i for i in order[:k])).alias("mask"), F.lit(order[k]).alias("filter"))
        for order in permutations(range(n))
        for k in range(n)
    ]
    plan = parts.join(shares, "part").withColumn("s", F.explode(F.array(*steps)))
    plan = plan.select("*", "s.*").drop("s")
    lost = [F.coalesce(f"lost_{m}", F.lit(0)).alias(f"{m}_lost") for m in marks]
    removed = F.coalesce("removed", F.lit(0))
    at = F.col("filter")
    return plan.join(edge, ["part", "mask", "filter"], "left").select(
        "part",
        "filter_order",
        "step",
        (F.coalesce("seen", F.lit(0)) - removed).alias("kept"),
        removed.alias("removed"),
        (F.get("fails", at) - removed).alias("redundant"),
        F.get("only", at).alias("unique_fails"),
        *lost,
        F.get("shares", at).alias("shapley"),
    )


# ---- the filters of documents --------------------------------------------------------------------


def text_failures(text: Column) -> Mapping[str, Column]:
    """Failure conditions A to D of a text that isn't null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 2 * F.char_length(text),
        "D": text.rlike(MARKS),
    }


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags A to E and marks good, toxic of every document, from whole texts.

    E: another row's text is the same and its doc_id smaller; null ids are
    neither smaller nor have a smaller one, and repeated ids are equal. Null
    texts are empty, null sources the part ''. A document is good or toxic if any row of labels
    with its doc_id says so; labels of null ids mark nothing. Only digests of texts are shuffled: the first id of
    each text is pre-aggregated, and the join back has one row for each text, so Spark can split a hot one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    flags = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_failures(F.col("text")).items()])
    flags = saved(flags, "flags")
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    flags = flags.join(first.select("digest", "first"), "digest", "left")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    flags = flags.join(marks, "doc_id", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    return saved(flags.select("part", *FILTERS, "good", "toxic"), "flags")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = document_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions(flags, FILTERS, ("good", "toxic"))


def _sql() -> str:
    """The same rows from counts of flag signatures, with each step's prefix as a bit mask."""
    orders = ", ".join(f"('{''.join(FILTERS[i] for i in order)}', {k + 1}, {sum(1 << i for i in order[:k])}, {order[k]})" for order in permutations(range(5)) for k in range(5))
    return f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
m AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '{MARKS}') THEN 8 ELSE 0 END
  + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS sig FROM w LEFT JOIN m ON w.doc_id = m.doc_id),
c AS (SELECT part, sig, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, sig),
o(filter_order, step, mask, bit) AS (VALUES {orders}),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN sig & mask = 0 AND (sig >> bit) & 1 = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN sig & mask = 0 AND (sig >> bit) & 1 = 1 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN sig & mask <> 0 AND (sig >> bit) & 1 = 1 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN sig = (1 << bit) THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN sig & mask = 0 AND (sig >> bit) & 1 = 1 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN sig & mask = 0 AND (sig >> bit) & 1 = 1 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN o GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS int) AS step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant,
  CAST(unique_fails AS bigint) AS unique_fails, CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley FROM r"""


SQL = _sql()
