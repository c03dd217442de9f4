"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD_ANY_CASE, grams, saved, small, table, words

#: Words of a window: a shared run of this many words is contamination.
WINDOW = 10
#: Words of a fingerprint; a window holds WINDOW - K + 1 of them.
K = 5


def _sliding(df: DataFrame, of: str, to: str, width: int, pick) -> DataFrame:
    """Adds column `to`: pick() over of[i .. i+width-1] for each i; past the end, over what is left.

    Every step is a projection of its own, so no step is computed twice.
    """
    keep = [c for c in df.columns if c != to]
    df, done = df.select(*keep, F.col(of).alias(to)), 1
    while done < width:
        step = min(done, width - done)
        shifted = F.slice(to, F.lit(step + 1), F.lit(2**30))
        df, done = df.select(*keep, F.zip_with(to, shifted, pick).alias(to)), done + step
    return df


def _selected(df: DataFrame, g: str, to: str, span: int) -> DataFrame:
    """Adds fingerprints (pos, fp): positions whose hash is the least of a window of `span` k-grams.

    Every position that ties for the least is kept, as are the first ones, so
    both sides of a shared window always keep at least one common fingerprint.
    """
    keep = df.columns
    df = _sliding(df, g, "_least", span, lambda a, b: F.least(a, b))
    df = _sliding(df, "_least", "_most", span, lambda a, b: F.greatest(a, b))
    # column arguments, not lambda bodies: an expression inlined into a lambda is computed for each element
    marked = F.transform(g, lambda x, i: F.struct(i.alias("pos"), x.alias("fp")))
    before = F.concat(F.array_repeat(F.lit(None).cast("bigint"), span - 1), F.col("_most"))
    kept = F.zip_with(
        marked, before, lambda s, m: F.when((s["pos"] < span - 1) | (s["fp"] == m), s)
    )
    kept = F.filter(kept, lambda s: s.isNotNull())
    return df.select(*keep, kept.alias(to))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, len, win): each window of each item; a short item is one window."""
    n = F.size("w")
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(n > 0)
    last = F.greatest(n - window, F.lit(0))
    return items.select(
        "item_id", "w", F.least(n, F.lit(window)).alias("len"), F.explode(F.sequence(F.lit(0), last)).alias("p")
    ).select("item_id", "len", F.concat_ws(" ", F.slice("w", F.col("p") + 1, F.col("len"))).alias("win")).distinct()


def _whole(w: Column, n: int) -> Column:
    """Fingerprints (pos, len, fp) of every n consecutive words, for items of n words."""
    at = F.transform(
        F.sequence(F.lit(0), F.size(w) - n),
        lambda i: F.struct(
            i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.concat_ws(" ", F.slice(w, i + 1, n))).alias("fp")
        ),
    )
    return F.when(F.size(w) >= n, at).otherwise(F.array().cast("array<struct<pos:int,len:int,fp:bigint>>"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, hits.

    docs needs doc_id and text, benchmark item_id and text; other columns are
    ignored, whatever their names. `hits` lists the word spans (p, len) that
    occur in the benchmark.

    Winnowing: of every window of `window` words both sides keep the least
    k-gram hash, so a shared window always shares a fingerprint. Fingerprints
    are joined and each hit is extended to the windows around it, which are then
    compared word by word. Items shorter than a window are joined whole.

    A null or empty text has no words and no hits; a null item text is no item;
    an item without id marks words but is not counted. Repeated rows (the same
    doc_id and text) each give a row. An empty table of either kind gives zeros.
    Ties don't arise, as all equal least hashes are kept. A very long text is one
    row whose windows cost memory in proportion; nothing is gathered but one
    document's own hits.
    """
    wins = saved(_windows(benchmark, window), "windows")
    lengths = sorted(r[0] for r in wins.select("len").distinct().collect())  # at most `window` values
    full = saved(
        wins.where(F.col("len") == window)
        .select(F.transform(F.split("win", " "), lambda x: F.xxhash64(x)).alias("h"))
        .select(grams(F.col("h"), k).alias("g"))
        .select(F.array_min("g").alias("fp"), F.lit(window).alias("len"))
        .unionByName(
            wins.where(F.col("len") < window).select(F.xxhash64("win").alias("fp"), "len")
        )
        .distinct(),
        "fingerprints",
    )
    key = ["doc_id", "text_hash"]
    base = docs.select("doc_id", "text")
    id_ = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    text = base.select(*id_, words(F.col("text")).alias("w"))
    prints = text.select(*key, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    prints = _selected(prints.select(*key, "w", grams(F.col("h"), k).alias("g")), "g", "marks", window - k + 1)
    marks = F.transform(
        "marks",
        lambda s: F.struct(s["pos"].alias("pos"), F.lit(window).alias("len"), s["fp"].alias("fp")),
    )
    kinds = [marks] if window in lengths else []
    kinds += [_whole(F.col("w"), short) for short in lengths if short < window]
    found = F.concat(*kinds) if kinds else F.array().cast("array<struct<pos:int,len:int,fp:bigint>>")
    prints = prints.select(*key, "w", found.alias("found"))
    # the words around a fingerprint that any window holding it can reach
    start = F.when(F.col("len") < window, F.col("pos")).otherwise(F.greatest(F.col("pos") - (window - k), F.lit(0)))
    size = F.when(F.col("len") < window, F.col("len")).otherwise(F.col("pos") + window - start)
    around = [*key, "len", start.alias("start"), F.slice("w", start + 1, size).alias("near")]
    # explode_outer: for explode the optimizer adds a filter on the array's size and
    # pushes it below every projection, where the array is computed over and over
    if small(full, broadcast_rows):  # the words stay beside the probe, and are cut out only for hits
        rows = prints.select(*key, "w", F.explode_outer("found").alias("f")).select(*key, "w", "f.*")
        near = rows.join(F.broadcast(full), ["fp", "len"], "left_semi").select(*around)
    else:  # only fingerprints travel; the words of documents with hits are fetched afterwards
        thin = prints.select(*key, F.explode_outer("found").alias("f")).select(*key, "f.*")
        hit = thin.join(full, ["fp", "len"], "left_semi").select(*key, "len", "pos").distinct()
        left = hit.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "len", "pos")
        once = text.dropDuplicates(key)
        near = once.join(left, once.doc_id.eqNullSafe(left.d) & once.text_hash.eqNullSafe(left.t)).select(*around)
    last = F.size("near") - F.col("len")
    spans = near.where(last >= 0).select(
        *key, "len", "start", "near", F.explode_outer(F.sequence(F.lit(0), last)).alias("o")
    )
    spans = spans.select(
        *key,
        "len",
        (F.col("start") + F.col("o")).alias("p"),
        F.concat_ws(" ", F.slice("near", F.col("o") + 1, F.col("len"))).alias("win"),
    )
    texts = wins.select("win", "len").distinct()
    spans = spans.join(F.broadcast(texts) if small(texts, broadcast_rows // 4) else texts, ["win", "len"], "left_semi")
    # one row per document and window text, then per document
    by_text = spans.groupBy(*key, "len", "win").agg(F.collect_set("p").alias("at"))
    by_text = saved(by_text, "hits")
    hits = (
        by_text.select(*key, "len", F.explode("at").alias("p"))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set(F.struct("p", "len"))).alias("hits"))
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["p"] + s["len"] - F.greatest(s["p"], a["to"]), F.lit(0))).alias("n"),
            F.greatest(a["to"], s["p"] + s["len"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    hits = hits.select(*key, "hits", covered.cast("long").alias("n_hit"))
    items = (
        by_text.select(*key, "len", "win")
        .join(wins, ["win", "len"])
        .select(*key, F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    items = items.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_j"), "items")
    both = hits.join(items, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_j")), "left")
    both = both.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "hits", "n_hit", "items")
    out = base.select(*id_, F.regexp_count("text", F.lit(WORD_ANY_CASE)).alias("n"))
    out = out.join(both, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        *key,
        F.coalesce("n", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("hits", F.array().cast("array<struct<p:int,len:int>>")).alias("hits"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS len,
         array_to_string(w[p + 1 : p + least(len(w), {WINDOW})], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT len FROM wins),
places AS (
  SELECT doc_id, len, p, array_to_string(w[p + 1 : p + len], ' ') AS win
  FROM (SELECT doc_id, w, len, unnest(range(0, len(w) - len + 1)) AS p FROM d, lens WHERE len(w) >= len)),
hit AS (SELECT DISTINCT doc_id, places.len, p, win FROM places SEMI JOIN wins USING (win, len)),
nh AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + len)) AS q FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit JOIN wins USING (win, len) WHERE item_id IS NOT NULL)
  GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
