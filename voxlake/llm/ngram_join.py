"""Similarity join on sets of word shingles, exact, by partitioning the universe of shingles.

Sets of one size band share a partition of the universe into m segments. Two
sets with Jaccard >= t differ in at most H = (1 - t) / (1 + t) x (|x| + |y|)
shingles, so of H + 1 segments in which x is not empty at least one is equal in
y (pigeonhole). Each set therefore indexes its non-empty segment subsets: a
bucket for each. A pair needs the guarantee of one of its sets only:

* allocation by cost: buckets of more than HOT sets are skipped by every set
  that keeps H + 1 others, and stay for the sets that don't;
* sets with too few non-empty segments (small ones) also index one-deletion
  neighbourhoods of their subsets, where a segment of two or more counts twice;
  if that is still too little, their single shingles.

Candidates are verified exactly. No bucket is expanded into all pairs: its
members meet one pivot first, and only members that are then in different
components meet each other. Where these are many (a group of copies that differ
by about as much as the threshold allows), sets are rewritten as their
differences from the shingles that most of the group hold. That keeps what two
sets differ in, and leaves short sets of rare elements, of which two that link
share one of the rarest (prefix filter), or both are so short that both link
with the shortest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, hinted, hold, map_pandas, saved, table

K, PERCENT = 3, 90
#: Sets of a bucket beyond which it is skipped where the guarantee holds without it.
HOT = 64
#: Cross pairs per member up to which the components of a bucket meet directly.
FEW = 8
#: Parts that the shingles of a family are dealt to when its size is joined to them.
SALTS = 64
#: Families whose centres (each at most twice as long as its mean set) are broadcast.
CENTRES = 1_000
CACHED_WORDS = 300_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles; fewer words are one shingle, no words none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    missing = set(found).difference(_words)
    if len(_words) + len(missing) > CACHED_WORDS:
        _words.clear()
        missing = set(found)
    for w in missing:
        _words[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    with np.errstate(over="ignore"):
        n = min(k, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out * _A + h[i : len(h) - n + 1 + i])
    return np.unique(out)


class Partition:
    """Size bands, segments and needs at a similarity of percent/100 or more."""

    def __init__(self, percent: int = PERCENT):
        self.t = percent / 100
        self.delta = (1 - self.t) / (1 + self.t)  # differing shingles per shingle of both sets
        ratio = max(1.5, 1 / self.t)
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(math.floor(ratio * self.low[-1] + 1e-9) + 1)
        # shingles per segment of the largest sets: as many as leave 15 % more non-empty segments than needed
        at = 0.5
        while 1 - math.exp(-at) >= 1.15 * 2 * self.delta * at and at < 12:
            at += 0.05
        self.per_segment = at

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def schemes(self, size: int) -> list[tuple[int, int, int]]:
        """(band, segments, needed) of its own band, and of the next if partners can lie there."""
        own, most = self.band(size), math.floor(size / self.t + 1e-9)
        out = []
        for b in range(own, self.band(most) + 1):
            top = self.low[b + 1] - 1
            partner = min(top, most)
            need = math.floor(self.delta * (size + partner) + 1e-9) + 1
            out.append((b, max(1, math.ceil(top / self.per_segment)), need))
        return out

    def index(self, x: np.ndarray) -> tuple[list, list, list, list]:
        """Buckets of the set x: per scheme their count and the need; and extra ones that are always kept."""
        buckets, counts, needs, extra = [], [], [], []
        with np.errstate(over="ignore"):
            own = _mix(x * _B + _A)
            for b, m, need in self.schemes(len(x)):
                salt = np.uint64(b * 2_654_435_761 + 97)
                seg = _mix(x ^ salt) % np.uint64(m)
                order = np.argsort(seg, kind="stable")
                s, v = seg[order], own[order]
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                total = np.add.reduceat(v, first)
                name = _mix(s[first] * _A + salt)
                buckets.append(_mix(total ^ name))
                counts.append(len(first))
                needs.append(need)
                if len(first) < need:
                    size = np.diff(np.r_[first, len(s)])
                    away = np.repeat(total, size) - v  # the subset without one of its shingles
                    many = np.repeat(size, size) > 1
                    deleted = (away ^ np.repeat(name, size))[many]
                    extra.append(_mix(np.r_[total ^ name, deleted] + _A))
                    if int((1 + (size > 1)).sum()) < need:
                        extra.append(_mix(own + salt + _B))
        flat = lambda xs: np.concatenate(xs).view(np.int64) if xs else np.zeros(0, np.int64)
        return flat(buckets), counts, needs, flat(extra)


INDEX = (
    "id long, n long, k1 long, k2 long, buckets array<long>, n_own int, n_up int, need_own int, need_up int, extra array<long>"
)


def _indexer(k: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("shingles", _words.clear)
        part, names = Partition(percent), [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                x = shingles(text, k)
                if len(x):
                    raw = x.tobytes()
                    key = [xxhash.xxh64_intdigest(raw, s) - (1 << 63) for s in (1, 2)]
                    buckets, counts, needs, extra = part.index(x)
                    rows.append((doc, len(x), *key, buckets, *(counts + [0])[:2], *(needs + [0])[:2], extra))
            yield pd.DataFrame(rows, columns=names)

    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("shingles", _words.clear)
        for batch in batches:
            sets = [shingles(t, k).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "s": sets})

    return run


def _sizes(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n": [len(shingles(t, k)) for t in batch["text"]]})

    return run


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def _centred(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates (x, y) among `crowd` (bucket, id, c): all that are needed to join its components c.

    A family is what buckets of the crowd connect; B are the shingles that more
    than half of it hold. With x' = x ^ B, |x ^ y| = |x' ^ y'|, so x and y link if
    x' and y' share at least (k(x) + k(y)) / 2 elements, where
    k(x) = |x'| - (1 - t) / (1 + t) |x|. Where that is 0 or less they link
    unseen, and both link with the family's least k. Else they share an element
    among the rarest |x'| - need + 1 of x' and |y'| - need + 1 of y'.
    """
    whole, less = 100 + percent, 100 - percent  # k is kept times `whole`, as an integer
    pivot = crowd.groupBy("bucket").agg(F.min("id").alias("y"))
    family = components(_pairs(crowd.join(pivot, "bucket").select(F.col("id").alias("x"), "y")))
    base = crowd.select("id", "c").distinct().join(family.withColumnRenamed("component_id", "fam"), "id")
    base = saved(base.join(sets, "id"), "family")
    members = base.groupBy("fam").agg(F.count("*").alias("members"))
    members = members.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    held = base.select("fam", F.explode("s").alias("e")).groupBy("fam", "e").agg(F.count("*").alias("f"))
    held = held.withColumn("salt", F.pmod("e", F.lit(SALTS)))
    centre = held.join(members, ["fam", "salt"]).where("2 * f > members").groupBy("fam").agg(F.collect_list("e").alias("centre"))
    centre = saved(centre, "centres")
    rel = base.join(hinted(centre, CENTRES), "fam", "left")
    own = F.coalesce("centre", F.array().cast("array<bigint>"))
    x = F.concat(F.array_except("s", own), F.array_except(own, "s"))
    rel = rel.select("fam", "id", "c", x.alias("e"), (F.size(x) * whole - F.size("s") * less).alias("k"))
    rel = saved(rel, "differences")
    discard(base, centre)
    least = rel.groupBy("fam").agg(F.min(F.struct("k", "id", "c")).alias("z"))
    rel = rel.join(hinted(least), "fam").withColumn("near", F.expr("k + z.k <= 0"))
    star = rel.where("near AND c <> z.c").select(F.col("id").alias("x"), F.col("z.id").alias("y"))
    need = F.ceil((F.col("k") + F.col("z.k")) / (2 * whole))
    last = F.size("e") - F.greatest(need, F.lit(1)) + 1
    flat = rel.select("fam", "id", F.when(F.col("near"), F.col("z.c")).otherwise(F.col("c")).alias("c"), "k", F.size("e").alias("n"), last.alias("last"), F.explode("e").alias("e"))
    rare = flat.groupBy("fam", "e").agg(F.count("*").alias("f"))
    flat = flat.join(rare, ["fam", "e"]).withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("f", "e")))
    flat = saved(flat.where("at <= last AND f > 1").select("fam", "e", "id", "c", "k", (F.col("n") - F.col("at") + 1).alias("room")), "prefixes")
    other = flat.select("fam", "e", F.col("id").alias("y"), F.col("c").alias("d"), F.col("k").alias("l"), F.col("room").alias("place"))
    need = F.greatest(F.ceil((F.col("k") + F.col("l")) / (2 * whole)), F.lit(1))
    near = (F.col("id") < F.col("y")) & (F.col("c") != F.col("d")) & (F.least("room", "place") >= need)
    return star.unionByName(flat.join(other, ["fam", "e"]).where(near).select(F.col("id").alias("x"), "y"))


def similar(docs: DataFrame, k: int = K, percent: int = PERCENT, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows, links): doc_id, n_shingles, component_id per row; verified links that span the components.

    The links are a subset: pairs of a component that are known to be connected
    are not compared, so they give components, not the number of links of a document.

    A null doc_id links with nothing and has no component; null, empty and blank
    texts have no shingles and are components of their own. Equal sets are one
    node, the smallest doc_id's, so copies cost one hash each. Rows that repeat a
    doc_id with other texts belong to one component. A pair whose similarity ties with
    the threshold links, in integers. A very long text costs its length: one row
    with its buckets. An empty table gives no rows. Only doc_id and text are read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = base.where("id IS NOT NULL")
    index = saved(map_pandas(known, _indexer(k, percent), INDEX), "index")
    reps = index.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"))
    reps = saved(reps, "representatives")
    heads = saved(index.drop("buckets", "extra"), "heads")
    # representatives alone, written before their buckets are dealt, so that the two shuffles don't lie on disk together
    nodes = saved(index.join(reps.select(F.col("rep").alias("id"), "k1"), ["id", "k1"], "left_semi"), "nodes")
    discard(index)
    every = F.concat(F.col("buckets"), F.col("extra"))
    rows = nodes.select("id", "n_own", "n_up", "need_own", "need_up", F.posexplode(every).alias("at", "bucket"))
    # 0: own band, 1: the next, 2: always kept
    scheme = F.when(F.col("at") < F.col("n_own"), 0).when(F.col("at") < F.col("n_own") + F.col("n_up"), 1).otherwise(2)
    rows = rows.select("bucket", "id", scheme.cast("byte").alias("scheme"))
    by = Window.partitionBy("bucket")
    rows = rows.select("*", F.count("*").over(by).alias("size"), F.min("id").over(by).alias("low"), F.max("id").over(by).alias("high"))
    found = saved(rows.where("low < high").select("bucket", "id", "scheme", "size"), "buckets")
    discard(nodes)
    rows, nodes = found, heads.join(reps.select(F.col("rep").alias("id"), "k1"), ["id", "k1"], "left_semi")
    full = rows.where(F.col("size") > hot)
    if full.limit(1).count():
        skipped = full.where("scheme < 2").groupBy("id", "scheme").agg(F.count("*").alias("hot"))
        left = skipped.join(nodes.select("id", "n_own", "n_up", "need_own", "need_up"), "id")
        total = F.when(F.col("scheme") == 0, F.col("n_own")).otherwise(F.col("n_up"))
        need = F.when(F.col("scheme") == 0, F.col("need_own")).otherwise(F.col("need_up"))
        hard = left.where(total - F.col("hot") < need).select("id", "scheme").distinct()
        kept = full.join(hard, ["id", "scheme"], "left_semi").unionByName(full.where("scheme = 2"))
        rows = rows.where(F.col("size") <= hot).unionByName(kept)
    rows = saved(rows.select("bucket", "id").distinct(), "kept")
    discard(found)
    wanted = saved(rows.select("id").distinct(), "ids")
    sets = saved(map_pandas(known.join(hinted(wanted), "id", "left_semi"), _sets(k), "id long, s array<long>"), "sets")
    one, two = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(two, "b").join(one, "a")
        common = F.size(F.array_intersect("sa", "sb"))
        both = both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("n"))
        return both.where(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b").distinct()

    pivot = rows.groupBy("bucket").agg(F.min("id").alias("y"))
    tried = saved(_pairs(rows.join(pivot, "bucket").select(F.col("id").alias("x"), "y")), "pairs")
    # rows that repeat a doc_id with other texts tie the groups of these
    repeated = heads.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    repeated = heads.join(repeated, "id", "left_semi").join(reps, ["k1", "k2", "n"])
    tied = repeated.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    links = saved(verified(tried).unionByName(tied), "links")
    grouped = saved(components(links), "components")
    own = saved(rows.join(grouped, "id", "left").select("bucket", "id", F.coalesce("component_id", "id").alias("c")), "own")
    discard(rows)
    per = own.groupBy("bucket", "c").agg(F.count("*").alias("n")).groupBy("bucket")
    per = per.agg(F.sum("n").alias("n"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("cross"))
    # where two sets share a bucket, they have met; elsewhere the members of different components have not
    per = saved(per.where("cross > 0 AND n > 2").select("bucket", (F.col("cross") > FEW * F.col("n")).alias("crowded")), "open")
    one_c, two_c = own.select("bucket", F.col("id").alias("x"), "c"), own.select("bucket", F.col("id").alias("y"), F.col("c").alias("d"))
    met = one_c.join(per.where("NOT crowded").select("bucket"), "bucket").join(two_c, "bucket").where("c < d").select("x", "y")
    if per.where("crowded").limit(1).count():
        crowd = saved(own.join(per.where("crowded").select("bucket"), "bucket", "left_semi"), "crowd")
        met = met.unionByName(_centred(crowd, sets, percent))
    fresh = saved(_pairs(met).join(tried, ["a", "b"], "left_anti"), "pairs")
    new = saved(verified(fresh), "links")
    if new.limit(1).count():
        links = links.unionByName(new)
        grouped = saved(components(links), "components")
    discard(own, sets, tried)
    home = reps.join(grouped, reps.rep == grouped.id, "left").select("k1", "k2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    out = heads.select("id", "k1", "k2", "n").join(home, ["k1", "k2", "n"]).select("id", "n", "component_id")
    # blank texts and rows without an id are components of their own
    rest = base.where("id IS NULL OR NOT text RLIKE '[^ \\\\x09-\\\\x0D]'")
    rest = map_pandas(rest.select(F.col("id").cast("string").alias("id"), "text"), _sizes(k), "id string, n long")
    rest = rest.select(F.col("id").cast("long").alias("id"), "n", F.col("id").cast("long").alias("component_id"))
    out = out.unionByName(rest)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id"), links


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group of near copies: the one of smallest doc_id.

    All columns stay as they are. Rows without doc_id or words stay; of equal
    rows, or rows of one doc_id, all stay if their doc_id does.
    """
    rows, _ = similar(docs, k, percent)
    gone = rows.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(hinted(gone), "doc_id", "left_anti")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))[0]


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 0) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(reach)::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.id = w.doc_id GROUP BY ALL
"""
