"""Near-duplicate vectors by a flat graph: robust-pruned shard graphs, united, searched from the shards' medoids.

1. Vectors of a label are split by k-means into shards of about SHARD vectors,
   without overlap; then each vector also joins the next shards that a link of
   it could stand in, OVERLAP in all.
2. Each shard builds a robust-pruned graph; a vector's lists are united.
3. Every vector searches its shards greedily, from the medoid and from itself,
   and goes on through all that is in range of it. Vectors found are verified
   with double precision. Found vectors that overlap into further shards hand the
   search over to these, until no shard is new: dense groups of any size are
   followed over all shards they reach.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discard, hinted, saved, ship, table

THRESHOLD = 0.98
#: Vectors of a shard about, shards that a vector is in at most, parts of one split at most, splits on each other.
SHARD, OVERLAP, PARTS, LEVELS = 256, 3, 64, 8
#: Vectors that the centroids of one split are fitted on, about (those of least hash), and steps.
FIT, FIT_STEPS = 4_000, 8
#: Vectors of a task that assigns to centroids; guests and visitors of a shard that one task takes, about.
ASSIGNED, VISITORS = 20_000, 1_024
#: Neighbours of a vector in one graph, candidates for these, and how much nearer a neighbour must be to a third
#: than the vector is for that one to be pruned (a factor of the distance).
DEGREE, POOL, ALPHA = 16, 48, 1.2
#: Vectors that a greedy search keeps, and expands at a time in range; how far below the threshold range reaches.
BEAM, WAVE, SLACK = 6, 8, 0.01


def _unit(v: pd.Series) -> np.ndarray:
    a = np.stack(v.to_numpy()).astype(float)
    a = a / np.abs(a).max(axis=1, keepdims=True)  # squares of very small or large components leave the range of doubles
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _clamp(x: int, low: int, high: int) -> int:
    return max(low, min(x, high))


# ---- shards --------------------------------------------------------------------------------------


def _fitter(shard: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        v, size = _unit(group["v"]), int(group["size"].iloc[0])
        k = min(_clamp(math.ceil(size / shard), OVERLAP, PARTS), len(v))
        c = v[np.linspace(0, len(v) - 1, k).astype(int)]
        for _ in range(FIT_STEPS):
            near = (v @ c.T).argmax(1)
            for j in range(k):
                mean = v[near == j].sum(0)
                if norm := np.linalg.norm(mean):
                    c[j] = mean / norm
        return pd.DataFrame({"cell": [key[0]], "centroids": [c.ravel().tolist()]})

    return run


PLACE = "id long, v array<double>, copies long, cell string, home boolean, gap double"


def _assigner(threshold: float):
    """Parts of a cell: the nearest for every vector, and, for those at home here, the next that a link may stand in.

    If w of part j links with v of part h, then v (c_h - c_j) <= |v - w| |c_h - c_j|,
    as w is no nearer to c_h than to c_j, and |v - w| is sqrt(2 - 2 threshold) at most.
    """
    reach = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6

    def run(key, rows: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or fitted.empty:  # no vector was drawn to fit on: left as it is
            return rows[[x.split()[0] for x in PLACE.split(", ")]]
        v = _unit(rows["v"])
        c = np.asarray(fitted["centroids"].iloc[0], float).reshape(-1, v.shape[1])
        sims = v @ c.T
        order = np.argsort(-sims, axis=1, kind="stable")[:, :OVERLAP]
        first = order[:, 0]
        apart = np.linalg.norm(c[:, None] - c[None], axis=2)
        out = []
        at = np.arange(len(v))
        for rank in range(order.shape[1]):
            part = order[:, rank]
            gap = sims[at, first] - sims[at, part]
            keep = rows["home"].to_numpy() & (gap <= reach * apart[first, part]) if rank else np.ones(len(v), bool)
            some = rows[keep]
            out.append(pd.DataFrame({
                "id": some["id"], "v": some["v"], "copies": some["copies"], "cell": [f"{key[0]}/{p}" for p in part[keep]],
                "home": some["home"] & (rank == 0), "gap": np.where(some["home"], gap[keep], some["gap"]),
            }))
        return pd.concat(out)

    return run


def shards(nodes: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """(id, v, copies, cell, home) of nodes (id, v, copies, cell): home in one shard, a guest in OVERLAP - 1 at most.

    Only vectors at home count for a shard's size and whether it is split, so
    overlap never multiplies. What k-means can't part in LEVELS splits is dealt by hash.
    """
    rows = saved(nodes.withColumns({"home": F.lit(True), "gap": F.lit(0.0)}), "places")
    done: list[DataFrame] = []
    for _ in range(LEVELS):
        sizes = saved(rows.where("home").groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > 2 * shard), "sizes")
        if not sizes.limit(1).count():
            break
        large = rows.join(hinted(sizes), "cell")
        part = F.pmod(F.xxhash64("id", "cell"), F.lit(1 << 20)) < F.col("size").cast("double") ** -1 * FIT * (1 << 20)
        fitted = large.where(F.col("home") & part).groupBy("cell").applyInPandas(_fitter(shard), "cell string, centroids array<double>")
        fitted = saved(fitted, "centroids")
        salts = F.ceil(F.col("size") / ASSIGNED)
        given = fitted.join(hinted(sizes), "cell").select("cell", "centroids", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        asked = large.withColumn("salt", F.pmod(F.xxhash64("id"), salts))
        parted = asked.groupBy("cell", "salt").cogroup(given.groupBy("cell", "salt")).applyInPandas(_assigner(threshold), PLACE)
        done.append(rows.join(hinted(sizes), "cell", "left_anti"))
        before, rows = rows, saved(parted, "places")
        done[-1] = saved(done[-1].select(*rows.columns), "places")
        discard(before, fitted, sizes)
    for d in done:
        rows = rows.unionByName(d)
    by = Window.partitionBy("id").orderBy(F.desc("home"), "gap", "cell")
    rows = rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= OVERLAP).drop("_r", "gap")
    rows = saved(rows, "places")
    sizes = rows.where("home").groupBy("cell").agg(F.ceil(F.count("*") / (2 * shard)).alias("parts"))
    crowded = saved(sizes.where("parts > 1"), "crowded")
    if crowded.limit(1).count():  # a vector is a guest in the next part, which ties the parts together
        met = rows.join(hinted(crowded), "cell")
        own = F.pmod(F.xxhash64("id"), F.col("parts"))
        where = F.array(own, F.pmod(own + 1, F.col("parts")))
        met = met.select("*", F.posexplode(F.when(F.col("home"), where).otherwise(F.slice(where, 1, 1))).alias("_at", "_part"))
        met = met.select("id", "v", "copies", F.concat_ws("#", "cell", "_part").alias("cell"), (F.col("home") & (F.col("_at") == 0)).alias("home"))
        rows = saved(rows.join(hinted(crowded), "cell", "left_anti").unionByName(met), "places")
    return rows


def _units(rows: DataFrame, who: str) -> DataFrame:
    """Rows of `who` (a column: those not at home) dealt to units of their shard, VISITORS each about; homes go to every unit.

    Adds unit, and asks: whether the row is to be searched for there (homes: in one unit).
    """
    counts = rows.groupBy("cell").agg(F.greatest(F.ceil(F.count_if(F.col(who)) / VISITORS), F.lit(1).cast("long")).alias("units"))
    rows = rows.join(hinted(saved(counts, "units")), "cell")
    own = F.pmod(F.xxhash64("id"), F.col("units"))
    every = F.sequence(F.lit(0).cast("long"), F.col("units") - 1)
    rows = rows.select("*", own.alias("_own"), F.explode(F.when(F.col(who), F.array(own)).otherwise(every)).alias("unit"))
    return rows.withColumn("asks", F.col("unit") == F.col("_own")).drop("_own", "units")


# ---- graphs --------------------------------------------------------------------------------------


def _pruned(v: np.ndarray, pool: np.ndarray, sims: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Robust pruning of each row's pool, nearest first: rows x degree, -1 where there are fewer.

    A candidate goes if one that is kept is nearer to it, by a factor of alpha, than the row's own vector is.
    """
    out = np.full((len(pool), degree), -1)
    for low in range(0, len(pool), 256):
        p, s = pool[low : low + 256], sims[low : low + 256]
        far = np.sqrt(np.maximum(2 - 2 * s, 0))
        w = v[p]
        between = np.sqrt(np.maximum(2 - 2 * (w @ w.transpose(0, 2, 1)), 0))
        alive, at = p >= 0, np.arange(len(p))
        for k in range(degree):
            next_ = alive.argmax(1)
            some = alive[at, next_]
            out[low : low + 256, k] = np.where(some, p[at, next_], -1)
            alive &= (alpha * between[at, next_] > far) | ~some[:, None]
            alive[at, next_] = False
    return out


def _builder(degree: int, pool: int, alpha: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        v, ids = _unit(group["v"]).astype(np.float32), group["id"].to_numpy()
        n = len(v)
        k = min(pool, n - 1)
        if k < 1:
            return pd.DataFrame({"id": ids, "near": pd.Series([[] for _ in ids], dtype=object)})
        near, sims = np.empty((n, k), int), np.empty((n, k), np.float32)
        for low in range(0, n, 256):
            s = v[low : low + 256] @ v.T
            at = np.arange(len(s))
            s[at, low + at] = -2
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
            near[low : low + 256], sims[low : low + 256] = top, np.take_along_axis(s, top, 1)
        lists = _pruned(v, near, sims, alpha, degree)
        # edges back, so that all are reached; the nearest ones where there are many
        src, dst = np.repeat(np.arange(n), degree), lists.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        both = np.unique(np.r_[src * n + dst, dst * n + src])
        a, b = both // n, both % n
        order = np.lexsort((-np.einsum("ij,ij->i", v[a], v[b]), a))
        a, b = a[order], b[order]
        first = np.searchsorted(a, np.arange(n + 1))
        own = [ids[b[first[i] : min(first[i + 1], first[i] + 2 * degree)]] for i in range(n)]
        return pd.DataFrame({"id": ids, "near": own})

    return run


# ---- search --------------------------------------------------------------------------------------

FOUND = "id long, links long, root long, hand array<struct<cell: string, entry: long>>"


def _searched(v: np.ndarray, near: np.ndarray, q: np.ndarray, seeds: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Similarities of the queries q with the vectors their searches met (-2: not met).

    Greedy first: the best of the beam is expanded until all of it is. Then
    whatever lies in range is expanded, WAVE at a time, until nothing new is met.
    """
    n, m = len(v), len(q)
    sims, done = np.full((m, n + 1), -2, np.float32), np.zeros((m, n + 1), bool)
    done[:, n] = True  # the column of absent neighbours
    row = np.arange(m)
    for s in seeds.T:
        sims[row, s] = np.einsum("ij,ij->i", q, v[s])

    def expand(r: np.ndarray, x: np.ndarray) -> np.ndarray:
        done[r, x] = True
        rr, nb = np.repeat(r, near.shape[1]), near[x].ravel()
        new = (nb < n) & (sims[rr, nb] < -1.5)
        key = np.unique(rr[new] * (n + 1) + nb[new])
        rr, nb = key // (n + 1), key % (n + 1)
        sims[rr, nb] = np.einsum("ij,ij->i", q[rr], v[nb])
        return rr, nb

    best = np.full((m, beam), n)
    best[:, : seeds.shape[1]] = seeds[:, :beam]
    active = row
    while len(active):
        own = best[active]
        score = np.where(done[active[:, None], own], -3, sims[active[:, None], own])
        pick = score.argmax(1)
        at = np.arange(len(active))
        open_ = score[at, pick] > -1.5
        active, own, at = active[open_], own[open_], at[open_]
        if not len(active):
            break
        x = own[np.arange(len(active)), pick[open_]]
        before = sims[active[:, None], near[x]] > -1.5
        expand(active, x)
        fresh = np.where(before, n, near[x])
        wide = np.concatenate([own, fresh], axis=1)
        score = np.where(wide < n, sims[active[:, None], wide], -3)
        top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        best[active] = np.take_along_axis(wide, top, 1)
    rr, nb = np.nonzero((sims >= least) & ~done)
    while len(rr):
        rank = np.arange(len(rr)) - np.searchsorted(rr, rr)
        wave = rank < WAVE
        r2, n2 = expand(rr[wave], nb[wave])
        good = sims[r2, n2] >= least
        key = np.unique(np.r_[rr[~wave] * (n + 1) + nb[~wave], r2[good] * (n + 1) + n2[good]])
        rr, nb = key // (n + 1), key % (n + 1)
    return sims[:, :n]


def _rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component under links a-b."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _searcher(threshold: float, beam: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        ids, home, asks = group["id"].to_numpy(), group["home"].to_numpy(bool), group["asks"].to_numpy(bool)
        exact, copies = _unit(group["v"]), group["copies"].to_numpy()
        v, n = exact.astype(np.float32), len(ids)
        row = np.repeat(np.arange(n), group["near"].map(len).to_numpy())
        own = np.concatenate([np.asarray(x, np.int64) for x in group["near"]])
        at = np.minimum(np.searchsorted(ids, own), n - 1)
        here = ids[at] == own  # neighbours of other shards are not here
        row, at = row[here], at[here]
        size = np.bincount(row, minlength=n)
        near = np.full((n, max(int(size.max()), 1)), n)
        near[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = at
        medoid = np.flatnonzero(home)[(exact[home] @ exact[home].mean(0)).argmax()] if home.any() else 0
        name = group["cell"].iloc[0]
        code = {c: i for i, c in enumerate(sorted({c for cs in group["cells"] for c in cs if c != name}))}
        names, lead = list(code), np.full((n, OVERLAP), -1)  # where else each one is
        for i, cs in enumerate(group["cells"]):
            for j, c in enumerate(c for c in cs if c != name):
                lead[i, j] = code[c]
        links, hands, la, lb = np.zeros(n, np.int64), [[] for _ in range(n)], [], []
        ask = np.flatnonzero(asks)
        for low in range(0, len(ask), 256):
            q = ask[low : low + 256]
            seeds = np.stack([np.full(len(q), medoid), q], axis=1)
            met = _searched(v, near, v[q], seeds, threshold - SLACK, max(beam, 3))
            r, x = np.nonzero(met >= threshold - 1e-4)
            true = (np.einsum("ij,ij->i", exact[q[r]], exact[x]) >= threshold) & (q[r] != x)
            r, x = r[true], x[true]
            count = home[x]  # a vector is counted where it is at home, so once
            np.add.at(links, q[r[count]], copies[x[count]])
            la.append(q[r]), lb.append(x)
            if names:
                q_, x_ = np.repeat(q[r], OVERLAP), np.repeat(x, OVERLAP)
                to = lead[x].ravel()
                key, first = np.unique(q_[to >= 0] * len(names) + to[to >= 0], return_index=True)
                for k, i in zip(key.tolist(), x_[to >= 0][first].tolist(), strict=True):
                    hands[k // len(names)].append({"cell": names[k % len(names)], "entry": int(ids[i])})
        root = _rooted(n, np.concatenate(la), np.concatenate(lb)) if la else np.arange(n)
        keep = asks & ((links > 0) | (root != np.arange(n)) | np.array([bool(h) for h in hands], bool))
        keep |= root != np.arange(n)
        out = pd.DataFrame({"id": ids[keep], "links": links[keep], "root": ids[root[keep]]})
        out["hand"] = pd.Series([hands[i] for i in np.flatnonzero(keep)], dtype=object)
        return out

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Vectors are compared by cosine when their labels and widths are equal; those
    that are null, zero, or hold nulls or non-finite components, and rows without
    vec_id or label, link with nothing. Equal vectors are one node that counts
    its copies. Of rows that repeat a vec_id with other vectors, each row is a
    vector of its own, and its links are counted by row. Other columns are
    ignored; an empty table gives no rows.

    Links come from a graph search, so some may be missed (`recall` measures it);
    none found is below the threshold. A vector's links are those its own search
    found. Tasks return counts and trees of links, never all pairs.
    """
    ship(vectors.sparkSession)
    fine = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.col("label").cast("string")).alias("label"), F.when(fine, F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    hashed = base.select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h2"))
    nodes = hashed.where("v IS NOT NULL").groupBy("label", "h", "h2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("v").alias("v")
    )
    nodes = saved(nodes, "vectors")
    # a node's id is its least vec_id, or a hash where that has several vectors
    several = nodes.groupBy("least").agg(F.count("*").alias("_n")).where("_n > 1")
    nodes = nodes.join(hinted(saved(several, "repeated")), "least", "left")
    nodes = nodes.withColumn("id", F.when(F.col("_n").isNull(), F.col("least")).otherwise(F.xxhash64("h", "h2"))).drop("_n")
    placed = shards(nodes.select("id", "v", "copies", F.concat_ws(":", "label", F.size("v")).alias("cell")), threshold, shard)
    built = _units(placed.withColumn("guest", ~F.col("home")), "guest")
    graph = built.groupBy("cell", "unit").applyInPandas(_builder(DEGREE, POOL, ALPHA), "id long, near array<long>")
    graph = saved(graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")  # a list per shard
    cells = placed.groupBy("id").agg(F.collect_list("cell").alias("cells"))  # OVERLAP at most
    members = saved(placed.join(graph, "id").join(cells, "id"), "members")
    discard(placed)
    # the first search: all members of a shard; later ones: visitors that are handed over
    ask = members.withColumns({"guest": ~F.col("home"), "new": F.lit(True)})
    been, results = members.select("id", "cell"), []
    while True:
        units = _units(ask, "guest").withColumn("asks", F.col("asks") & F.col("new"))
        found = saved(units.groupBy("cell", "unit").applyInPandas(_searcher(threshold, beam), FOUND), "found")
        results.append(found)
        to = found.select("id", F.explode("hand").alias("_h")).select("id", "_h.*").groupBy("id", "cell").agg(F.min("entry").alias("entry"))
        to = saved(to.join(been, ["id", "cell"], "left_anti"), "visits")
        if not to.limit(1).count():
            break
        been = been.unionByName(to.select("id", "cell"))
        # a visitor stands in no list here; it starts from the neighbours of the vector that led to it
        visitors = to.join(nodes.select("id", "v", "copies"), "id").join(graph.withColumnRenamed("id", "entry"), "entry")
        visitors = visitors.withColumns({"home": F.lit(False), "cells": F.array().cast("array<string>"), "guest": F.lit(True), "new": F.lit(True)})
        hosts = members.where("home").join(to.select("cell").distinct(), "cell", "left_semi")
        hosts = hosts.withColumns({"guest": F.lit(False), "new": F.lit(False)})
        ask = hosts.unionByName(visitors.select(*hosts.columns))
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    links = every.groupBy("id").agg(F.sum("links").alias("links"))
    trees = components(every.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b"))
    # components are named by their least vec_id
    named = nodes.select("id", "least").join(trees, "id").groupBy("component_id").agg(F.min("least").alias("name"))
    trees = trees.join(named, "component_id").select("id", "name")
    keys = nodes.join(links, "id", "left").join(trees, "id", "left").select(
        F.col("label").alias("_l"), F.col("h").alias("_h"), F.col("h2").alias("_h2"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("name", "least").alias("c"),
    )
    out = hashed.join(keys, (hashed.label == keys._l) & (hashed.h == keys._h) & (hashed.h2 == keys._h2), "left")
    component = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


def recall(vectors: DataFrame, result: DataFrame, threshold: float = THRESHOLD, every: int = 100) -> float:
    """Share of the links of vectors whose vec_id is divisible by `every` that `result` has; brute force against all rows.

    The audit: a stated query set, in blocks. vec_ids are taken to be unique.
    """
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("most", F.array_max(F.transform("v", F.abs))).withColumn("v", F.transform("v", lambda x: x / F.col("most"))).drop("most")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("norm", norm).where("norm > 0 AND norm < double('infinity')")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), "label", F.col("v").alias("w"), F.col("norm").alias("wn"))
    both = rows.join(asked, "label").where("vec_id <> q AND size(v) = size(w)")
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    true = both.where(dot >= threshold * F.col("norm") * F.col("wn")).groupBy("q").agg(F.count("*").alias("n"))
    met = result.join(true, result.vec_id == true.q).agg(F.sum(F.least("n_links", "n")).alias("met"), F.sum("n").alias("n")).first()
    return (met["met"] or 0) / (met["n"] or 1) if met["n"] else 1.0


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= {THRESHOLD}),
r(id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(reach)::BIGINT AS component_id, v.vec_id = min(reach) AS kept
FROM v JOIN r ON r.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
"""
