"""Every stage of the pipeline against brute force over a small whole table, and the run against its stages."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from voxlake.llm import tokens, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """documents with toxic texts, copies, near copies and benchmark passages; nulls, blanks and a long text among them."""
    r, folder = random.Random(3), tmp_path_factory.mktemp("tables")
    vocabulary = ["".join(r.choices("abdefgiklmnoprstu", k=r.randint(3, 8))) for _ in range(900)]
    bad = ["vlamort", "vlamortig", "gruskel", "gruskeln"]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(30))) for i in range(6)]
    rows, toxic = [], {}
    for i in range(420):
        words = text(r.choice([8, 30, 60, 120]))
        kind = i % 12
        if kind == 1:
            for _ in range(max(4, len(words) // 6)):
                words[r.randrange(len(words))] = r.choice(bad)
        elif kind in (2, 3) and i > 40:
            words = rows[i - 40][1].split(" ")
            if kind == 3 and len(words) > 50:
                words[r.randrange(len(words))] = "changed"
        elif kind == 4:
            words[5:5] = items[i % 6][1].split()[3:20]
        toxic[i] = int(sum(w in bad for w in words) > 2)
        rows.append((i, " ".join(words), "en", ["web", "news", None][i % 3], 0))
    rows += [(900, None, "en", "web", 0), (901, "", None, "news", 0), (None, "a few words without an id", "en", "web", 0), (902, " ".join(text(20_000)), "en", "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def shingled(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set()


def multiset(df):
    return Counter(map(tuple, df.collect()))


def test_each_stage_is_brute_force_and_the_run_is_the_stages(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    labels = spark.read.parquet(f"{place}/labels.parquet")
    # toxicity: what is predicted goes, and nothing else; planted texts are found
    kept = c.saved(c.toxicity(spark, docs, place), "t1")
    predicted = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["predicted"]}
    assert multiset(kept) == Counter({k: n for k, n in multiset(docs).items() if k[0] not in predicted})
    true = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(true & predicted) >= 0.9 * len(true) and len(predicted - true) <= 4
    # near copies: one of each component
    one = c.saved(c.ngram_join(spark, kept, place), "t2")
    rows = kept.collect()
    sets, parent = {r["doc_id"]: shingled(r["text"]) for r in rows if r["doc_id"] is not None}, {}
    ids = sorted(sets)

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    gone = {i for i in ids if root(i) != i}
    assert len(gone) > 20
    assert multiset(one) == Counter({k: n for k, n in multiset(kept).items() if k[0] not in gone})
    # benchmark passages
    clean = c.saved(c.decontamination(spark, one, place), "t3")
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{place}/benchmark.parquet").collect() for w in [WORD.findall(r["text"])] for i in range(len(w) - 9)}
    hit = set()
    for r in one.collect():
        w = WORD.findall((r["text"] or "").lower())
        if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)):
            hit.add(r["doc_id"])
    assert len(hit) > 10
    assert multiset(clean) == Counter({k: n for k, n in multiset(one).items() if k[0] not in hit})
    # mixing: words by source near the targets, each text at most twice, words in order
    mixed = c.saved(c.mixing(spark, clean, place), "t4")
    assert mixed.columns == docs.columns
    own = {(r["doc_id"], r["source"]): (r["text"] or "").split() for r in clean.collect()}
    sizes, taken, times = Counter(), Counter(), Counter()
    for (_, source), words in own.items():
        sizes[source] += len(words)
    for r in mixed.collect():
        words = r["text"].split()
        rest = iter(own[r["doc_id"], r["source"]])
        assert all(w in rest for w in words)
        taken[r["source"]] += len(words)
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 2
    weights = dict(zip(sorted(sizes, key=lambda x: (x is None, x or "")), (5, 2, 1), strict=True))
    target, open_, left = {}, set(weights), 1.5 * sum(sizes.values())
    while True:
        share = {x: left * weights[x] / sum(weights[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] > 2 * sizes[x]}
        target |= {x: 2 * sizes[x] for x in full} if full else share
        if not full:
            break
        left, open_ = left - sum(2 * sizes[x] for x in full), open_ - full
    for x, want in target.items():
        assert abs(taken[x] - want) <= 64, (x, taken, target)
    # token ids, in order
    got = c.token_output(spark, mixed, place).orderBy("start").collect()
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(tokens.tokenizer_path()), 0
    texts = mixed.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    texts = sorted(texts, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    assert len(got) == len(texts)
    for r, x in zip(got, texts, strict=True):
        ids = np.array([*t.encode(x["text"], add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (x["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert multiset(c.run(spark, place)) == Counter(map(tuple, got))


def test_stages_on_an_empty_table(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, docs, place).count() == 0
