"""Operators in Python against plain loops and known values."""

import hashlib
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest

from voxlake.operators import selection, signal, text

DATA = "/root/testdata/sf0.001"


def run(spark, name):
    import voxlake.plans.library  # noqa: F401
    from voxlake.plans.registry import QUERIES

    return QUERIES[name](spark, DATA).collect()


def test_text_functions(spark):
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r["text"] == " ".join(unicodedata.normalize("NFC", documents[r["doc_id"]]).split()) for r in run(spark, "composed_texts"))
    for r in run(spark, "blake_splits"):
        b = int.from_bytes(hashlib.blake2b(r["source"].encode(), digest_size=2).digest(), "big") % 100
        assert r["split"] == ("test" if b < 5 else "val" if b < 10 else "train")
    talks = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    for r in run(spark, "token_similarity"):
        a, b = talks[r["conv_id"], r["turn"] - 1].split(), talks[r["conv_id"], r["turn"]].split()
        assert abs(SequenceMatcher(None, a, b, autojunk=False).ratio() - r["similarity"]) < 1e-6
    chunks = run(spark, "clause_chunks")
    by = {}
    for r in sorted(chunks, key=lambda r: r["place"]):
        by.setdefault((r["conv_id"], r["turn"]), []).append(r["clause"])
        assert len(r["clause"].split()) <= 14
    assert all(" ".join(v).split() == talks[k].split() for k, v in by.items())
    assert text.clauses("one two, three four five. six") == ["one two,", "three four five. six"]
    names = [r["name"] for r in run(spark, "safe_identifiers")]
    assert all(len(n) <= 47 and n[-11] == "-" for n in names)
    nulls = spark.createDataFrame([(None,), ("",)], "t string").select(text.composed("t"), text.pair_split("t"), text.clause_list("t"), text.similarity("t", "t")).collect()
    assert nulls[0][1] is None and nulls[0][2] == [] and nulls[1][3] == 1.0


def digest(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def walked_shares(rows, target, most, share):
    """One decision after the other."""
    used, out, open_ = {}, [], [r for r in rows if r["channel"] and r["size"] > 0 and r["weight"] > 0]
    weight = {c: max(r["weight"] for r in open_ if r["channel"] == c) for c in {r["channel"] for r in open_}}
    while sum(used.values()) < target:
        heads = {}
        for r in sorted(open_, key=lambda r: digest(r["episode_id"])):
            c = r["channel"]
            if c not in heads and sum(used.values()) + r["size"] <= most and used.get(c, 0) + r["size"] <= int(target * share):
                heads[c] = r
        if not heads:
            break
        r = min(heads.values(), key=lambda r: (used.get(r["channel"], 0) / weight[r["channel"]], r["priority"], r["channel"], digest(r["episode_id"])))
        used[r["channel"]] = used.get(r["channel"], 0) + r["size"]
        open_.remove(r)
        out.append(r["episode_id"])
    return out


@pytest.mark.parametrize(("target", "most", "share"), [(4_000, 4_050, 0.55), (4_000, 4_001, 0.3), (10**9, 10**9, 1.0), (900, 1_300, 0.9)])
def test_fair_shares_are_those_of_a_walk(spark, target, most, share):
    r = np.random.default_rng(3)
    rows = [{"episode_id": i, "channel": "abcd"[int(r.integers(0, 4)) % (1 + i % 4)], "size": int(r.integers(1, 200)), "weight": float(r.integers(1, 4)), "priority": int(r.integers(0, 2))} for i in range(160)]
    rows += [{"episode_id": 900, "channel": "", "size": 5, "weight": 1.0, "priority": 0}, {"episode_id": 901, "channel": "a", "size": 0, "weight": 1.0, "priority": 0}]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "episode_id long, channel string, size long, weight double, priority int")
    got = [x["episode_id"] for x in sorted(selection.fair_shares(df, target, most, share).collect(), key=lambda x: x["place"])]
    assert got == walked_shares(rows, target, most, share)


def test_fair_shares_of_nothing(spark):
    none = spark.createDataFrame([], "episode_id long, channel string, size long, weight double, priority int")
    assert selection.fair_shares(none, 10, 10, 1.0).count() == 0


def test_covering_takes_the_most_new_facets(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    left = {x["doc_id"]: {("l", x["lang"]), ("s", x["source"]), ("b", x["n_chars"] % 5)} for x in documents}
    seen, want = set(), []
    while left and len(want) < 40:
        best = max(left, key=lambda i: (len(left[i] - seen), digest(i)))
        seen |= left.pop(best)
        want.append(best)
    assert [x["id"] for x in sorted(run(spark, "set_cover_sample"), key=lambda x: x["place"])] == want
    none = spark.createDataFrame([], "id long, x string")
    assert selection.covering(none, ["x"], 3).count() == 0


def test_signal_features(spark):
    t = np.arange(16_000) / 16_000
    tone = np.sin(2 * np.pi * 220 * t)
    f = signal.frames(tone)
    assert f.shape == (49, 640) and signal.frames(tone[:10]).shape == (1, 640)
    assert np.allclose(signal.log_energy(f), 10 * np.log10(0.5), atol=0.2)
    assert np.allclose(signal.zero_crossings(f), 2 * 220 / 16_000, atol=0.002)
    assert np.allclose(signal.pitch(f), 220, atol=2) and (signal.pitch(np.random.default_rng(0).normal(size=(9, 640))) == 0).all()
    assert signal.mfcc(f).shape == (49, 13) and signal.features(tone).shape == (49, 30)
    assert (signal.features(tone)[0, 13:26] == 0).all()
    mel = signal.log_mel(f).mean(0)
    assert mel.argmax() == signal.mel_bank()[:, round(220 * 512 / 16_000)].argmax()
    loud = np.concatenate([tone, tone * 0.001])
    assert signal.snr(loud) > 40 and signal.snr(tone[:700]) == 0.0
    assert len(signal.context(tone)) == 90
    both = signal.mixture(tone[:100], tone[:100], 50, 0.5)
    assert len(both) == 150 and np.allclose(both[100:], 0.5 * tone[50:100])
    assert len(run(spark, "clip_features")) == spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding IS NOT NULL").count()


def test_boosted_trees(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v], float(v[0] + v[1] > 0)) for i, v in enumerate(r.normal(size=(300, 4)))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double")
    model = signal.boosted(df.where("id % 3 <> 0"), "y", "x", maxIter=10)
    held = model.transform(signal.as_vectors(df.where("id % 3 = 0"), "x"))
    assert held.where("prediction = y").count() >= 0.85 * held.count()
