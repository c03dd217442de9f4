"""Packing, collocations and the filter audit against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import audit, collocations, packing

DOCS = "doc_id long, text string, lang string, source string, ids int, part string, phrase string, f int, start int, A int, digest string, n int"
MORE = (9, "p", "q", 1, 2, 3, "d", 4)


def make(n=80, seed=4):
    r = random.Random(seed)
    words = "le la Maison verte est ouverte a tous et the New YORK times said é ÈME don't re-do x2 <|endoftext|> 日本 #tag".split()
    phrase = ["carte bleue marine claire", "New York Times", "carte bleue"]
    out = []
    for i in range(n):
        text = ""
        for _ in range(r.choice([0, 1, 5, 40, 300])):
            text += r.choice([*words, *phrase, *phrase]) + r.choice([" ", " ", " ", "  ", ", ", ".\n", "\t", "! ", "  "])
        out.append((i, text, r.choice(["fr", "en", None]), r.choice(["s0", "s1", None]), *MORE))
    out += [(200, None, None, None, *MORE), (None, out[4][1], "en", "", *MORE), (7, out[7][1], "fr", "s0", *MORE), (201, out[3][1], "fr", "s1", *MORE), (202, "", "en", "s1", *MORE)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), DOCS).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- packing -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_encoder_equals_the_tokenizer_on_whole_texts(tokenizer):
    r = random.Random(3)
    pool = [*"ab éÈ\n\t\r '`s1٣½.,;:-—“<>|日本🙂\x0b\x85  ​　\x1c", "'s", "'ll", " 'm", "<|endoftext|>", "  ", "\n\n ", " \n", " word"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(4_000)] + [x[1] or "" for x in make()]
    got = list(packing.ByteEncoder(packing.tokenizer_path())(texts))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [x[1] or "" for x in make()[:20]]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(packing.ByteEncoder(path)(texts)) == want


@pytest.mark.parametrize(("length", "window"), [(2048, 1 << 20), (64, 1_000), (2048, 1)])
def test_every_token_lies_in_one_piece(spark, docs, tokenizer, length, window):
    packed = packing.sequences(docs, packing.tokenizer_path(), length=length, window=window).cache()
    rows = packing.pieces(packed).collect()
    want = Counter()
    for doc, text, *_ in make():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc, np.array(ids, "<u4").tobytes()] += 1
    own = {}
    for r in rows:
        own.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    got = Counter()
    for (doc, n), some in own.items():  # repeated documents have the same pieces of ids, cut perhaps elsewhere
        queue = sorted(some, key=lambda r: r["start"])
        while queue:
            text, left = b"", []
            for r in queue:
                if r["start"] == len(text) // 4:
                    assert len(r["ids"]) == 4 * r["length"] > 0
                    text += bytes(r["ids"])
                else:
                    left.append(r)
            assert len(text) == 4 * n
            got[doc, text] += 1
            queue = left
    assert got == want
    for s in packed.collect():
        assert s["n_tokens"] == s["n_padded"] == len(s["ids"]) // 4 <= length
        assert s["offset"] == np.cumsum([0, *s["length"][:-1]]).tolist() and sum(s["length"]) == s["n_tokens"]
        assert s["n_tokens"] == length or s["n_tokens"] & (s["n_tokens"] - 1) == 0
    ids = [r["sequence_id"] for r in packed.collect()]
    assert len(set(ids)) == len(ids)


def test_packing_of_nothing(spark, empty):
    assert packing.sequences(empty, packing.tokenizer_path()).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in packing.pieces(packing.sequences(one, packing.tokenizer_path())).collect()] == [(None, 0, 1, 1, 0, bytes([1, 0, 0, 0]))]
    with pytest.raises(ValueError, match="power of two"):
        packing.sequences(one, packing.tokenizer_path(), length=1000)


def test_balance_takes_the_sequence_of_least_cost():
    """Against a plain loop; sequences cost about the same, unlike those filled in order of arrival."""
    r = np.random.default_rng(5)
    sizes = r.lognormal(5.5, 1, 3_000).astype(int) % 2047 + 1
    parts = [(i, 0, int(n), bytes(4 * int(n))) for i, n in enumerate(sizes)]
    count = int(sizes.sum()) // 2048
    filled, left = packing.balance(parts, count)
    assert all(sum(len(p[3]) for p in own) == 4 * 2048 for own in filled)
    assert sum(len(p[3]) for p in left) // 4 == sizes.sum() - 2048 * count < 2048
    costs, room, whole = [0.0] * count, [2048] * count, {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [j for j in range(count) if room[j] >= sizes[i]]
        if fits:
            j = min(fits, key=lambda j: costs[j])
            whole[i] = j
            costs[j] += packing.cost(int(sizes[i]))
            room[j] -= sizes[i]
    assert {p[0]: j for j, own in enumerate(filled) for p in own if p[0] in whole} == whole
    spread = lambda own: np.std([sum(packing.cost(len(p[3]) // 4) for p in s) for s in own])
    arrival, at = [[]], 2048
    for p in parts:
        if len(p[3]) // 4 > at:
            arrival.append([])
            at = 2048
        arrival[-1].append(p)
        at -= len(p[3]) // 4
    assert spread(filled) < spread(arrival[:-1]) / 1.5


def test_rest_is_cut_at_powers_of_two():
    parts = [(1, 0, 900, bytes(3600)), (2, 5, 805, bytes(3200))]
    sizes = [sum(len(p[3]) for p in own) // 4 for own in packing.in_powers(parts)]
    assert sizes == [1024, 512, 128, 32, 4] and sum(sizes) == 1700
    assert packing.in_powers([]) == []
    assert [packing.padded(n) for n in (1, 3, 1024, 1500, 2048)] == [1, 2048, 1024, 2048, 2048]


# ---- collocations --------------------------------------------------------------------------------


def brute_collocations(rows, min_count, top, max_n=4):
    counts, total = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = (text or "").encode().lower().decode()
        for mark in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(mark, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    key = lang, tuple(words[i : i + n])
                    counts[key] = counts.get(key, 0) + 1
    out = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < min_count:
            continue
        score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(other == lang and len(q) > len(p) and b >= min_count and 100 * b >= 80 * a and inside(q) for (other, q), b in counts.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


@pytest.mark.parametrize(("min_count", "top"), [(30, 2_000), (5, 40), (1, 25)])
def test_collocations_are_brute_force(docs, min_count, top):
    got = [tuple(r) for r in collocations.collocations(docs, min_count=min_count, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_collocations(make(), min_count, top)


def test_a_full_bit_map_changes_nothing(docs, monkeypatch):
    """Whatever the map lets through, exact counts decide."""
    monkeypatch.setattr(collocations, "frequent_pairs", lambda rows, min_count: b"\xff" * 4096)
    got = {tuple(r) for r in collocations.collocations(docs, min_count=5).collect()}
    assert got == brute_collocations(make(), 5, 2_000)


def test_words_over_segments(monkeypatch):
    """Hashes don't depend on where a text is taken apart."""
    text = ["Le chat, le CHIEN; é " * 50, "w" * 300 + " le chat"]
    whole = collocations.Words([t.encode() for t in text])
    h = whole.hashes()
    words = [whole.text[a:e] for a, e in zip(whole.starts, whole.ends, strict=True)]
    assert len({w: x for w, x in zip(words, h.tolist(), strict=True)}) == len(set(h.tolist())) == len(set(words))
    monkeypatch.setattr(collocations, "TEXT_BYTES", 64)
    again = whole.hashes()
    short = np.array([len(w) <= 64 for w in words])
    assert (again[short] == h[short]).all() and len(set(again.tolist())) == len(set(words))


def test_collocations_of_nothing(spark, empty):
    assert collocations.collocations(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ,; ", "en"), (3, "one", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(blank, min_count=1).count() == 0


# ---- the filter audit ----------------------------------------------------------------------------


def brute_audit(rows, labels):
    space = " \t\n\x0b\x0c\r"
    first, flags = {}, []
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, text, _, source, *_ in rows:
        x = text or ""
        words = "".join(" " if c in space else c for c in x).split(" ")
        words = [w for w in words if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in x) > 2 * len(x),
            "D": any(c in "#$%&*|" for c in x),
            "E": doc is not None and first[x] < doc,
        }
        own = [r for r in labels if doc is not None and r[0] == doc]
        flags.append((source or "", fails, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    out, total = {}, Counter()
    for part in {f[0] for f in flags}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in flags if f[0] == part]
            every = left
            for k, c in enumerate(order):
                gone = [f for f in left if f[1][c]]
                left = [f for f in left if not f[1][c]]
                fail = [f for f in every if f[1][c]]
                out[part, order, k + 1] = [len(left), len(gone), len(fail) - len(gone), sum(sum(f[1].values()) == 1 for f in fail), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                total[part, c] += len(gone)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(i, int(i % 2 == 0) if i % 5 else None, int(i % 9 == 0)) for i in range(0, 70)] + [(None, 1, 1), (7, 1, 0), (7, 0, 1), (201, 1, 1)]


def test_filter_audit_is_brute_force(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.interactions(audit.document_flags(docs, labels), "ABCDE", ("good", "toxic"))
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 600 * 3 and set(rows) == brute_audit(make(), LABELS)


def test_filter_audit_of_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.document_flags(empty, labels), "ABCDE", ("good", "toxic")).count() == 0


def test_prefixes_are_visited_once(spark, monkeypatch):
    """2^n - 1 states have edges out of them, whatever the number of orders; null flags pass."""
    seen = []
    own = audit.saved
    monkeypatch.setattr(audit, "saved", lambda df, name: seen.append(name) or own(df, name))
    flags = spark.createDataFrame([("p", True, None, False), ("p", True, True, None), ("q", False, False, False)], "part string, x boolean, y boolean, z boolean")
    edges = {tuple(r) for r in audit.edges(flags, ["x", "y", "z"], []).collect()}
    assert seen.count("edges") == 7
    assert ("p", 0, 2, 0, 2) in edges and ("p", 0, 2, 1, 1) in edges and ("p", 2, 1, 0, 1) in edges and ("q", 3, 1, 2, 0) in edges
    assert not any(e[0] == "p" and e[1] & 1 for e in edges)  # nothing of p survives x


def test_crc_of_pieces(spark, docs):
    packed = packing.pieces(packing.sequences(docs, packing.tokenizer_path())).select("ids", F.crc32("ids").alias("c"))
    assert all(r["c"] == zlib.crc32(bytes(r["ids"])) for r in packed.collect())
