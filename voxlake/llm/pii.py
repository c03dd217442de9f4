"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal it."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_udf, hinted, map_pandas, saved, small, table

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count as beside it.
BESIDE = 3
#: A term discloses entities in general if it stands beside at least so many different ones, ...
LEAST_BESIDE = 5
#: ... at least this share of its places is beside one, ...
LEAST_SHARE = 0.5
#: ... and knowing it tells at least so many bits (pointwise mutual information). It discloses one entity
#: if in that share of its documents it stands within CONTEXT words of the entity, and that tells so many bits.
LEAST_BITS = 3.0
CONTEXT = 40
#: Terms that may pass by chance in the whole corpus, on average, for either kind.
CHANCE = 0.01
#: Terms that an entity may have: any number.
MOST_TERMS = math.inf
#: Disclosing terms that are handed to every task at most; beyond, they are joined.
BROADCAST_TERMS = 200_000
#: Bits of the filter that spares the join words that are no terms, at most.
FILTER_BITS = 28

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match begins where a run of digits does, as later starts fail like the first; saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping spans per kind, by kind as listed, then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # a mail address: from the first local character of the run before the @
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p) <= 255 if len(p) < 19 else int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def _beside(text: str, spans: list[tuple[str, int, int]], reach: int = BESIDE) -> list[tuple[int, int, str]]:
    """Words (start, end, word) within `reach` words of a span; words inside spans are none."""
    found: dict[int, tuple[int, int, str]] = {}
    for _, start, end in spans:
        low = start
        for _ in range(reach + 1):  # white space before the words on the left
            low = max(text.rfind(" ", 0, max(low - 1, 0)), text.rfind("\n", 0, max(low - 1, 0)), -1) + 1
        left = [m for m in _WORD.finditer(text, low, start)][-reach:]
        right = []
        for m in _WORD.finditer(text, end):
            right.append(m)
            if len(right) == reach:
                break
        for m in (*left, *right):
            if not any(s < m.end() and m.start() < e for _, s, e in spans):
                found[m.start()] = (m.start(), m.end(), m[0].lower())
    return [found[k] for k in sorted(found)]


def _outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str]]:
    """Every word (start, end, word) that is not in a span."""
    ordered, i, done = sorted((s, e) for _, s, e in spans), 0, 0
    for m in _WORD.finditer(text):
        while i < len(ordered) and ordered[i][0] < m.end():
            done, i = max(done, ordered[i][1]), i + 1
        if m.start() >= done:
            yield m.start(), m.end(), m[0].lower()


def _words(text: str) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text))}


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places and documents of each word, and places beside an entity, summed over a batch of texts."""
    for batch in batches:
        every: Counter = Counter()
        near: Counter = Counter()
        docs: Counter = Counter()
        for text in batch["text"]:
            found = Counter(_WORD.findall(text.lower()))
            every.update(found)
            if spans := base_spans(text):
                near.update(w for _, _, w in _beside(text, spans))
                docs.update({w for _, _, w in _outside(text, spans)})
            else:
                docs.update(found.keys())
        words = list(every.keys() | docs.keys())
        columns = {"n": every, "beside": near, "docs": docs}
        yield pd.DataFrame({"term": words} | {c: [x[w] for w in words] for c, x in columns.items()})


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text with entities: these, each with the words beside it and those in its context, but none that is in an entity."""
    for batch in batches:
        out = []
        for text in batch["text"]:
            if spans := base_spans(text):
                each: dict[str, tuple[set[str], set[str]]] = {}
                outside = {at for at, _, _ in _outside(text, spans)}
                for span in spans:
                    near, far = each.setdefault(text[span[1] : span[2]].lower(), (set(), set()))
                    near.update(w for at, _, w in _beside(text, [span]) if at in outside)
                    far.update(w for at, _, w in _beside(text, [span], CONTEXT) if at in outside)
                out += [(entity, sorted(near), sorted(far)) for entity, (near, far) in each.items()]
        yield pd.DataFrame(out, columns=["entity", "beside", "context"])


def _by_chance(seen: Column, expected: Column, tests: int) -> Column:
    """log2 of a bound on how many of `tests` counts reach `seen` by chance: Chernoff's for a sum of rare events."""
    return seen * F.log2(F.lit(math.e) * expected / seen) + F.lit(math.log2(max(tests, 1)))


def disclosing(
    docs: DataFrame, least_beside: int = LEAST_BESIDE, least_share: float = LEAST_SHARE, least_bits: float = LEAST_BITS, chance: float = CHANCE
) -> DataFrame:
    """(term, bits) of the terms that reveal an entity; all words of all documents are counted.

    Two kinds: terms that stand beside `least_beside` different entities or more
    (of any kind), where bits is log2 of P(beside an entity | term) over P(beside
    an entity); and terms of one entity that has two contexts or more, in which they stand, where it is log2
    of P(entity | term) over P(entity). Equal contexts of an entity, as copies have them, count once. Either must be more than chance: over all terms of the corpus (and all such
    entities) `chance` terms would do as well. So a rare word of a single document with an address is no term,
    as any word there would be. An entity may have any number of terms.

    A document gives an entity the words of its context, so pairs grow with the texts, however many entities a page lists. Counts are summed per
    batch before the shuffle, and written, as several steps read them. Ties with a bound pass; an empty table has no terms.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    names = ("n", "beside", "docs")
    counts = map_pandas(rows, _counts, "term string, " + ", ".join(f"{c} long" for c in names))
    counts = saved(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]), "words")
    first = counts.agg(F.sum("n").alias("all"), F.sum("beside").alias("beside"), F.count("*").alias("terms")).first()  # one row
    n_docs, terms, limit = max(rows.count(), 1), first["terms"], math.log2(chance)
    prior = (first["beside"] or 0) / (first["all"] or 1) or 1.0
    each = saved(map_pandas(rows, _entities, "entity string, beside array<string>, context array<string>"), "entities")
    beside = each.select("entity", F.explode("beside").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("different"))
    near = counts.where(F.col("beside") >= least_share * F.col("n")).join(beside.where(F.col("different") >= least_beside), "term")
    near = near.where(_by_chance(F.col("beside"), F.col("n") * prior, terms) <= limit)
    near = near.select("term", F.log2(F.col("beside") / F.col("n") / F.lit(prior)).alias("bits"))
    contexts = saved(each.select("entity", "context").distinct(), "contexts")
    known = saved(contexts.groupBy("entity").agg(F.count("*").alias("n_entity")).where("n_entity > 1"), "repeated")
    pairs = contexts.join(hinted(known), "entity").select("entity", "n_entity", F.explode("context").alias("term"))
    pairs = pairs.groupBy("entity", "n_entity", "term").agg(F.count("*").alias("both")).where("both > 1")
    pairs = pairs.join(counts.select("term", "docs"), "term").where(F.col("both") >= least_share * F.col("docs"))
    bits = F.log2(F.col("both") / F.col("docs") / F.col("n_entity") * F.lit(float(n_docs)))
    expected = F.col("n_entity") * F.col("docs") / F.lit(float(n_docs))
    pairs = pairs.withColumn("bits", bits).where((F.col("bits") >= least_bits) & (_by_chance(F.col("both"), expected, terms * known.count()) <= limit))
    found = near.where(F.col("bits") >= least_bits).unionByName(pairs.select("term", "bits"))
    return found.groupBy("term").agg(F.max("bits").alias("bits"))


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, sanitised string"


def _row(text: str, terms) -> tuple:
    spans = base_spans(text)
    some = len(terms) and not terms.isdisjoint(_words(text))
    added = [("term", s, e) for s, e, w in _outside(text, spans) if w in terms] if some else []
    n = Counter(k for k, _, _ in spans)
    clean, at = [], 0
    for k, s, e in sorted(spans + added, key=lambda x: (x[1], -x[2])):
        if s >= at:  # overlapping spans are replaced once
            clean += [text[at:s], f"[{k}]"]
        at = max(at, e)
    base = hashlib.sha256(_digest(spans).encode()).hexdigest()
    return (*(n[k] for k in KINDS), base, _digest(spans + added), "".join([*clean, text[at:]]))


_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _finder(terms: frozenset[str]):
    return lambda texts: pd.DataFrame([_row(t, terms) for t in texts], columns=_NAMES)


def _find_own(texts: pd.Series, terms: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_row(t, set(own)) for t, own in zip(texts, terms, strict=True)], columns=_NAMES)


def _filter(terms: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words of 64 bits): bit crc32(term) mod 2^bits is set for each term. Of bounded size."""
    bits = min(max(terms.count().bit_length() + 4, 6), FILTER_BITS)
    at = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(1 << bits))
    rows = terms.select(at.alias("at")).selectExpr("CAST(at DIV 64 AS INT) AS word", "shiftleft(1L, CAST(at % 64 AS INT)) AS one")
    rows = rows.groupBy("word").agg(F.bit_or("one").alias("set"))
    got = rows.toPandas()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[got["word"].to_numpy()] = got["set"].to_numpy()
    return bits, out.view(np.uint64)


def _own_words(known):
    def run(texts: pd.Series) -> pd.Series:
        bits, filled = known.value
        passed = lambda w: int(filled[(x := crc32(w.encode("utf-8", "replace")) & (1 << bits) - 1) >> 6]) >> (x & 63) & 1
        return pd.Series([sorted(w for w in _words(t) if passed(w)) for t in texts], dtype=object)

    return run


def personal_data(docs: DataFrame, broadcast_terms: int = BROADCAST_TERMS, **how) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitised.

    spans adds `term` spans: disclosing terms wherever they stand, in documents
    without an entity too, which `sanitised` generalises to their kind along
    with the entities. Null texts are empty. Equal texts get equal spans;
    repeated rows each give a row; a very long text costs its words. An empty table gives no rows; other columns are ignored.
    """
    spark, terms = docs.sparkSession, saved(disclosing(docs, **how), "terms").select("term")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if small(terms, broadcast_terms):
        known = frozenset(r[0] for r in terms.collect())
        found = column_udf(spark, _finder(known), FOUND, F.col("text"))
    else:  # each document meets its own terms in a join on its words
        own_words = _own_words(spark.sparkContext.broadcast(_filter(terms)))
        words = rows.select(F.xxhash64("text").alias("h"), "text").select(
            "h", F.explode(column_udf(spark, own_words, "array<string>", F.col("text"))).alias("term")
        )
        own = words.distinct().join(terms, "term").groupBy("h").agg(F.collect_set("term").alias("own"))
        rows = rows.withColumn("h", F.xxhash64("text")).join(own, "h", "left")
        found = column_udf(spark, _find_own, FOUND, F.col("text"), F.coalesce("own", F.array().cast("array<string>")))
    return rows.select("doc_id", found.alias("_found")).select("doc_id", *[f"_found.{c}" for c in _NAMES])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("sanitised")
