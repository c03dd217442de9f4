"""Phrase collocation mining: word n-grams that hold together, by language.

n-grams of 1 to max_n words are exploded into rows, aggregated by language and
phrase, joined with the counts of their parts at every cut, scored in Decimal,
freed of those that a one-word extension explains, and ranked.

Almost all n-grams of a large corpus are rare, and writing them all costs many
times the input. So the explosion is preceded by a pass that counts hashed word
pairs: a pair is at least as frequent as any n-gram around it, hence n-grams with
a pair below the minimum are left unexploded. Hash collisions can only add to a
pair's count, so no phrase is lost, and exact counts decide afterwards. The
frequent pairs reach the second pass as a bit map of bounded size; with a
fuller map more rare n-grams are exploded, and the result stays the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, ship, table

MIN_COUNT, MAX_N, TOP = 30, 4, 2_000
#: Scores are whole numbers: the share a / (l + r) times this.
SCALE = 2_000_000
#: A phrase goes if an extension has at least so many hundredths of its occurrences.
EXPLAINED = 80
#: Bytes of text that are taken apart at a time, words whose counts a task gathers before it hands them on, hashes likewise.
TEXT_BYTES, GATHERED, HASHES = 1 << 19, 150_000, 1 << 20
#: Largest bit map of frequent pairs, in bits; bits of a pair where they fit.
MAX_BITS, PAIR_BITS = 1 << 28, 32
#: Parts into which a language's phrases are dealt before the last ranking.
DEALT = 64

_SPACE, _BREAK = 32, 10
_TABLE = bytes(_BREAK if chr(c) in ".,;:!?\n\x0b\x0c\r" else _SPACE if chr(c) in " \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = 0x9E3779B97F4A7C15


# ---- words of a batch ----------------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(p: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(TEXT_BYTES, p, np.uint64)]))


class Words:
    """The words of texts in one language, in order: texts lower-cased in A-Z, taken apart at marks and blanks."""

    _up = _down = None

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts).translate(_TABLE)
        while b"  " in joined:  # so that a slice of several words is the phrase
            joined = joined.replace(b"  ", b" ")
        self.text = joined
        whole = np.frombuffer(joined, np.uint8)
        inside = np.concatenate([[False], (whole != _SPACE) & (whole != _BREAK), [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        breaks = np.flatnonzero(whole == _BREAK)
        piece = np.searchsorted(breaks, self.starts)
        #: Whether word i and the next one stand in one piece.
        self.joins = piece[1:] == piece[:-1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word: a polynomial by prefix sums over segments, mixed."""
        if Words._up is None:
            Words._up, Words._down = _powers(_ODD), _powers(pow(_ODD, -1, 1 << 64))
        out, whole, i = np.empty(len(self.starts), np.uint64), np.frombuffer(self.text, np.uint8), 0
        while i < len(out):
            low = self.starts[i]
            k = max(int(np.searchsorted(self.ends, low + TEXT_BYTES, "right")), i + 1)
            s, e = self.starts[i:k] - low, self.ends[i:k] - low
            if e[-1] > TEXT_BYTES:  # a word longer than a segment
                out[i] = np.uint64(hash(self.text[low : low + int(e[-1])]) & 0xFFFFFFFFFFFFFFFF)
            else:
                sums = np.zeros(e[-1] + 1, np.uint64)
                np.cumsum((whole[low : low + e[-1]].astype(np.uint64) + np.uint64(1)) * Words._up[: e[-1]], out=sums[1:])
                out[i:k] = (sums[e] - sums[s]) * Words._down[s]
            i = k
        return _mix(out)

    def pairs(self, lang: str) -> np.ndarray:
        """The hash of each word and the next one, by language; of any two words, in one piece or not."""
        h = self.hashes()
        seed = np.uint64(int.from_bytes(lang.encode()[:64] or b"\0", "little") % ((1 << 61) - 1))
        return _mix(h[:-1] * np.uint64(_ODD) + (h[1:] ^ (h[1:] >> np.uint64(29))) + seed)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """Texts of a batch by language, some megabytes at a time."""
    for b in batches:
        groups: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            groups.setdefault(lang, []).append(text)
        for lang, texts in groups.items():
            low, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= TEXT_BYTES or i + 1 == len(texts):
                    yield lang, Words(texts[low : i + 1])
                    low, size = i + 1, 0


def _pair_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["pair", "n"])

    for lang, words in _by_language(batches):
        if len(words.starts) > 1:
            held.append(words.pairs(lang)[words.joins])
            size += len(held[-1])
        if size >= HASHES:
            yield flush()
            size = 0
    if held:
        yield flush()


def _exploder(bits, max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(bits.value, np.uint8)
        mask = np.uint64(8 * len(frequent) - 1)
        counts: dict[str, list[Counter]] = {}
        total, size = Counter(), 0

        def flush() -> pa.RecordBatch:
            rows = [(lang, n + 1, phrase, f) for lang, own in counts.items() for n, c in enumerate(own) for phrase, f in c.items()]
            rows += [(lang, 0, b"", f) for lang, f in total.items()]
            counts.clear()
            total.clear()
            lang, n, phrase, f = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], ["lang", "words", "phrase", "f"]
            )

        for lang, w in _by_language(batches):
            if not len(w.starts):
                continue
            own = counts.setdefault(lang, [Counter() for _ in range(max_n)])
            size -= sum(map(len, own))
            total[lang] += len(w.starts)
            starts, ends, text = w.starts.tolist(), w.ends, w.text
            own[0].update(text[a:e] for a, e in zip(starts, ends.tolist(), strict=True))
            at = np.arange(len(starts))
            if len(starts) > 1 and max_n > 1:
                h = w.pairs(lang) & mask
                good = w.joins & ((frequent[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1) == 1)
                on = good
                for n in range(2, max_n + 1):
                    if n > 2:
                        on = on[:-1] & good[n - 2 :]  # n words from here on are joined by frequent pairs
                    some = at[: len(on)][on]
                    own[n - 1].update([text[starts[i] : e] for i, e in zip(some.tolist(), ends[some + n - 1].tolist(), strict=True)])
            size += sum(map(len, own))
            if size >= GATHERED:
                yield flush()
                size = 0
        if total:
            yield flush()

    return run


def frequent_pairs(rows: DataFrame, min_count: int = MIN_COUNT) -> bytes:
    """A bit map by hash of the word pairs that occur at least min_count times, of MAX_BITS at most.

    Its size is a power of two that grows with the number of such pairs up to the bound.
    """
    counted = rows.mapInArrow(_pair_counter, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    counted = saved(counted.select("pair"), "pairs")
    bits = 1 << 15
    while bits < MAX_BITS and bits < PAIR_BITS * counted.count():
        bits *= 2
    # words of 32,768 bits, built where the hashes are; at most bits / 32,768 rows come to the driver
    low = F.col("pair").bitwiseAND(bits - 1)
    slot = F.shiftright(low, 15)
    words = counted.groupBy(slot.alias("slot")).agg(F.bitmap_construct_agg(low.bitwiseAND(32_767)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in words.toLocalIterator():
        out[r["slot"] * 4096 : r["slot"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


# ---- counts, scores, ranks -----------------------------------------------------------------------


def ngram_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, words, phrase, f) of n-grams with f >= min_count, and (lang, n): word occurrences."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(frequent_pairs(rows, min_count))
    grams = rows.mapInArrow(_exploder(bits, max_n), "lang string, words int, phrase string, f long")
    counts = grams.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    counts = saved(counts.where((F.col("f") >= min_count) | (F.col("words") == 0)), "ngrams")
    return counts.where("words > 0"), counts.where("words = 0").select("lang", F.col("f").alias("n"))


def _decimal(name: str):
    return F.col(name).cast("decimal(20,0)")


def scored(counts: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of phrases of two words and more, by their worst cut.

    Parts are at least as frequent as the phrase, so `counts` has them all.
    """
    split = F.split("phrase", " ")
    cuts = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "words", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    cuts = cuts.withColumns({"wide": _decimal("a") * F.lit(SCALE).cast("decimal(7,0)"), "sum": _decimal("l") + _decimal("r")})
    cuts = cuts.withColumn("score", F.expr("wide div sum"))
    worst = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return worst.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def explained(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the greatest count of a phrase of one word more that holds `phrase`.

    One word more is enough: a phrase of two words more has one of one word more inside it, which is as frequent at least.
    """
    longer = counts.where("words > 2").select("lang", F.split("phrase", " ").alias("w"), "words", "f")
    parts = F.array(*[F.array_join(F.slice("w", F.lit(i), F.col("words") - 1), " ") for i in (1, 2)])
    return longer.select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, explained_by: int = EXPLAINED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` collocations of 2 to max_n words.

    a, l and r count the phrase and the parts of its worst cut (the lowest score; ties: the shortest first part), n all words of the language;
    score is floor(2,000,000 a / (l + r)) in exact arithmetic. A phrase goes if a longer one that holds it has
    explained_by hundredths of its occurrences or more.

    Null texts are empty, null languages are `und`; repeated rows each count. Texts without words, an empty table
    and languages without a frequent phrase give no rows; other columns are ignored. Very long texts are
    taken apart in segments. Equal scores are ranked by a, then by the phrase's bytes. `top` is the report's length.
    """
    counts, totals = ngram_counts(docs, max_n, min_count)
    held = scored(counts, max_n).join(explained(counts), ["lang", "phrase"], "left")
    held = held.where(F.col("longer").isNull() | (_decimal("longer") * 100 < _decimal("a") * explained_by))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = held.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))  # a language may hold most phrases
    dealt = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = f"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda v: v <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (
  SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT lang, ws, unnest([1, 2, 3, 4]) AS m FROM w) v) v2),
c AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= {MIN_COUNT}),
k AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM c WHERE m > 1),
u AS MATERIALIZED (SELECT lang, phrase, m, f, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS j FROM k) v),
s AS (SELECT u.lang, u.phrase, u.m, u.f AS a, j, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * u.f) // (l.f + r.f) AS BIGINT) AS score
  FROM u JOIN c l ON l.lang = u.lang AND l.phrase = u.head JOIN c r ON r.lang = u.lang AND r.phrase = u.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
x AS MATERIALIZED (SELECT lang, f, array_to_string(ws[i:i + j - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM k) v) v2),
e AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE 100 * x.f >= {EXPLAINED} * b.a),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = b.lang AND e.phrase = b.phrase))
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, score
FROM o JOIN t ON t.lang = o.lang WHERE rank <= {TOP}"""
