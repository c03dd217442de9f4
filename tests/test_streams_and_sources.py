"""Processors with state, restarts, fenced appends, audio by range, budgets, long sessions, romanisation: against plain loops."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import voxlake.plans.library  # noqa: F401
from voxlake.functions.dialect import Duck, Spark
from voxlake.functions.transducer import ROMAN, romanised
from voxlake.operators.budget import budgeted
from voxlake.plans.registry import ORACLE, QUERIES
from voxlake.sources import fenced, pcm, readers
from voxlake.streaming import batches, turns

# ---- turns ------------------------------------------------------------------------------------------


def replayed(spark, folder, batches_, schema):
    """A stream with one micro-batch per list of rows."""
    for rows in batches_:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def landed(rows, folder):
    how = rows.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "at"))
    how.trigger(availableNow=True).start().awaitTermination(180)
    return rows.sparkSession.read.schema(rows.schema).parquet(str(folder / "out")).collect()


def test_a_hold_lengthens_the_open_pause_and_speech_ends_it():
    limits, turn = turns.Limits(onset=2, least=5, pause=3, end=8, held=20), turns.Turn()
    feed = lambda values: [e for p in values if (e := turn.frame(p, limits))]
    assert feed([0.1] * 9 + [0.9] * 15 + [0.1] * 4) == ["speech_start", "speech_pause"]
    assert turn.verdict(True, limits) == "held"
    assert feed([0.1] * 10 + [0.9] * 15) == ["speech_resume"]  # fourteen silent frames didn't end it
    assert feed([0.1] * 15) == ["speech_pause", "speech_end"]  # back to eight
    assert turn.verdict(True, limits) == "late"
    feed([0.9] * 9 + [0.1] * 4)
    assert turn.verdict(False, limits) == "complete" and feed([0.1] * 8) == ["speech_end"]
    feed([0.9] * 9 + [0.1] * 4)
    turn.verdict(True, limits)
    assert feed([0.1] * 15) == [] and feed([0.1]) == ["speech_end"]
    assert turns.Turn().frame(0.9, limits) is None


def test_results_are_held_released_discarded_and_sessions_closed(spark, tmp_path):
    schema = "key long, seq long, ts timestamp_ltz, kind string, p double, unfinished boolean"
    at = lambda s: np.datetime64(1_000_000_000 + s, "s").item()
    frame = lambda k, q, p, s=None: (k, q, at(q if s is None else s), "frame", p, None)
    other = lambda k, q, kind, unfinished=None: (k, q, at(q), kind, None, unfinished)
    first = [frame(1, 1, 0.9), frame(1, 2, 0.9), frame(1, 3, 0.1), other(1, 5, "result"), other(1, 4, "result"), other(1, 6, "verdict", True)]
    second = [frame(1, q, 0.1) for q in range(7, 11)] + [other(1, 11, "result"), other(1, 12, "verdict", True), frame(1, 2, 0.9), (None, 1, at(1), "frame", 0.1, None), (1, 50, at(3), "frame", None, None)]
    third = [frame(2, q, 0.9) for q in (20, 21)] + [frame(2, 22, 0.1), other(2, 23, "result"), frame(2, 24, 0.9), other(2, 25, "result")]
    fourth = [frame(3, 9_000, 0.1)]
    fifth = [frame(3, 20_000, 0.1)]
    stream = replayed(spark, tmp_path, [first, second, third, fourth, fifth], schema).withWatermark("ts", "1 second")
    got = sorted(tuple(r) for r in landed(turns.turns(stream, timeout_ms=600_000), tmp_path))
    want = [
        (1, 2, "speech_start", 2, 0), (1, 3, "speech_pause", 3, 0), (1, 6, "held", 6, 0), (1, 10, "speech_end", 10, 0),
        (1, 4, "released", 10, 1), (1, 5, "released", 10, 2), (1, 11, "sent", 11, 0), (1, 12, "late", 12, 0),
        (2, 21, "speech_start", 21, 0), (2, 22, "speech_pause", 22, 0), (2, 24, "speech_resume", 24, 0), (2, 23, "discarded", 24, 1), (2, 25, "discarded", 25, 0),
        (2, 25, "disconnected", 25, 0),
    ]
    assert got == sorted(want)


def pushed(deltas, first=(3, 7), later=14):
    clause = turns.Clause()
    out = [c for d in deltas for c in clause.push(d, first, later)]
    return out + clause.flush()


def test_clauses_do_not_depend_on_the_deltas():
    assert pushed(["yes", ",", " of", " course", " I", " will", ".", " fine", " day", "."]) == ["yes, of course I will.", "fine day."]
    assert pushed([f"w{i} " for i in range(1, 14)], (2, 4), 5) == ["w1 w2 w3 w4", "w5 w6 w7 w8 w9", "w10 w11 w12 w13"]
    assert pushed(["hi the", "re "], (1, 2), 2) == ["hi there"] and pushed(["", " \n"]) == []
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("ab .,!\n ؟") for _ in range(r.randrange(120)))
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(9))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert pushed(parts) == pushed(list(text)) == pushed([text])
        assert "".join("".join(pushed(parts)).split()) == "".join(text.split())


def test_clauses_of_broken_off_replies_are_flushed(spark, tmp_path):
    schema = "key long, reply long, seq long, delta string, last boolean, ts timestamp_ltz"
    at = lambda s: np.datetime64(1_000_000_000 + s, "s").item()
    stream = replayed(spark, tmp_path, [[(1, 1, 1, "e two three.", False, at(1)), (1, 1, 0, "on", False, at(0))], [(1, 1, 0, "on", False, at(2)), (1, 1, 2, " rest", False, at(2)), (1, 2, 0, None, True, at(2))], [(2, 1, 0, "x", True, at(9_000))], [(2, 1, 1, "y", True, at(20_000))]], schema)
    got = sorted(tuple(r) for r in landed(turns.clauses(stream.withWatermark("ts", "1 second"), timeout_ms=60_000), tmp_path))
    assert got == [(1, 1, 1, "one two three."), (1, 1, 2, "rest"), (2, 1, 1, "x"), (2, 1, 1, "y")]
    with pytest.raises(ValueError, match="order"):
        turns.clauses(stream, (5, 3))


# ---- restarts and fences ----------------------------------------------------------------------------


def test_a_batch_that_is_replayed_adds_nothing(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 12).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, at, seen = str(tmp_path / "out"), str(tmp_path / "at"), []

    def crash(number):
        seen.append(number)
        if number == 1 and seen.count(1) < 3:
            raise RuntimeError("stopped here")

    for _ in range(2):  # written, not committed
        with pytest.raises(Exception, match="stopped here"):
            batches.run(stream(), out, at, lambda d: d, "k", crash)
        assert spark.read.parquet(out).count() == 22
    batches.run(stream(), out, at, lambda d: d, "k", crash)
    rows = batches.written(spark, out).collect()
    assert sorted((r["k"], r["v"]) for r in rows) == [(k, 2 * k) for k in range(32)] and seen == [0, 1, 1, 1, 2]
    batches.run(stream(), out, str(tmp_path / "fresh"), lambda d: d, "k")  # everything again, with no memory of what was read
    assert sorted(r["k"] for r in batches.written(spark, out).collect()) == list(range(32))


def test_of_two_writers_one_is_told(spark, tmp_path):
    table = fenced.FencedTable(spark, str(tmp_path / "t"), "id long, x string")
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id long, x string")
    check = fenced.new_keys("id")
    assert table.version() == 0 and table.rows().count() == 0
    seen = table.version()
    assert table.append(rows(1, 2), check, onto=seen) == 1
    with pytest.raises(fenced.Conflict):
        table.append(rows(3), check, onto=seen)
    for bad in (rows(2), rows(4, 4), rows(None)):
        with pytest.raises(ValueError, match="fit"):
            table.append_again(bad, check)
    late = fenced.FencedTable(spark, str(tmp_path / "t"), "id long, x string")

    def slow(before, own):  # another writer commits while this one checks
        if before.count() == 2:
            table.append(rows(9), check)
        return check(before, own)

    assert late.append_again(rows(3), slow) == 3
    assert sorted((r["id"], r["version"]) for r in table.rows().collect()) == [(1, 1), (2, 1), (3, 3), (9, 2)]
    assert table.rows(1).count() == 2 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 3


# ---- audio --------------------------------------------------------------------------------------------


def test_a_long_file_is_many_tasks(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.integers(-30_000, 30_000, (100_000, 2)).astype("<i2")
    pcm.put(str(tmp_path), "long.wav", pcm.wav_bytes(x, 16_000, channels=2))
    pcm.put(str(tmp_path), "cut.wav", pcm.wav_bytes(x[:5_000, 0], 8_000)[:-4_001])
    pcm.put(str(tmp_path), "none.wav", b"RIFF....no audio")
    pcm.put(str(tmp_path), "empty.wav", pcm.wav_bytes(x[:0, 0], 8_000))
    pcm.register(spark)
    rows = spark.read.format("wav_ranges").option("path", str(tmp_path)).option("rangeBytes", 40_001).load()
    assert rows.rdd.getNumPartitions() >= 10
    got = {}
    for row in rows.orderBy("path", "first").collect():
        got.setdefault(row["path"].rsplit("/", 1)[-1], []).append(row)
    assert set(got) == {"long.wav", "cut.wav"}
    long = np.concatenate([r["samples"] for r in got["long.wav"]])
    assert np.allclose(long, x.astype(np.float32).mean(1) / 32_768, atol=1e-6) and got["long.wav"][1]["first"] == len(got["long.wav"][0]["samples"])
    assert sum(len(r["samples"]) for r in got["cut.wav"]) == 2_999 and got["cut.wav"][0]["rate"] == 8_000
    with pytest.raises(Exception, match="WAV"):
        spark.read.format("wav_ranges").option("path", str(tmp_path)).option("strict", "true").load().collect()
    assert spark.read.format("wav_ranges").option("path", str(tmp_path / "nothing")).load().count() == 0


# ---- budgets and long sessions ------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_keep_what_a_walk_keeps(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("abc"), i, r.choice([0, 1, 3, 10, 40]), r.randrange(5), r.randrange(6)) for i in range(300)] + [("a", 900, None, 1, 1), (None, 901, 1, 1, 1), ("d", 902, 999, 1, 1)]
    df = spark.createDataFrame(rows, "g string, id long, n long, y long, u long")

    def walk(target=None, unit=False):
        kept, used, got, shut = set(), {}, {}, set()
        for g, i, n, y, u in sorted((x for x in rows if x[0] and x[2] is not None), key=lambda x: (x[4], x[1])):
            full = used.get(g, 0) + n > 97 or (unit and used.get(g, 0) >= 97)
            if (unit and (g, u) in shut) or (target is not None and got.get(g, 0) >= target):
                continue
            if full:
                shut.add((g, u))
                continue
            kept.add(i)
            used[g], got[g] = used.get(g, 0) + n, got.get(g, 0) + y
        return kept

    order = [F.col("u"), F.col("id")]
    assert {x["id"] for x in budgeted(df, "g", order, "n", F.lit(97)).collect()} == walk()
    assert {x["id"] for x in budgeted(df, "g", order, "n", F.lit(97), gain="y", target=20).collect()} == walk(target=20)
    assert {x["id"] for x in budgeted(df, "g", order, "n", F.lit(97), unit="u").collect()} == walk(unit=True)
    assert budgeted(df.limit(0), "g", order, "n", F.lit(97)).count() == 0


def test_a_session_of_many_turns_is_joined_by_bins(spark, tmp_path):
    """All 100,000 turns are one session; comparing each with each would be ten thousand million pairs."""
    text = F.repeat(F.lit("x"), (20 + F.col("id") % 60).cast("int"))
    turns_ = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), text.alias("text"))
    turns_.write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["speaker_overlaps"](spark, str(tmp_path))
    pairs = {(r["one"], r["two"]) for r in got.collect()}
    seg = spark.sql(f"WITH {voxlake.plans.catalogue.segments(Spark())} SELECT turn, speaker, start, stop FROM seg".replace("FROM conversations", "FROM {t}"), t=turns_).collect()
    rows, want, open_ = sorted(seg, key=lambda r: (r["start"], r["stop"])), set(), []
    for b in rows:
        open_ = [a for a in open_ if a["stop"] > b["start"]]
        want |= {(min(a["turn"], b["turn"]), max(a["turn"], b["turn"])) for a in open_ if a["speaker"] != b["speaker"] and a["start"] < b["stop"]}
        open_.append(b)
    assert pairs == want and len(pairs) == got.count()


# ---- romanisation -------------------------------------------------------------------------------------


def plainly(text):
    out = []
    for chunk in filter(None, text.split(" ")):
        body = chunk.rstrip(",.?!;:")
        trail = "".join({";": ",", ":": ""}.get(c, c) for c in chunk[len(body) :])
        word = ""
        while body:
            n = next((n for n in (2, 1) if body[:n] in ROMAN), None)
            if n is None and not ("a" <= body[0] <= "z"):
                return None
            word, body = word + (ROMAN[body[:n]] if n else body[0]), body[n or 1 :]
        if word:
            out.append(word + trail)
        elif trail and out:
            out[-1] += trail
    return " ".join(out)


def test_the_longest_sequence_is_written(spark):
    texts = ["salˈɑm, hˈɑl ʃˈomɑ tʃˈetoːr ˈast?", "dʒˈɑleb vɑq1ˈeʔan xˈuːb ʒˈɑle", "sʘ", "a , b", ", a", "", None, "a,b", "ʔ. a ʔ! b;:", "dt ʃʒ"]
    r = random.Random(3)
    texts += ["".join(r.choice([*ROMAN, *"abz ,.?;:  "]) for _ in range(r.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {x["i"]: x["r"] for x in df.selectExpr("i", f"{romanised(Spark(), 't')} AS r").collect()}
    assert got == {i: None if t is None else plainly(t) for i, t in enumerate(texts)}
    assert got[0] == "salaam, haal shomaa chetor ast?" and got[1] == "jaaleb vaaghean khub zhaale" and got[2] is None
    duck = duckdb.connect()
    duck.execute("CREATE TABLE x AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts) if t is not None) + ") v(i, t)")
    assert {i: v for i, v in duck.sql(f"SELECT i, {romanised(Duck(), 't')} FROM x").fetchall()} == {i: v for i, v in got.items() if texts[i] is not None}


# ---- levels beyond 16 bits ----------------------------------------------------------------------------


def _levels(spark, folder):
    """Events whose levels pass 16 and 32 bits, of either sign, of users with one event or many; some null."""
    values = [(7, i, v) for i, v in enumerate([370.71, -327.69, 0.01, 1e9, -5e10, 655.36, None, 0.0, 327.68, 1.5, 2.25])] + [(-3, 100, 12.5), (8, 101, None)]
    spark.createDataFrame(values, "user_id long, event_id long, value double").write.parquet(str(folder / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["wav_scan", "message_stream"])
def test_levels_beyond_16_bits(spark, tmp_path, name):
    duck = _levels(spark, tmp_path)
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]}) x").fetchall())


def test_many_short_ranges_are_few_tasks(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=10_003)
    for i in range(20):
        pcm.put(str(tmp_path), f"{i}.wav", pcm.wav_bytes(x[: 10_003 - i], 16_000))
    pcm.register(spark)
    for most in (9_999, 1 << 20):
        rows = spark.read.format("wav_ranges").option("path", str(tmp_path)).option("rangeBytes", 64).option("partitionBytes", most).load()
        if most == 1 << 20:
            assert rows.rdd.getNumPartitions() < 10
        for row in rows.groupBy("path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("first", "range", "samples"))).alias("r")).collect():
            own = x[: 10_003 - int(row["path"].rsplit("/", 1)[-1].removesuffix(".wav"))]
            assert row["n"] == -(-len(own) // 8) and np.array_equal(np.concatenate([r["samples"] for r in row["r"]]), own)
            assert [r["first"] for r in row["r"]] == list(range(0, len(own), 8)) and len({r["range"] for r in row["r"]}) == row["n"]


def test_long_texts_are_romanised_in_passes(spark):
    """A text of 2 million characters takes seconds, and blanks, marks and sequences at every place are as in a walk."""
    r, rows = random.Random(5), []
    for _ in range(3_000):
        rows.append("".join(r.choice(["dʒ", "tʃ", "q1", "q", "1", "d", "ʒ", "ʔ", "s", "h", " ", " ", ",", ";", ":", "."]) for _ in range(r.randrange(9))))
    rows += ["a\n", "a,\n", "\ue000", "salʒ 😀", "ʃ\u0329:", "a\tb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string")
    assert {x["i"]: x["r"] for x in df.selectExpr("i", f"{romanised(Spark(), 't')} AS r").collect()} == {i: plainly(t) for i, t in enumerate(rows)}
    long = "salˈɑm, hˈɑl ʃˈomɑ tʃˈetoːr ˈast? " * 60_000
    start = time.perf_counter()
    assert spark.createDataFrame([(long,)], "t string").selectExpr(f"{romanised(Spark(), 't')} AS r").first()["r"] == plainly(long)
    assert time.perf_counter() - start < 30


def test_a_session_scan_of_odd_rows(spark, tmp_path):
    """400 sessions, some without consent, one without an id, with null turns: equal to SQL."""
    rows = [(i - 5, t) for i in range(400) for t in range(i % 4)] + [(None, 1), (900, None), (901, None), (901, 7)]
    spark.createDataFrame(rows, "conv_id long, turn long").write.parquet(str(tmp_path / "conversations.parquet"))
    start = time.perf_counter()
    got = QUERIES["session_log_scan"](spark, str(tmp_path)).select("conv_id", "turns", "mos").collect()
    assert time.perf_counter() - start < 60
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    none = lambda r: sorted(map(repr, map(tuple, r)))
    assert none(got) == none(duck.sql(f"SELECT conv_id, turns, mos FROM ({ORACLE['session_log_scan']}) x").fetchall())


def test_stages_of_many_values_have_no_median_in_one_task(spark, tmp_path):
    """Odd and even counts, ties, nulls: equal to SQL; no aggregate keeps all values of a stage."""
    for n in (1, 2, 501, 1000):
        r = random.Random(n)
        rows = [(i, r.randrange(9), r.choice(["click", "view"]), r.choice([None, 1.5, r.expovariate(0.02)])) for i in range(n)]
        folder = tmp_path / str(n)
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(folder / "events.parquet"))
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        got = QUERIES["failure_stages"](spark, str(folder))
        assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE['failure_stages']}) x").fetchall())
        assert " percentile(" not in got._jdf.queryExecution().toString()


# ---- session folders ----------------------------------------------------------------------------------


def test_session_folders_are_listed_by_tasks(spark, tmp_path):
    """No plan holds a list of files, nothing is broadcast unseen, and rows are those of Spark's reader: odd lines, hidden folders, any depth."""
    odd = [b'{"a":1,"b":"x"}', b" \t", b'{"a":1', b'[{"a":1},{"a":2,"b":"y"}]', b"[]", b"null", b"{}", b'{"a":"x","b":2}', b'{"a":1}{"a":2}', b'{"a":1}\r{"a":3}\r', b"\x0c"]
    odd += [b'{"b":"\xff"}', '{"b":"é😀"}'.encode(), b"3", b"[1]", b'\xef\xbb\xbf{"a":5}', b'{"a":99999999999999999999}', b'{"b":"' + b"z" * 200_000 + b'"}']
    files = {f"s{i}": line + b"\n" for i, line in enumerate(odd)} | {"x/y/z/all +%é": b"\n".join(odd), "x/crlf": b"\r\n".join(odd), "empty": b"", "k=1/s": odd[0]}
    for folder, data in files.items():
        pcm.put(str(tmp_path / folder), "turns.jsonl", data)
        pcm.put(str(tmp_path / folder), "meta.json", b'{"consent": true}\n')
    for folder, meta in (("_hidden", b'{"consent": true}'), (".hidden/s", b'{"consent": true}'), ("no", b'{"consent": false}'), ("null", b"{}")):
        pcm.put(str(tmp_path / folder), "turns.jsonl", odd[0])
        pcm.put(str(tmp_path / folder), "meta.json", meta)
    rows = lambda df: sorted(map(repr, map(tuple, df.select("a", "b").collect())))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sessions.link./in", f"file://{tmp_path}")
    for path in (str(tmp_path), f"{tmp_path}/*", "viewfs://sessions/in"):  # also a pattern, and a store that only Spark reaches
        want = readers.jsonl(spark, path, "a long, b string", "turns.jsonl").where("NOT input_file_name() RLIKE '/(no|null)/[^/]+$'")
        _, said, _ = readers.session_folders(spark, path, "consent boolean", "a long, b string", "mos long")
        assert rows(said) == rows(want) and len(rows(want)) > 40
        if path == str(tmp_path):
            assert said.inputFiles() == [] and "Broadcast" not in said._jdf.queryExecution().sparkPlan().toString()
        if "*" not in path:
            assert {r["folder"] for r in said.collect()} == {x.rsplit("/", 1)[-1] for x in files} - {"empty", "s1", "s4"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.session_folders(spark, f"{tmp_path}/nothing", "consent boolean", "a long, b string", "mos long")


def test_a_session_scan_of_no_sessions_and_of_a_long_one(spark, tmp_path):
    spark.range(0).selectExpr("id AS conv_id", "id AS turn").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert QUERIES["session_log_scan"](spark, str(tmp_path / "none")).collect() == []
    spark.range(50_000).selectExpr("id DIV 49990 AS conv_id", "id AS turn").withColumn("conv_id", F.col("conv_id") + 1).write.parquet(str(tmp_path / "one" / "conversations.parquet"))
    got = QUERIES["session_log_scan"](spark, str(tmp_path / "one")).select("conv_id", "turns", "mos")
    assert sorted(map(tuple, got.collect())) == [(1, 49_990, 4), (2, 10, 4)]
