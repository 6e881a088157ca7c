"""Streams against the batch plans of the same rows."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from lexspark.operators.asof import carried
from lexspark.sources import store
from lexspark.streaming import cache, intake, jobs, progress

CALLS = "key string, ts timestamp, seq long, op string, value string, ttl_s double"
T0 = dt.datetime(2024, 1, 1)


def calls(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=i * 20, microseconds=r.randrange(1000))
        op = r.choice(["set", "get", "get"])
        out.append((f"k{min(r.randrange(12), r.randrange(12))}", at, i, op, f"v{i}" if op == "set" else None, r.choice([None, 0.0, 30.0, 90.5, 4000.0]) if op == "set" else None))
    return out


def brute(rows):
    """Answers of a dictionary that is called in order."""
    held, out = {}, []
    for key, at, seq, op, value, ttl in sorted(set(rows), key=lambda x: (x[1], x[2])):
        if op == "set":
            held[key] = (value, at + dt.timedelta(seconds=ttl) if ttl else None)
        else:
            v, until = held.get(key, (None, at))
            hit = until is None or at < until
            out.append((key, at, seq, hit, v if hit else None))
    return sorted(out)


def test_cache_answers(spark):
    rows = calls()
    for segment in ("1 minute", "1 hour", "30 days"):
        got = cache.answers(spark.createDataFrame(rows + rows[:50], CALLS), segment)
        assert sorted(tuple(x) for x in got.collect()) == brute(rows)
    assert cache.answers(spark.createDataFrame([], CALLS)).count() == 0


def test_cache_stream_equals_batch(spark, tmp_path):
    """Calls arrive in shuffled batches, some twice, some late but inside the watermark; the last one moves the watermark past all others."""
    rows = calls(240)
    end = ("end", T0 + dt.timedelta(days=2), 10**6, "set", "x", None)
    r = random.Random(2)
    batches = [rows[i : i + 60] for i in range(0, 240, 60)]
    for a, b in zip(batches, batches[1:], strict=False):  # some calls come a batch late, and twice
        late = r.sample(a, 10)
        b += late
        a[:] = [x for x in a if x not in late[:5]]
        r.shuffle(b)
    for i, batch in enumerate([*batches, [end]]):
        spark.createDataFrame(batch, CALLS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    source = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream = cache.answer_stream(source, "2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    stream.awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("key", "ts", "seq", "hit", "value").collect())
    assert got == brute(rows)
    state = stream.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= 40, "values that expired and calls that were answered have left the state"


def test_carried_across_segments(spark):
    rows = [(k, i, None if (i * 7 + len(k or "")) % 3 else f"{k}{i}") for k in ("a", "bb", None) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i long, v string")
    for strictly in (False, True):
        want = []
        for k, i, v in rows:
            last = [y for x, j, y in rows if x == k and y is not None and (j < i or j == i and not strictly)]
            want.append((k, i, last[-1] if last else None))
        got = carried(df, "k", ("i",), F.col("v"), F.floor(F.col("i") / 7), "c", strictly).select("k", "i", "c").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def reader():
    def page_rows(content: bytes) -> list[dict]:
        if content.startswith(b"bad"):
            raise ValueError("not a document")
        return [{"page_num": i, "text": t} for i, t in enumerate(content.decode().split("\f"))]

    return page_rows  # not a name of this module, which workers can't import


def arrive(folder, names):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / f"{n}.pdf").write_bytes({"bad1": b"bad", "blank": b"  "}.get(n, f"page one of {n}\fpage two".encode()))


def plan(docs):
    return docs.select(F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "doc_id", "text")


def test_files_in_two_batches_equal_one_batch(spark, tmp_path):
    """Files that arrive later are added, known ones are not read again, a bad one leaves its row of error, and the log tells the states of both runs."""
    log = progress.JobLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        s, folder = store.ChunkStore(spark, str(tmp_path / "store")), tmp_path / "in"
        go = lambda job: intake.ingest_files(spark, str(folder), reader(), plan, s, str(tmp_path / "errors"), str(tmp_path / "ck"), job, at_once=2).awaitTermination()
        arrive(folder, ["a", "b", "bad1"])
        go("first")
        arrive(folder, ["c", "blank"])
        go("second")
        two = {(r["doc_id"], r["text"]) for r in s.read().collect()}
        whole, bad = intake.documents_of(spark.read.format("binaryFile").load(str(folder)).select("path", "content", F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("doc_id")), reader())
        assert two == {(r["doc_id"], r["text"]) for r in plan(whole).collect()} == {(d, f"page one of {d}\npage two") for d in "abc"}
        errors = spark.read.json(str(tmp_path / "errors"))
        assert {(r["doc_id"], r["error"]) for r in errors.collect()} == {("bad1", "not a document"), ("blank", "no text")} == {(r["doc_id"], r["error"]) for r in bad.collect()}

        broken = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load().select((F.lit(1) / (F.col("value") - F.col("value"))).alias("x"))
        failed = broken.writeStream.format("noop").queryName("broken").option("checkpointLocation", str(tmp_path / "ck2")).trigger(processingTime="1 second").start()
        try:
            failed.awaitTermination(60)
        except Exception as e:
            assert "DIVIDE_BY_ZERO" in str(e)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            states = {r["job_id"]: r["status"] for r in jobs.job_states(log.read()).collect()}
            if states.get("broken") == "failed":
                break
            time.sleep(0.2)
        assert states == {"first": "done", "second": "done", "broken": "failed"}
        steps = [r["status"] for r in log.read().where("job_id = 'first'").orderBy("seq").collect()]
        assert steps[0] == "queued" and steps[-1] == "done" and set(steps[1:-1]) == {"running"}
        assert log.read().where("job_id = 'broken' AND level = 'error' AND message LIKE '%DIVIDE_BY_ZERO%'").count() == 1
    finally:
        spark.streams.removeListener(log)


def test_replayed_batches_add_nothing(spark, tmp_path):
    """The same chunks again, in the same batch and in later ones, pass once; keys behind the watermark leave the state."""
    schema = "chunk_id string, stored_at timestamp, text string"
    for i in range(4):
        rows = [(f"c{j}", T0 + dt.timedelta(hours=3 * i, minutes=j), "t") for j in range(10 * i, 10 * i + 10)]
        spark.createDataFrame(rows + rows[:3], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{2 * i}"))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{2 * i + 1}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream = intake.new_chunks(source, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    stream.awaitTermination()
    got = [r["chunk_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(f"c{j}" for j in range(40))
    assert stream.lastProgress["stateOperators"][0]["numRowsTotal"] <= 20


def test_sessions_end_where_the_gap_is_full(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1800), (2, 0), (2, 1799), (2, 3600)], "user_id long, t long").select("user_id", F.timestamp_seconds("t").alias("ts"))
    got = jobs.sessions(rows).select("user_id", F.unix_timestamp("session_window.start"), F.unix_timestamp("session_window.end"), "n").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1800, 1), (1, 1800, 3600, 1), (2, 0, 3599, 2), (2, 3600, 5400, 1)]
