"""Streams give what their batch twins give."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from lectern.streaming import jobs as J
from lectern.streaming import requests as Q
from lectern.streaming import texts as X
from lectern.streaming.ingest import ingest_stream

T0 = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, folder: str, batches: list[list[tuple]], schema: str, build, mode: str):
    """Feed the batches one file per trigger and return the rows the stream wrote."""
    source = f"{folder}/in-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return drain(spark, folder, build(stream), mode)


def drain(spark, folder: str, df, mode: str):
    name = f"out_{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", f"{folder}/cp-{uuid.uuid4().hex}").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


JOBS = "job_id string, ts timestamp, ord bigint, status string"
JOB_ROWS = [
    ("fast", at(0), 1, "queued"), ("fast", at(1), 2, "running"), ("fast", at(5), 3, "completed"),
    ("slow", at(0), 4, "queued"), ("slow", at(2), 5, "running"), ("slow", at(40), 6, "completed"),
    ("stuck", at(3), 7, "running"), ("wait", at(3), 8, "queued"), ("gone", at(1), 9, "queued"), ("gone", at(4), 10, "cancelled"),
]


def test_job_monitor_equals_batch(spark, folder):
    late = [("tick", at(200), 99, "queued")]
    want = {(r.job_id, r.status, r.error) for r in J.job_states(spark.createDataFrame(JOB_ROWS + late, JOBS)).collect()}
    assert ("slow", "failed", "watchdog timeout") in want and ("stuck", "failed", "watchdog timeout") in want
    out = run(spark, folder, [JOB_ROWS[:5], JOB_ROWS[5:], late, [("tick", at(201), 100, "queued")]], JOBS, J.job_monitor, "update")
    last = out.groupBy("job_id").agg(F.max_by(F.struct("status", "error"), "at").alias("s"))
    got = {(r.job_id, r.s.status, r.s.error) for r in last.collect()}
    assert got == want


def test_file_status_view_updates(spark, folder):
    rows = [("f1", at(0), 1, "pending"), ("f2", at(0), 2, "pending"), ("f1", at(5), 3, "completed")]
    schema = "file_id string, ts timestamp, ord bigint, status string"
    out = run(spark, folder, [rows[:2], rows[2:]], schema, J.file_status_view, "update")
    assert ("f1", "completed") in {(r.file_id, r.status) for r in out.collect()}


def test_cancellations_keep_shared_files(spark):
    jobs = spark.createDataFrame([("j1", "a", "f1"), ("j2", "a", "f2"), ("j3", "b", "f2")], "job_id string, chat_id string, file_id string")
    links = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "f2")], "chat_id string, file_id string")
    left = J.apply_cancellations(jobs, spark.createDataFrame([("a",)], "chat_id string"), links)
    assert {r.job_id for r in left.collect()} == {"j2", "j3"}


REQUESTS = "id bigint, ts timestamp, endpoint string, latency_ms double, status int"


def test_request_metrics_stream_matches_batch(spark, folder):
    rows = [(i, at(i), "chat" if i % 2 else "embed", float(i), 500 if i % 7 == 0 else 200) for i in range(120)]
    want = {(r.window_start, r.requests, r.failures) for r in Q.request_metrics(spark.createDataFrame(rows, REQUESTS), "30 minutes").collect()}
    flush = [(999, at(600), "x", 1.0, 200)]
    out = run(spark, folder, [rows[:60], rows[60:], flush, [(1000, at(601), "x", 1.0, 200)]], REQUESTS, lambda s: Q.request_metrics(s, "30 minutes"), "append")
    got = {(r.window_start, r.requests, r.failures) for r in out.collect()}
    assert want == got
    exact = {r.window_start: r.p50_ms for r in Q.request_metrics(spark.createDataFrame(rows, REQUESTS), "30 minutes").collect()}
    assert all(abs(r.p50_ms - exact[r.window_start]) <= 1.0 for r in out.collect())


def test_recent_history_keeps_newest(spark, folder):
    rows = [(i, at(i), "e", float(i), 200) for i in range(20)]
    out = run(spark, folder, [rows[10:], rows[:10]], REQUESTS, lambda s: Q.recent_history(s.select("endpoint", "ts", "id", "latency_ms", "status"), 5), "update")
    want = {r.id for r in Q.recent_batch(spark.createDataFrame(rows, REQUESTS), 5).collect()}
    assert want == {15, 16, 17, 18, 19}
    assert want <= {r.id for r in out.collect()}


TOKENS = "request_id string, ts timestamp, ord int, token string, is_end boolean"


def tokens_of(request: str, text: str, size: int) -> list[tuple]:
    parts = [text[i : i + size] for i in range(0, len(text), size)]
    return [(request, at(i / 60), i, p, i == len(parts) - 1) for i, p in enumerate(parts)]


SAMPLES = {
    "a": "before <think>hidden</THINK> after", "b": "no tags, 1 < 2 and <thin air", "c": "tail is open <plan>never shown",
    "d": "stray </analysis> tag", "e": "<reasoning>x</plan>y<think>z</think>w",
}


def test_reasoning_filter_stream_equals_batch(spark, folder):
    rows = [t for k, v in SAMPLES.items() for t in tokens_of(k, v, 3)]
    rows.sort(key=lambda r: r[2])
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    want = {r.request_id: r.text for r in X.visible_text(spark.createDataFrame(rows, TOKENS)).collect()}
    assert want["a"] == "before  after" and want["c"] == "tail is open " and want["d"] == "stray  tag" and want["e"] == "yw"
    out = run(spark, folder, batches, TOKENS, lambda s: X.strip_reasoning_stream(s.drop("ts")), "append")
    got: dict[str, str] = {}
    for r in out.orderBy("request_id", "part").collect():
        got[r.request_id] = got.get(r.request_id, "") + r.text
    assert got == want


def test_strip_pending_at_every_cut():
    for text in SAMPLES.values():
        whole = X.strip_pending(text, False, True)[0]
        for cut in range(len(text) + 1):
            shown, pending, hidden = X.strip_pending(text[:cut], False, False)
            assert shown + X.strip_pending(pending + text[cut:], hidden, True)[0] == whole


def test_memory_stream_replaces_caps_and_expires(spark, folder):
    schema = "chat_id string, ts timestamp, text string"
    first = [("c", at(i), f"note {i}") for i in range(10)] + [("c", at(20), " NOTE  9 ")]
    later = [("d", at(60 * 24 * 31), "x")]
    out = run(spark, folder, [first, later, [("d", at(60 * 24 * 31 + 5), "y")]], schema, X.memory_stream, "update")
    mine = [r.text for r in out.filter("chat_id = 'c'").collect()]
    assert mine[:8] == ["NOTE 9", "note 8", "note 7", "note 6", "note 5", "note 4", "note 3", "note 2"]
    assert mine[-1] is None
    assert {r.text for r in out.filter("chat_id = 'd'").collect()} == {"x", "y"}


def test_assembled_messages(spark, folder):
    rows = tokens_of("r1", "hello world", 4) + tokens_of("r2", "bye", 2)
    sources = spark.createDataFrame([("r1", at(1), "a.txt")], "request_id string, source_ts timestamp, sources string")
    batch = {(r.request_id, r.text, r.sources) for r in X.assemble_batch(spark.createDataFrame(rows, TOKENS), sources).collect()}
    assert batch == {("r1", "hello world", "a.txt"), ("r2", "bye", None)}
    src, tok = f"{folder}/s", f"{folder}/t"
    for part in ([("r1", at(1), "a.txt")], [("zz", at(500), "-")], [("zz", at(501), "-")]):
        spark.createDataFrame(part, "request_id string, source_ts timestamp, sources string").coalesce(1).write.mode("append").parquet(src)
    for part in (rows, [("zz", at(500), 0, "-", True)], [("zy", at(501), 0, "-", True)]):
        spark.createDataFrame(part, TOKENS).coalesce(1).write.mode("append").parquet(tok)
    read = lambda path, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    df = X.assemble_messages(read(tok, TOKENS), read(src, "request_id string, source_ts timestamp, sources string"))
    got = {(r.request_id, r.text, r.sources) for r in drain(spark, folder, df, "append").collect()}
    assert batch <= got


def test_batches_do_known_bytes_once(spark, folder):
    from pyspark.sql import functions as F

    from lectern.streaming import ingest as I

    def batch(*rows):
        df = spark.createDataFrame([(p, at(s), c.encode(), chat) for p, s, c, chat in rows], "path string, modificationTime timestamp, content binary, chat_id string")
        return df.withColumn("length", F.when(F.col("path") == "/huge.txt", 1 << 27).otherwise(F.octet_length("content")).cast("bigint"))

    def table(name):
        return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/sink/{name}").select(*{"files": ("file_id", "path", "status"), "links": ("chat_id", "file_id"), "chunks": ("chunk_id", "text")}[name]).collect())

    write = I.batch_writer(f"{folder}/sink", "inbox")
    first = batch(("/a.txt", 1, "one text", "x"), ("/b.txt", 2, "one text", "y"), ("/huge.txt", 3, "refused at first", "x"))
    write(first, 0)
    files, links, chunks = (table(n) for n in ("files", "links", "chunks"))
    assert [(p, s) for _, p, s in files if s == "completed"] == [("/a.txt", "completed")] and len(links) == 3 and len(chunks) == 1
    write(first, 0)
    assert (table("files"), table("links"), table("chunks")) == (files, links, chunks)
    # the same bytes under another name and in another chat, a new text, and the bytes that were refused
    second = batch(("/c.txt", 9, "one text", "x"), ("/c.txt", 10, "one text", "z"), ("/d.txt", 11, "two", "x"), ("/cut.txt", 12, "refused at first", "x"))
    for _ in range(2):
        write(second, 1)
        assert len(table("chunks")) == len({c for c, _ in table("chunks")}) and sum(t == "one text" for _, t in table("chunks")) == 1
        assert len(table("links")) == 5
    rows = {r.path: r for r in I.current_files(spark, f"{folder}/sink").collect()}
    assert rows["/cut.txt"].status == "completed" and "/huge.txt" not in rows
    assert rows["/a.txt"].status == "completed" and "/c.txt" not in rows and rows["/d.txt"].status == "completed"
    assert I.is_known(spark, f"{folder}/sink", rows["/a.txt"].hash) and not I.is_known(spark, f"{folder}/sink", "0" * 64)
    assert I.known_files(spark, f"{folder}/none") is None


def test_no_bytes_in_a_shuffle(spark):
    from lectern.plans import jobs

    files = spark.createDataFrame([("/a.txt", "a.txt", 3, at(0), b"abc", "x")], "path string, filename string, size_bytes bigint, created_at timestamp, content binary, chat_id string")
    narrow = files.select("path", "created_at")
    plan = jobs.with_bytes(narrow, files)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    made = jobs.ingest(files, dims=spark.createDataFrame([(jobs.MODEL, jobs.VERSION, 3)], "embedding_model string, embedding_version int, dim int"))
    assert made["vectors"].count() == 0 and made["failures"].first().exception_name == "DimensionMismatch"
    assert made["files"].first().status == "failed"


def test_ingest_stream_is_replayable(spark, folder):
    import pathlib

    inbox = pathlib.Path(f"{folder}/inbox")
    inbox.mkdir()
    (inbox / "a.txt").write_text("# Title\n\nfirst paragraph\n\nsecond")
    (inbox / "b.csv").write_text("a , b\n1, 2")
    (inbox / "c.bin").write_bytes(b"\x00\x01")
    for turn in range(2):
        query = ingest_stream(spark, str(inbox), f"{folder}/sink", f"{folder}/cp{turn}", available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
    chunks = spark.read.parquet(f"{folder}/sink/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 3
    assert spark.read.parquet(f"{folder}/sink/failures").count() == 0
    assert spark.read.parquet(f"{folder}/sink/links").count() == 3 and spark.read.parquet(f"{folder}/sink/raw_large").count() == 0
    assert spark.read.parquet(f"{folder}/sink/vectors").filter("vector is not null").count() >= 2
