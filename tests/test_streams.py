import datetime as dt
import os

import pytest

from auditloom.functions.session import materialise, small_rows, spread
from auditloom.operators import snapshots as N
from auditloom.plans import catalog
from auditloom.sources import corpus, logs
from auditloom.streaming import jobs


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def parts(spark, folder, schema, *batches):
    """A stream that takes one file per trigger, in order."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("b"):
                os.rename(f"{folder}/{f}", f"{folder}/b{i}.parquet")
                os.utime(f"{folder}/b{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "b*.parquet").parquet(folder)


def test_reaudit_stream_equals_batch(spark, folder):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * i)
    big = "\n".join(f"l{i}" for i in range(30))
    texts = [big, big, big.replace("l1\n", " l1\n\n"), big + "\nend", "short", "short "]
    data = [(p, day(i), t) for i, t in enumerate(texts) for p in ("a", "b")]
    schema = "path string, ts timestamp, content string"
    stream = parts(spark, folder, schema, data[:5], data[5:9], data[9:])
    got = {(r.path, r.ts): r["mode"] for r in drain(jobs.reaudit(stream, 20, 10), "modes").collect()}
    batch = N.audit_mode(N.with_history(spark.createDataFrame(data, schema)), 20, 10)
    assert got == {(r.path, r.ts): r["mode"] for r in batch.collect()}
    assert [got[("a", day(i))] for i in range(6)] == ["index_only", "skip", "skip", "diff", "full", "skip"]


def test_reaudit_state_expires(spark):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    schema = "path string, ts timestamp, content string"
    given = [[("a", day(0), "x"), ("b", day(0), "x")], [("b", day(20), "x")], [("c", day(40), "x")], [("c", day(41), "y")],
             [("a", day(42), "x"), ("b", day(42), "x")]]
    def modes(**kw):
        out = jobs.run_in_parts([spark.createDataFrame(rows, schema) for rows in given],
                                lambda s: jobs.reaudit(s, 200, 150, **kw), "modes")
        return {(r.path, r.ts): r["mode"] for r in out.collect()}
    kept = {("a", day(0)): "full", ("b", day(0)): "full", ("b", day(20)): "skip", ("c", day(40)): "full",
            ("c", day(41)): "full", ("a", day(42)): "skip", ("b", day(42)): "skip"}
    assert modes() == kept
    assert modes(keep_days=30) == kept | {("a", day(42)): "full"}


def test_windows_drop_late_rows(spark, folder):
    t = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    schema = "ts timestamp, action string"
    # The watermark of a trigger holds for late rows from the next trigger on.
    stream = parts(spark, folder, schema, [(t(5), "ACCEPT"), (t(50), "REJECT")], [(t(200), "ACCEPT")], [(t(201), "ACCEPT")],
                   [(t(10), "ACCEPT")], [(t(300), "REJECT")])
    got = {(r.window_start, r.action): r.n for r in drain(jobs.windowed_verdicts(stream), "rates").collect()}
    assert got[(t(0), "ACCEPT")] == 1 and got[(t(0), "REJECT")] == 1


def test_runs_carry_state_and_drop_late_rows(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    schema = "key string, ts timestamp"
    given = [[("k", t(0)), ("k", t(20)), ("j", t(5))], [("k", t(45)), ("j", t(300))], [("k", t(600))],
             [("k", t(1)), ("k", t(601))], [("z", t(9000))]]
    out = jobs.run_in_parts([spark.createDataFrame(rows, schema) for rows in given], jobs.save_bursts, "bursts")
    # A session goes on over two runs; the row of minute 1 comes when its session is closed.
    assert sorted((r.key, r.session_start, r.n_saves) for r in out.collect()) == [
        ("j", t(5), 1), ("j", t(300), 1), ("k", t(0), 3), ("k", t(600), 2)]


def test_repeat_sends(spark, folder):
    t = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    schema = "path string, hash string, ts timestamp"
    stream = parts(spark, folder, schema, [("a", "1", t(0)), ("a", "1", t(1)), ("b", "1", t(1))], [("a", "1", t(5)), ("a", "2", t(6))])
    got = sorted((r.path, r.hash) for r in drain(jobs.suppress_repeats(stream), "sends").collect())
    assert got == [("a", "1"), ("a", "2"), ("b", "1")]


def test_save_bursts_and_alerts(spark, folder):
    t = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    data = [("k", t(0)), ("k", t(29)), ("k", t(60)), ("k", t(89)), ("j", t(1))]
    batch = jobs.save_bursts(spark.createDataFrame(data, "key string, ts timestamp"))
    assert sorted((r.key, r.session_start, r.n_saves) for r in batch.collect()) == [
        ("j", t(1), 1), ("k", t(0), 2), ("k", t(60), 2)]
    logs.append_overrides(spark.createDataFrame(
        [(t(i), "incomplete_chain" if i % 2 else "literal_string_source") for i in range(9)],
        "timestamp timestamp, override_reason string"), folder)
    batch = jobs.override_alerts(logs.read_overrides(spark, folder), 4)
    assert [(r.override_reason, r.n) for r in batch.collect()] == [("literal_string_source", 5)]
    live = drain(jobs.override_alerts(logs.stream_overrides(spark, folder), 4), "alerts", "complete")
    assert [(r.override_reason, r.n) for r in live.collect()] == [("literal_string_source", 5)]


def write(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


def test_corpus(spark, folder):
    write(folder, "src/a.py", b"password = 'longenough1'\n\xff\xfe")
    write(folder, "src/b.js", "é = 1".encode())
    write(folder, "node_modules/x/c.js", b"x")
    write(folder, "notes.md", b"x")
    write(folder, "big.py", b"y" * 3000)
    got = {r.path: r for r in corpus.scan(spark, folder, max_kb=2).collect()}
    assert set(got) == {"src/a.py", "src/b.js", "big.py"}
    assert got["src/a.py"].code == "password = 'longenough1'\n" and got["src/a.py"].ext == ".py"
    assert got["src/b.js"].code == "é = 1"
    assert (got["big.py"].code, got["big.py"].skip_reason) == (None, "File too large (2.9KB)")
    found = jobs.run_to_table(jobs.continuous_screen(corpus.stream(spark, folder)), "screened")
    assert [(r.rule_id, r.line_number) for r in found.collect()] == [("L1-SECRET", 1)]


def test_ledger_round_trip(spark, folder, rows):
    now = dt.datetime(2024, 5, 6, 7, 8, 9)
    text = "# Walk\n\n## not a block\n" + logs.ledger_text(
        rows("ts timestamp, result string, reasoning string", (now, "REJECT", " two\n> lines ## x "))).first()[0]
    entries = logs.ledger_entries(rows("ledger string, content string", ("l", text + text[text.index("\n## 2024"):])))
    assert [(r.seq, r.ts, r.result, r.reasoning) for r in entries.orderBy("seq").collect()] == [
        (1, now, "REJECT", "two\n> lines ## x"), (2, now, "REJECT", "two\n> lines ## x")]


def test_findings_sink_stream(spark, folder, rows):
    logs.append_findings(rows("path string, severity string", ("a", "HIGH"), ("b", "LOW")), f"{folder}/in", "severity")
    stream = spark.readStream.schema("path string, severity string").parquet(f"{folder}/in")
    logs.stream_findings(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    logs.stream_findings(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 2


def test_session_helpers(spark, rows):
    df = spark.range(5)
    assert materialise(df, "t").count() == 5
    with pytest.raises(ValueError):
        small_rows(df, 4)
    assert len(small_rows(df, 5)) == 5
    assert spread(spark.range(0, 5, 1, 50), "id").rdd.getNumPartitions() == 50
    assert spread(spark.range(0, 5, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_table_of_part_files_is_streamed_whole(spark, folder):
    """ST1 and ST2 on documents as one file and as a folder of part files: the same rows."""
    small = "/root/testdata/sf0.01"
    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("st1_continuous_screen", "st2_reaudit_state"):
        one, many = (catalog.QUERIES[name](spark, sf) for sf in (small, folder))
        assert one.count() > 0
        assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0


def test_tasks_of_narrow_scans_grow_with_the_splits(spark, folder):
    spark.range(1000).repartition(12).write.parquet(f"{folder}/narrow")
    scan = spark.read.parquet(f"{folder}/narrow")
    splits = scan.rdd.getNumPartitions()
    dealt = spread(scan, "id", per_split=16)
    assert dealt.rdd.getNumPartitions() >= 16 * splits and dealt.count() == 1000


def test_dealt_tasks_follow_bytes_and_not_the_size_of_splits(spark, tmp_path):
    spark.range(0, 1_500_000, 1, 1).selectExpr("id", "rand(1) AS x").write.parquet(f"{tmp_path}/t")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        scan = spark.read.parquet(f"{tmp_path}/t")
        assert scan.rdd.getNumPartitions() == 1
        dealt = spread(scan, "id", per_split=16)
        assert dealt.rdd.getNumPartitions() >= 48 and dealt.count() == 1_500_000
        assert spread(scan, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == small
