"""Sources and sinks: audit rows, stores, files, vectors, datasets, rollups."""

import json
import zlib
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from guardspark.config import EngineConfig
from guardspark.functions import normalize
from guardspark.operators.corpus import build_corpus
from guardspark.operators.audit import audit_evaluations, audit_outputs
from guardspark.plans import soc
from guardspark.plans.screen import scan_outputs, screen
from guardspark.schemas import AUDIT, REQUESTS
from guardspark.sources import io, npy
from guardspark.sources.datasets import Dataset, read_attacks

AT = "2024-05-06 10:00:00"


def screened(spark, ids):
    rows = [(i, None, "hello there", "acme", "chat", None, False, {}) for i in ids]
    return screen(spark.createDataFrame(rows, REQUESTS), EngineConfig())


def test_every_audit_row_has_an_id_of_its_own(spark):
    cfg = EngineConfig()
    df = screened(spark, ["a", "a", None, None, "b"])
    out = scan_outputs(df.select("request_id", "tenant_id", F.lit("x").alias("output")), cfg)
    found = [audit_evaluations(df, cfg, F.lit(AT), "1"), audit_evaluations(df, cfg, F.lit(AT), "2"), audit_outputs(out, cfg, F.lit(AT), "1")]
    ids = [r.event_id for f in found for r in f.collect()]
    assert len(set(ids)) == 15
    assert [r.event_id for r in found[0].collect()] == ids[:5]  # planned again, the same


def test_audit_rows_tell_time_and_error(spark, tmp_path):
    rows = audit_evaluations(screened(spark, ["a"]), EngineConfig(), F.lit(AT))
    io.write_audit(rows, str(tmp_path / "log"))
    (r,) = io.read_audit(spark, str(tmp_path / "log")).collect()
    assert io.read_audit(spark, str(tmp_path / "log")).schema == spark.createDataFrame([], AUDIT).schema
    by_layer = {d.layer: d for d in r.scanner_details}
    assert by_layer["structural"].latency_ms is None and by_layer["pattern"].latency_ms >= 0
    assert r.total_latency_ms == pytest.approx(by_layer["pattern"].latency_ms) and {d.error for d in r.scanner_details} == {None}


@pytest.fixture
def store(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/store;create=true"
    read = lambda: spark.read.format("jdbc").options(url=url, dbtable="audit").load()
    return url, read


def test_rows_stand_once_in_the_store(spark, store, tmp_path):
    url, read = store
    write = io.jdbc_store(url, "audit")
    sink = io.audit_sink(str(tmp_path / "log"), write, EngineConfig())
    batch = audit_evaluations(screened(spark, ["a", "b", None]), EngineConfig(), F.lit(AT), "7")
    sink(batch, 7)
    sink(batch, 7)  # run again
    sink(audit_evaluations(screened(spark, ["c"]), EngineConfig(), F.lit(AT), "8"), 8)
    got = read().collect()
    assert sorted((r.request_id or "", r.batch_id) for r in got) == [("", 7), ("a", 7), ("b", 7), ("c", 8)]
    assert len({r.event_id for r in got}) == 4 and all(r.scanner_details.startswith("[{") for r in got)
    assert not (tmp_path / "log").exists()


def test_a_batch_that_breaks_off_is_in_one_place(spark, store, tmp_path):
    url, read = store
    audit = lambda ids, n: audit_evaluations(screened(spark, ids), EngineConfig(), F.lit(AT), n)
    io.jdbc_store(url, "audit")(audit(["a"], "1"), 1)
    half = audit(["b", "c"], "2").withColumn("verdict", F.when(F.col("request_id") == "c", F.raise_error(F.lit("half way"))).otherwise(F.col("verdict")))
    with pytest.raises(Exception, match="half way"):
        io.jdbc_store(url, "audit")(half, 2)
    assert [r.request_id for r in read().collect()] == ["a"]

    def breaks(df, batch_id):
        raise ConnectionError

    log = str(tmp_path / "log")
    io.audit_sink(log, breaks)(audit(["b", "c"], "2"), 2)  # files instead
    assert {r.request_id for r in spark.read.json(log).collect()} == {"b", "c"}
    io.audit_sink(log, io.jdbc_store(url, "audit"))(audit(["b", "c"], "2"), 2)  # the store is back
    assert sorted(r.request_id for r in read().collect()) == ["a", "b", "c"]
    assert not list((tmp_path / "log").glob("batch=2"))


def test_retention_follows_the_settings(spark, tmp_path):
    log, today = str(tmp_path / "log"), date.today()
    days = [today - timedelta(days=d) for d in (0, 5, 40)]
    old = spark.createDataFrame([(str(d),) for d in days], "event_date string").withColumn("x", F.lit(1))
    io.write_audit(old, log)
    io.audit_sink(log, None, EngineConfig(retention_days=10))(old.where(F.col("event_date") == str(today)), 1)
    assert {str(r.event_date) for r in spark.read.json(f"{log}/event_date=*").select(F.input_file_name().alias("f")).select(F.regexp_extract("f", r"event_date=([0-9-]+)", 1).alias("event_date")).collect()} == {str(d) for d in days[:2]}


def test_bombs_are_inflated_within_bounds(spark):
    text = lambda n: zlib.compress(b"a" * n, 0 if n < 100 else 9).decode("latin-1")
    ratio = normalize._ratio
    assert ratio(None) is None and ratio("") is None and ratio("x plain text") is None
    stream = zlib.compress(b"", 9)
    assert ratio(stream.decode("latin-1")) is None or ratio(stream.decode("latin-1")) >= 0
    # A stream whose bytes are all ASCII, as a text can hold it.
    for n in range(1, 4000):
        data = zlib.compress(b"\x01" * n, 9)
        if data.isascii():
            assert ratio(data.decode()) == pytest.approx(n / len(data))
            assert ratio(data.decode()[:-1]) is None
            break


def test_corpus_in_two_parts(spark, tmp_path):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "index int, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "v"))
    (tmp_path / "m.json").write_text('[{"index": 0, "text": "a", "category": "dos"}, {"index": 2, "text": "c", "category": "jb"}]')
    got = {r["index"]: (r.text, r.category) for r in io.read_corpus_parts(spark, str(tmp_path / "v"), str(tmp_path / "m.json")).collect()}
    assert got == {0: ("a", "dos"), 1: (None, None), 2: ("c", "jb")}



def test_webhook_failures_cost_nothing(spark, tmp_path):
    calls = str(tmp_path)

    def send(payload):
        import os
        import uuid

        open(os.path.join(calls, uuid.uuid4().hex), "w").write(payload)
        raise ConnectionError

    rows = spark.createDataFrame([("escalate", ["f"], "why"), ("block", [], "no")], "verdict string, findings array<string>, reason string")
    io.webhook_sink(send)(rows, 0)
    (sent,) = [p.read_text() for p in tmp_path.iterdir()]
    assert sent == '{"verdict":"escalate","findings_count":1,"arbitration_reason":"why"}'


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f4"])
def test_npy_rows_are_those_of_the_file(spark, tmp_path, kind):
    v = np.random.default_rng(1).normal(size=(1003, 17)).astype(kind)
    np.save(tmp_path / "v.npy", v)
    for path in (str(tmp_path / "v.npy"), f"file://{tmp_path}/v.npy"):
        df = npy.read_npy(spark, path, 17 * 8 * 100)
        assert df.rdd.getNumPartitions() >= 6 and df.schema.simpleString() == "struct<index:bigint,embedding:array<float>>"
        rows = sorted(df.collect(), key=lambda r: r["index"])
        assert [r["index"] for r in rows] == list(range(1003))
        assert np.array_equal(np.array([r.embedding for r in rows], np.float32), v.astype(np.float32))


def test_npy_corpus_tells_of_a_mismatch(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.eye(5, dtype=np.float32))
    (tmp_path / "m.json").write_text(json.dumps([{"text": f"t{i}", "category": "T-JB", "severity": "high"} for i in range(3)]))
    corpus, counts = npy.read_npy_corpus(spark, str(tmp_path / "v.npy"), str(tmp_path / "m.json"))
    assert counts == {"vectors": 5, "metadata": 3}
    got = {r["index"]: (r.text, r.category, r.source, r.embedding) for r in corpus.collect()}
    assert got[2][:3] == ("t2", "T-JB", "unknown") and got[4][:3] == ("", "unknown", "unknown") and got[4][3] == [0, 0, 0, 0, 1]


def test_npy_files_that_are_none(spark, tmp_path):
    np.save(tmp_path / "empty.npy", np.zeros((0, 4), np.float32))
    assert npy.read_npy(spark, str(tmp_path / "empty.npy")).count() == 0
    np.save(tmp_path / "flat.npy", np.zeros(4))
    with pytest.raises(Exception, match="no rows of numbers"):
        npy.read_npy(spark, str(tmp_path / "flat.npy")).count()
    np.save(tmp_path / "whole.npy", np.zeros((10, 4)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "whole.npy").read_bytes()[:-8])
    with pytest.raises(Exception, match="shorter"):
        npy.read_npy(spark, str(tmp_path / "cut.npy")).count()


def test_datasets_and_their_rejected_rows(spark, tmp_path):
    (tmp_path / "j/train").mkdir(parents=True)
    (tmp_path / "j/train/a.jsonl").write_text('{"prompt": "an attack in JSON lines", "kind": 1, "aug": true}\nnot json\n{"prompt": null, "kind": 0}\n{"prompt": "harmless text", "kind": 0, "more": [1]}\n{"prompt": "no label"}\n')
    d = Dataset("one", str(tmp_path / "j"), columns={"text": "prompt", "label": "kind", "augmented": "aug"}, fixed={"category": "direct_injection", "severity": "high"})
    good, rejected = read_attacks(spark, d)
    assert [(r.text, r.label, r.augmented, r.category, r.severity, r.source) for r in good.orderBy("ord").collect()] == [("an attack in JSON lines", 1, True, "direct_injection", "high", "one"), ("harmless text", 0, False, "direct_injection", "high", "one")]
    assert sorted((r.reason, r.row) for r in rejected.collect()) == [("no label", '{"prompt":"no label"}'), ("no text", '{"kind":"0"}'), ("not readable", "not json")]
    (tmp_path / "c/test").mkdir(parents=True)
    (tmp_path / "c/test/b.csv").write_text('id,label,text\n1,malicious,"a ""quoted"" attack, in CSV"\n2,benign,some harmless text\n3\n')
    c = Dataset("two", str(tmp_path / "c"), "csv")
    good2, rejected2 = read_attacks(spark, c, "test")
    assert [(r.text, r.label) for r in good2.orderBy("ord").collect()] == [('a "quoted" attack, in CSV', 1), ("some harmless text", 0)]
    assert rejected2.count() == 1
    frontier = spark.createDataFrame([], "ord long, text string, category string, severity string")
    assert {r.text for r in build_corpus(frontier, good.drop("augmented").withColumn("augmented", F.lit(False)), good2).collect()} == {"an attack in JSON lines", 'a "quoted" attack, in CSV'}
    with pytest.raises(ValueError, match="no columns"):
        read_attacks(spark, Dataset("x", str(tmp_path / "c"), "csv", {"text": "other"}), "test")
    with pytest.raises(ValueError, match="unknown format"):
        read_attacks(spark, Dataset("x", str(tmp_path / "c"), "xml"), "test")


def test_days_are_written_anew_within_bounds(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.range(3000).select(F.lit("2024-01-01").alias("event_date"), F.concat(F.lit("row "), "id").alias("x"), F.repeat(F.lit("y"), (F.col("id") % 90).cast("int")).alias("y"))
    io.write_audit(rows.repartition(40), log)
    io.write_audit(rows.limit(10).withColumn("event_date", F.lit("2024-01-02")), log)
    files = lambda: [f for f in (tmp_path / "log/event_date=2024-01-01").iterdir() if f.name.startswith("part")]
    content = lambda: sorted(tuple(r) for r in spark.read.schema("x string, y string, event_date string").json(log).collect())
    before = content()
    assert len(files()) == 40
    n = io.compact_audit(spark, log, "2024-01-01", 50_000)
    assert n == len(files()) < 12 and max(f.stat().st_size for f in files()) <= 50_000 and content() == before
    kept = {f.name for f in files()}
    assert io.compact_audit(spark, log, "2024-01-01", 50_000) == n and {f.name for f in files()} == kept  # left alone
    (tmp_path / "log/event_date=2024-01-01").rename(tmp_path / "log/_old-event_date=2024-01-01")  # a run broke off
    assert io.compact_audit(spark, log, "2024-01-01", 10_000) > n and content() == before
    assert io.compact_audit(spark, log, "2024-09-09") == 0


def test_rollups_of_sketches_merge(spark, tmp_path):
    base = spark.range(60_000).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 5).alias("timestamp"), F.concat(F.lit("t"), F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("id") * 7919 % 5000).cast("string")).alias("tenant_id"), F.when(F.col("id") % 5 == 0, "block").otherwise("allow").alias("verdict"), (F.col("id") * 31 % 1000).cast("double").alias("total_latency_ms"))
    path = str(tmp_path / "rollups")
    soc.sketched(base.where("total_latency_ms < 500")).write.parquet(path)
    soc.sketched(base.where("total_latency_ms >= 500")).write.mode("append").parquet(path)  # two runs over the same hours
    got = {r.period: r for r in soc.merged(spark.read.parquet(path)).collect()}
    exact = base.groupBy(F.date_trunc("day", "timestamp").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("b"), F.count_distinct("tenant_id").alias("t"), F.percentile("total_latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("q")).collect()
    assert len(got) == len(exact) > 2
    for e in exact:
        r = got[e.d]
        assert (r.n, r.n_blocked) == (e.n, e.b) and abs(r.n_tenants - e.t) <= 0.06 * e.t
        assert all(abs(a - b) <= 20 for a, b in zip(r.quantiles, e.q)) and r.top_tenants[0].item == "t0"
