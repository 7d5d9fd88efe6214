"""Streams over chunks of files give what the batch operators give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from msgspark.operators import bayes, scoring, telemetry as G
from msgspark.plans import derived as d
from msgspark.plans.text_queries import labelled, messages
from msgspark.streaming import jobs as S


@pytest.fixture(scope="module")
def chunks(spark, sf, tmp_path_factory):
    """Event-derived tables as three files in time order."""
    root = tmp_path_factory.mktemp("chunks")
    made = {}
    for name, fn in (("requests", d.requests), ("perf", d.perf), ("errors", d.errors)):
        df = fn(spark, sf).orderBy("ts").toPandas()
        path = root / name
        path.mkdir()
        step = -(-len(df) // 3)
        for i in range(3):
            part = df.iloc[i * step:(i + 1) * step]
            part.to_parquet(path / f"part{i}.parquet", index=False, coerce_timestamps="us")
        made[name] = (str(path), spark.read.parquet(str(path)).schema)
    return made


def stream(spark, chunk):
    path, schema = chunk
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_request_stats(spark, chunks):
    got = drain(S.request_stats(stream(spark, chunks["requests"])), "req_stats", "complete")
    want = G.daily_requests(spark.read.parquet(chunks["requests"][0]))
    assert {(r["window_start"].date(), r["processed"]) for r in got.collect()} == {(r["day"], r["processed"]) for r in want.collect()}


def test_sliding_performance(spark, chunks):
    got = drain(S.sliding_performance(stream(spark, chunks["perf"])), "slide", "complete")
    row = got.orderBy(F.desc("operations_count"), "window_start").first()
    batch = spark.read.parquet(chunks["perf"][0]).filter((F.col("ts") >= F.lit(row["window_start"])) & (F.col("ts") < F.lit(row["window_end"])))
    assert batch.count() == row["operations_count"]


def test_alerts(spark, chunks, tmp_path):
    seen = []
    q = S.send_alerts(S.alert_stream(stream(spark, chunks["perf"]), keep=("metric_id",)),
                      [lambda b, i: seen.append(b.count()), lambda b, i: b.write.mode("append").json(str(tmp_path / "log"))],
                      checkpoint=str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    want = G.threshold_alerts(spark.read.parquet(chunks["perf"][0]), keep=("metric_id",)).count()
    assert sum(seen) == want and spark.read.json(str(tmp_path / "log")).count() == want and len(seen) == 3


def test_rate_limit(spark, chunks):
    got = drain(S.rate_limit_stream(stream(spark, chunks["requests"]), limit=2, window_minutes=1440), "limits")
    want = G.rate_limit(spark.read.parquet(chunks["requests"][0]), limit=2, window_minutes=1440)
    key = lambda df: {(r["request_id"], r["accepted"]) for r in df.select("request_id", "accepted").collect()}
    assert key(got) == key(want)


def test_error_state(spark, chunks):
    got = drain(S.error_count_stream(stream(spark, chunks["errors"])), "err_counts", "complete")
    want = G.error_counts(spark.read.parquet(chunks["errors"][0]))
    assert {(f"{r['category']}:{r['error_type']}", r["count"]) for r in got.collect()} == {(r["error_key"], r["count"]) for r in want.collect()}
    last = drain(S.error_pattern_stream(stream(spark, chunks["errors"]), n=7), "err_last", "update")
    newest = {(r["component"], r["operation"]): r["error_ids"] for r in last.collect()}  # later updates win
    want = G.error_patterns(spark.read.parquet(chunks["errors"][0]), 7).groupBy("component", "operation").agg(F.sort_array(F.collect_list("error_id")).alias("ids"))
    assert {k: sorted(v) for k, v in newest.items()} == {(r["component"], r["operation"]): r["ids"] for r in want.collect()}


def test_scoring(spark, sf, tmp_path):
    terms, priors = bayes.fit(labelled(spark, sf))
    docs = messages(spark, sf).withColumnRenamed("row_id", "email_index")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.score_stream(src, terms, priors, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), once=True).awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = scoring.score_messages(docs, terms, priors)
    key = lambda df: {(r["email_index"], r["prediction"], round(r["confidence"], 9)) for r in df.select("email_index", "prediction", "confidence").collect()}
    assert key(got) == key(want) and got.filter("status = 'error'").count() == want.filter("status = 'error'").count()


def test_dedup(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"text {i % 5}", start + dt.timedelta(minutes=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, ts timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = drain(S.dedup_stream(src), "dedup").collect()
    assert len(got) == 5 and {r["text"] for r in got} == {f"text {i}" for i in range(5)}


def test_resumed_equals_uninterrupted_and_late_rows_are_dropped(spark, sf, tmp_path):
    from msgspark.plans import all_queries, stream_queries as Q  # noqa: F401  the first fills the registry

    arriving = Q.late_requests(spark, sf).cache()
    build = lambda r: S.request_stats(r, every="1 hour")
    key = lambda df: sorted((r["window_start"], r["processed"]) for r in df.collect())
    whole = key(Q.run_in_parts(arriving, str(tmp_path / "a"), build, "append"))
    resumed = key(Q.run_in_parts(arriving, str(tmp_path / "b"), build, "append", stop_after=2))
    assert whole == resumed and len({w for w, _ in whole}) == len(whole)
    assert sum(n for _, n in whole) < arriving.count()  # the late ones are gone, so is what the watermark has not passed


def test_rate_limit_of_one_hot_client_in_many_chunks(spark, tmp_path):
    from test_files_jobs import brute_limit

    import random

    rng = random.Random(8)
    start = dt.datetime(2024, 5, 1)
    rows = [(i, "hot" if i % 10 else "cold", start + dt.timedelta(seconds=rng.randrange(0, 86400))) for i in range(4000)]
    df = spark.createDataFrame(rows, "request_id bigint, client string, ts timestamp_ntz")
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        got = {r["request_id"]: r["accepted"] for r in drain(S.rate_limit_stream(src, limit=7, window_minutes=60), "hot_limits").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for c in ("hot", "cold"):
        mine = sorted((r[2].timestamp(), r[0]) for r in rows if r[1] == c)
        assert [got[i] for _, i in mine] == brute_limit([t for t, _ in mine], 7, 3600)
