"""CSV profiling and loading, job tables, rate limits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from msgspark.operators import bayes, jobs as J, telemetry as G
from msgspark.sources import csv_files

LONG = "this is a long enough message text"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    p = tmp_path_factory.mktemp("csv")
    write = lambda name, data: (p / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    write("single.csv", "email_text\n" + "\n".join(f"{LONG} {i}" for i in range(6)) + "\n")
    write("multi.csv", "id,subject,message,is_spam\n" + "\n".join(f"{i},s{i},\"{LONG}, {i}\",{i % 2}" for i in range(6)) + "\n")
    write("headerless.csv", "\n".join(f"{LONG} without any header row {i},ham" for i in range(6)) + "\n")
    write("bom.csv", b"\xef\xbb\xbftext,label\n" + f"{LONG},spam\n".encode() * 6)
    write("latin1.csv", "text\n".encode() + f"{LONG} caf\xe9\n".encode("latin-1") * 6)
    write("quoted.csv", f'text,label\n"{LONG}\nsecond line, with ""quotes""",ham\n' * 1 + f"{LONG} b,spam\n")
    write("dups.csv", f"text,text,,label\n{LONG},b,,spam\n")
    write("ragged.csv", f"text,label\n{LONG},ham,extra,more\n\n , \n{LONG} c,spam\nonly\n")
    write("empty.csv", "")
    write("header_only.csv", "text,label\n")
    return p


def profiles(spark, folder):
    return {r["path"].rsplit("/", 1)[1]: r for r in csv_files.profile_files(spark, str(folder / "*.csv")).collect()}


def test_profiles(spark, folder):
    p = profiles(spark, folder)
    assert len(p) == 10
    pick = lambda n: (p[n]["email_column"], p[n]["label_column"], p[n]["has_header"], p[n]["format_type"], p[n]["confidence_score"])
    assert pick("single.csv") == ("email_text", None, True, "batch_only", 1.0)
    assert pick("multi.csv") == ("message", "is_spam", True, "training_data", 1.0)
    assert pick("headerless.csv")[:4] == ("0", "1", False, "training_data")
    assert pick("bom.csv")[:2] == ("text", "label")
    assert p["latin1.csv"]["detected_encoding"] == "latin-1" and p["bom.csv"]["detected_encoding"] == "utf-8"
    assert any("Duplicate column names" in w for w in p["dups.csv"]["warnings"])
    assert any("Empty column names" in w for w in p["dups.csv"]["warnings"])
    assert any("Inconsistent column count in 1 rows" in e for e in p["ragged.csv"]["errors"])
    assert p["empty.csv"]["errors"] == ["File is empty"]
    assert "No data rows found in CSV file" in p["header_only.csv"]["errors"]
    assert p["multi.csv"]["is_valid"] and p["multi.csv"]["batch_use"] == "accept"


def test_read_messages(spark, folder):
    names = ["single.csv", "multi.csv", "headerless.csv", "bom.csv", "latin1.csv", "quoted.csv"]
    rows = csv_files.number_messages(csv_files.read_messages(spark, [str(folder / n) for n in names])).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[1], {})[r["email_index"]] = (r["text"], r["label"])
    assert by["multi.csv"][3] == (f"{LONG}, 2", "0")
    assert by["headerless.csv"][1] == (f"{LONG} without any header row 0", "ham") and len(by["headerless.csv"]) == 6
    assert by["latin1.csv"][1][0].endswith("café")
    assert by["quoted.csv"][1][0] == f'{LONG}\nsecond line, with "quotes"'
    assert {n: len(v) for n, v in by.items()} == {**{n: 6 for n in names}, "quoted.csv": 2}


def test_ragged(spark, folder):
    rows = csv_files.read_ragged(spark, str(folder / "ragged.csv"), text_pos=1).orderBy("_seq").collect()
    assert [(r["text"], r["problem"]) for r in rows] == [("ham", None), ("spam", None), (None, "Not enough columns, skipping")]


def test_strict_loader(spark, folder, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text(f"text,label\n{LONG},SPAM\n{LONG},ham\n,ham\nshort,0\n{LONG} d,odd\n{LONG} e,\n")
    got = {(r["text"], r["label"]) for r in csv_files.read_labelled(spark, str(f)).collect()}
    assert got == {(LONG, "spam"), ("short", "legitimate"), (f"{LONG} d", "unknown")}
    assert {r["text"] for r in csv_files.read_batch(spark, str(f)).collect()} == {LONG, f"{LONG} d"}
    with pytest.raises(ValueError):
        csv_files.read_labelled(spark, str(folder / "single.csv"))
    v = tmp_path / "v.csv"
    v.write_bytes("v1,v2,,\nHam,hello caf\xe9,,\nspam,,,\n".encode("latin-1"))
    assert [tuple(r) for r in csv_files.read_v1v2(spark, str(v)).collect()] == [("ham", "hello café")]
    assert csv_files.first_existing(spark, [str(tmp_path / "none.csv"), str(v), str(f)]) == str(v)


def test_score_files(spark, folder, tmp_path):
    from msgspark.plans.batch_scoring import score_files

    train = spark.createDataFrame([(i, f"{w} message number text", int(w == "spam")) for i, w in enumerate(["spam", "plain"] * 20)],
                                  "row_id bigint, text string, label int")
    terms, priors = bayes.fit(train)
    res, jobs = score_files(spark, [str(folder / "single.csv"), str(folder / "multi.csv")], terms, priors, results_path=str(tmp_path / "out"))
    assert res.count() == 12 and {r["status"] for r in jobs.collect()} == {"completed"}
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 12 and "error_message" in back.columns


def test_abort_gate(spark):
    rows = [("a", i, "error" if i % 3 == 0 else "success") for i in range(1, 101)]  # eleventh error at 33
    rows += [("b", i, "error" if i > 45 else "success") for i in range(1, 101)]      # five errors up to 50
    df = spark.createDataFrame(rows, "job_id string, email_index bigint, status string")
    kept = J.gate_results(df)
    assert {r["job_id"]: (r["n"], r["partial"]) for r in kept.groupBy("job_id", "partial").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        "a": (33, True), "b": (100, False)}


def brute_limit(times, limit, span):
    taken, out = [], []
    for t in times:
        taken = [x for x in taken if x > t - span]
        out.append(len(taken) < limit)
        if out[-1]:
            taken.append(t)
    return out


def requests(spark, n=600):
    import random

    rng = random.Random(4)
    start = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((i, "hot" if hot else f"c{i % 7}", start + dt.timedelta(seconds=rng.randrange(0, 4 * 3600 if hot else 40 * 3600))))
    return rows, spark.createDataFrame(rows, "request_id bigint, client string, ts timestamp_ntz")


def test_rate_limit_matches_sequential(spark):
    rows, df = requests(spark)
    got = {r["request_id"]: r["accepted"] for r in G.rate_limit(df, limit=5, window_minutes=60).collect()}
    assert len(got) == len(rows)
    for c in {r[1] for r in rows}:
        mine = sorted((r[2].timestamp(), r[0]) for r in rows if r[1] == c)
        assert [got[i] for _, i in mine] == brute_limit([t for t, _ in mine], 5, 3600)
    assert not all(got.values())


def test_retention_edges(spark):
    t = dt.datetime(2024, 1, 2)
    rows = [("done_old", "completed", t - dt.timedelta(hours=25)), ("done_new", "completed", t - dt.timedelta(hours=23)),
            ("failed_old", "failed", t - dt.timedelta(hours=2)), ("never", "completed", None), ("failed_open", "failed", None)]
    jobs = spark.createDataFrame([(j, s, c, t - dt.timedelta(hours=30), None) for j, s, c in rows],
                                 "job_id string, status string, completed_at timestamp_ntz, created_at timestamp_ntz, result_file_path string")
    got = {r["job_id"]: r["reason"] for r in J.expired_jobs(jobs, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).collect()}
    assert got == {"done_old": "expired", "failed_old": "failed", "failed_open": "failed"}


def test_ragged_lines_returns_quoted_and_blank_rows(spark, tmp_path):
    import csv

    from msgspark.plans.csv_queries import ragged_lines

    texts = ['a,b,c\na,,b\n"x, y","say ""hi"" now",z\nhe said, "no, never\n , \n"open, to the end\n"a"b"c,d"e\n,"",\nshort', 'p,"q",r']
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, text in enumerate(texts):
        for i, line in enumerate(text.split("\n")):
            f = next(csv.reader([line]))
            if any(x.strip() for x in f):
                want.append((d, i, (f[1].strip() or None) if len(f) > 1 else None, len(f) < 2))
    assert sorted(tuple(r) for r in ragged_lines(spark, str(tmp_path)).collect()) == want


def test_each_message_file_is_sorted_in_a_task_of_its_own(spark, tmp_path):
    from pathlib import Path

    from msgspark.plans import file_queries

    rows = [(i, f'a "quoted" text {i}', lang, "web", 9) for i, lang in enumerate(["en", "de", "fr", "es"] * 12)]
    rows = [(i // 4 + 12 * (i % 4), *r) for i, (_, *r) in enumerate(rows)]  # every language in every bucket
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    path = file_queries.message_files(spark, str(tmp_path))
    files = [f for f in Path(path.removeprefix("file:")).rglob("part-*")]
    assert len(files) == len({f.parent for f in files}) == 16, files
    assert len({f.name.split("-")[1] for f in files}) == 16  # numbers of the tasks that wrote them
    for f in files:
        ids = [int(line.split(" text ")[1].split('"')[0]) for line in f.read_text().splitlines() if " text " in line]
        assert ids == sorted(ids) and len(ids) in (2, 3)  # a Spanish row too short has no text
