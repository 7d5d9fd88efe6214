"""Records of split files against Spark's multi-line reader and Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from msgspark.sources import quoted_csv


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so records cross many of them."""
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def field(rng):
    kind = rng.random()
    words = [rng.choice(["plain", "a,b", 'say "hi"', "line\nend", "crlf\r\nend", "", "ünï", '"', "\n\n", ",,", "x" * 60]) for _ in range(rng.randint(1, 4))]
    return " ".join(words) * (30 if kind < 0.03 else 1)


def quoted(text, rng):
    if rng.random() < 0.3 or any(c in text for c in ',"\n\r'):
        return '"' + text.replace('"', '""') + '"'
    return text


def body(rng, n, end):
    rows = [[field(rng) for _ in range(3)] for _ in range(n)]
    return rows, end.join(",".join(quoted(x, rng) for x in row) for row in rows) + (end if rng.random() < 0.5 else "")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_equal_the_multi_line_reader(spark, small_splits, tmp_path, end):
    rng = random.Random(len(end))
    for i in range(4):
        (tmp_path / f"f{i}.csv").write_bytes(("﻿" if i == 1 else "").encode() + ("a,b,c" + end + body(rng, 150, end)[1]).encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    got = quoted_csv.rows(spark, str(tmp_path), 3, header=True).orderBy("path", "position").collect()
    schema = "c0 string, c1 string, c2 string"
    want = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("lineSep", end).csv(str(tmp_path)).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("i"),
                                                              F.array("c0", "c1", "c2").alias("fields")).orderBy("path", "i").collect())
    assert quoted_csv.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 50
    assert [(r.path, r.fields) for r in got] == [(r.path, r.fields) for r in want] and len(got) >= 590


def test_latin_1_and_a_record_over_many_splits(spark, small_splits, tmp_path):
    text = "caf\xe9\n" * 400
    (tmp_path / "l.csv").write_bytes(f'id,text\n1,"{text}"\n2,b\n3,"{text}{text}"\n'.encode("latin-1"))
    rows = quoted_csv.rows(spark, str(tmp_path / "l.csv"), 2, header=True, encoding="ISO-8859-1").orderBy("position").collect()
    assert [r.fields for r in rows] == [["1", text], ["2", "b"], ["3", text + text]]


def test_stray_and_open_quotes_as_the_reader_sees_them(spark, small_splits, tmp_path):
    rng = random.Random(5)
    pieces = ['a"b', '"x"y', '""', '"', ",", "\n", "word", '"open\n', 'end"', '"",', " ", '""""', "long " * 30]
    for i in range(12):
        (tmp_path / f"s{i}.csv").write_bytes("".join(rng.choice(pieces) for _ in range(400)).encode())
    got = {}
    for r in quoted_csv.records(spark, str(tmp_path)).orderBy("path", "position").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(bytes(r.record).decode())
    for i in range(12):
        data = (tmp_path / f"s{i}.csv").read_text()
        want = [row for row in csv.reader(io.StringIO(data, newline="")) if row]
        assert [next(csv.reader([x])) for x in got[f"s{i}.csv"]] == want


def test_ends_inside_equals_the_reader():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice('",ab') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            rows = list(csv.reader(io.StringIO(('"' if inside else "") + line + "\nZ", newline="")))
            assert quoted_csv.ends_inside(line.encode(), inside) == (len(rows) == 1)


def test_a_quote_that_is_never_closed(spark, small_splits, tmp_path):
    (tmp_path / "o.csv").write_text('a,b\n1,"open\n' + "more, lines\n" * 200)
    rows = quoted_csv.records(spark, str(tmp_path / "o.csv")).orderBy("position").collect()
    assert [bytes(r.record)[:8] for r in rows] == [b"a,b", b'1,"open\n'] and [r.first for r in rows] == [True, False]
    one = tmp_path / "one"
    one.mkdir()
    (one / "o.csv").write_text('"' + "x" * 500)
    with pytest.raises(Exception, match="never closed"):
        quoted_csv.records(spark, str(one), max_record=100).collect()
