from pyspark.sql import functions as F

from msgspark.functions import fixed_values as fv
from msgspark.operators import rows as R, validate as V

CASES = [
    (None, [fv.ERR_NONE], []), ("", [fv.ERR_EMPTY], []), (" \t ", [fv.ERR_EMPTY], []), ("z" * 9, [fv.ERR_SHORT], []),
    ("\t" + "z" * 9 + " ", [fv.ERR_SHORT], []), ("z" * 10, [], [fv.WARN_SHORT]), ("z" * 49, [], [fv.WARN_SHORT]), ("z" * 50, [], []),
    ("z" * 10000, [], []), ("z" * 10001, [fv.ERR_LONG], []), (" " * 2 + "z" * 9999, [fv.ERR_LONG], []),
]


def frame(spark):
    return spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "row_id bigint, text string")


def test_message_rules(spark):
    got = V.validate_messages(frame(spark)).orderBy("row_id").collect()
    assert [(r["errors"], r["warnings"]) for r in got] == [(c[1], c[2]) for c in CASES]
    assert [r["is_valid"] for r in got] == [not c[1] for c in CASES]


def test_stripped_mode_measures_stripped_text(spark):
    got = V.validate_messages(frame(spark), mode="stripped").filter("row_id = 10").first()
    assert got["errors"] == []


def test_batch(spark):
    v = V.batch_verdict(frame(spark), max_rows=5).first()
    assert (v["n_rows"], v["n_invalid"], v["is_valid"]) == (len(CASES), 7, False)
    first = V.first_batch_error(frame(spark).withColumn("email_index", F.col("row_id") + 1)).first()
    assert first["message"] == "Email at index 0: email_text cannot be None"


def test_payloads(spark):
    rows = [('{"text": "hi", "n": 1}', None, []), ('{"text": "", "n": 1}', "MISSING_REQUIRED_FIELDS", ["text"]), ('{"n": 0}', "MISSING_REQUIRED_FIELDS", ["text", "n"]),
            ("no json", "INVALID_JSON", None), ('{"text": false, "n": [1]}', "MISSING_REQUIRED_FIELDS", ["text"])]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, payload string")
    got = V.check_payloads(df, payload="payload", fields=["text", "n"]).orderBy("i").collect()
    assert [(r["code"], r["missing_fields"]) for r in got] == [(r[1], r[2]) for r in rows]


def test_file_names(spark):
    names = {"a.csv": None, "b.TXT": None, "": "No file", "  ": "Use a file" , "x<y.csv": "special", "x.pdf": "'pdf'", "plain": "'none'"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", V.file_name_error("n").alias("e")).collect():
        want = names[r["n"]]
        assert (r["e"] is None) if want is None else want.lower() in r["e"].lower(), r


def test_cleaning_and_dedup(spark):
    df = frame(spark)
    kept = R.clean_messages(df).collect()
    assert {r["row_id"] for r in kept} == {5, 6, 7, 8, 9, 10}
    assert [r["was_cut"] for r in sorted(kept)] == [False, False, False, False, True, False]
    assert R.clean_messages(df, on_long="reject").count() == 5
    s = R.cleaning_summary(df).first()
    assert (s["n_rows"], s["n_dropped"], s["n_cut"]) == (len(CASES), 5, 1)
    many = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    d = R.dedup_first(many.repartition(7))
    assert d.count() == 2001 and d.filter("text = 'hot'").first()["row_id"] == 0


def test_content_profile(spark):
    df = spark.createDataFrame([("a", "spam"), ("a", "x"), (None, None), (None, "ham"), ("b", "1")], "text string, label string")
    p = V.content_profile(df).first()
    assert (p["n_rows"], p["missing_text"], p["missing_label"], p["duplicate_texts"]) == (5, 2, 1, 2)
    assert [tuple(r) for r in V.unexpected_labels(df).collect()] == [("x", 1)]
