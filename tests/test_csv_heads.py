"""Heads of complete records, the forgiving load and its report, uploads."""

import pytest

from msgspark.sources import csv_files

LONG = "this is a long enough message text"


def named(rows):
    return {r["path"].rsplit("/", 1)[1]: r for r in rows}


def test_a_first_message_of_many_quoted_lines_keeps_the_labels(spark, tmp_path):
    first = "\n".join(f"quoted line {i} of a very long first letter" for i in range(82))
    rows = [(first, "ham"), *((f"{LONG} {i}", "spam") for i in range(20))]
    (tmp_path / "m.csv").write_text("".join(f'"{t}",{y}\n' for t, y in rows))
    profile = csv_files.profile_files(spark, str(tmp_path)).first()
    assert (profile.column_count, profile.has_header, profile.label_pos, len(profile.sample_rows)) == (2, False, 1, 5)
    got = csv_files.read_messages(spark, str(tmp_path)).orderBy("_seq").collect()
    assert [(r.text, r.label) for r in got] == rows


def test_a_head_over_the_bound_is_a_failed_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text('text,label\n"' + "line\n" * 2000 + '",spam\n')
    (tmp_path / "ok.csv").write_text(f"text,label\n{LONG},spam\n")
    profile = csv_files.profile_files(spark, str(tmp_path), head_bytes=5000).cache()
    big = named(profile.collect())["big.csv"]
    assert not big.is_valid and big.errors == ["The first 11 records do not end within 5000 bytes"]
    left = csv_files.rejected_files(spark, str(tmp_path), profile=profile).collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in left] == [("big.csv", "The first 11 records do not end within 5000 bytes")]
    assert [r.text for r in csv_files.read_messages(spark, str(tmp_path), profile=profile).collect()] == [LONG]


def test_flexible_load_and_report(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("plain.csv", f'id,message, ,is_spam\n1,"{LONG}\nsecond",x,1\n2,,x,0\n3,  ,x,0\n')
    write("wide.csv", f'label,text\nham, {LONG} \nspam\nspam,"{LONG}, b",extra\nham,  \n\n')
    write("dups.csv", f"text,text,label,text\n{LONG},b,spam,c\n")
    write("bare.csv", f"{LONG} and more of it for length,,0\n{LONG} c,,1\n")
    write("lost.csv", f",{LONG} and more of it for length\n,{LONG} two\n")
    write("empty.csv", "")
    rows, report = csv_files.read_flexible(spark, str(tmp_path))
    by = {}
    for r in rows.orderBy("path", "_seq").collect():
        by.setdefault(r.path.rsplit("/", 1)[1], []).append((r.text, r.label, r.problem))
    short = "Not enough columns, skipping"
    assert by == {
        "plain.csv": [(f"{LONG}\nsecond", "1", None), ("  ", "0", None)],
        "wide.csv": [(LONG, "ham", None), (None, "spam", short), (f"{LONG}, b", "spam", None)],
        "dups.csv": [(LONG, "spam", None)],
        "bare.csv": [(f"{LONG} and more of it for length", None, None), (f"{LONG} c", None, None)]}
    r = {k: (v["columns"], v.n_removed, v.n_renamed, v.n_rows, v.n_short, v["mode"], v.error) for k, v in named(report.collect()).items()}
    assert r["plain.csv"] == (["id", "message", "is_spam"], 1, 0, 2, 0, "plain", None)
    assert r["wide.csv"] == (["label", "text"], 0, 0, 2, 1, "manual", None)
    assert r["dups.csv"] == (["text", "text_1", "label", "text_2"], 0, 2, 1, 0, "plain", None)
    assert r["bare.csv"] == (["0", "2"], 1, 0, 2, 0, "plain", None)
    assert r["lost.csv"][-1] == "Column '0' not found in CSV" and r["lost.csv"][0] == ["1"]
    assert r["empty.csv"][-1] == "File is empty"


def test_uploads(spark, tmp_path):
    write = lambda name, data: (tmp_path / name).write_bytes(data)
    write("good.csv", f"text\n{LONG}\n".encode())
    write("blank.csv", b" ,,\t\ntext\n")
    write("white.csv", b"  \n \n")
    write("none.csv", b"")
    write("notes.txt", b"  ")
    write("data.json", b"{}")
    write("latin.csv", "text\ncaf\xe9 is where this was written\n".encode("latin-1"))
    got = {k: v.error for k, v in named(csv_files.upload_check(spark, str(tmp_path)).collect()).items()}
    empty = "The CSV file appears to be empty. Please upload a file with email data."
    assert {k: got[k] for k in ("good.csv", "notes.txt", "latin.csv", "white.csv", "none.csv")} == {
        "good.csv": None, "notes.txt": None, "latin.csv": None, "white.csv": empty, "none.csv": empty}
    assert got["blank.csv"].startswith("The CSV file has no valid data in the first row") and "Invalid file format 'json'" in got["data.json"]


@pytest.mark.parametrize("multi_line", [True, False])
def test_messages_alike_with_and_without_the_quote_pass(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("text,label\n" + "".join(f'"{LONG}, {i}",{i % 2}\n' for i in range(30)))
    (tmp_path / "b.csv").write_bytes("".join(f"{LONG} caf\xe9 and some more words {i},x{i}\r\n" for i in range(30)).encode("latin-1"))
    got = csv_files.number_messages(csv_files.read_messages(spark, str(tmp_path), multi_line=multi_line)).collect()
    assert sorted((r.path[-5:], r.email_index, r.text, r.label) for r in got) == sorted(
        [("a.csv", i + 1, f"{LONG}, {i}", str(i % 2)) for i in range(30)] +
        [("b.csv", i + 1, f"{LONG} caf\xe9 and some more words {i}", f"x{i}") for i in range(30)])


def test_ragged_rows_may_span_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n1,"two\nlines"\n3\n"x\ny",z,more\n')
    rows = csv_files.read_ragged(spark, str(tmp_path), text_pos=1).orderBy("_seq").collect()
    assert [(r["fields"], r.text, r.problem) for r in rows] == [
        (["1", "two\nlines"], "two\nlines", None), (["3"], None, "Not enough columns, skipping"), (["x\ny", "z", "more"], "z", None)]
