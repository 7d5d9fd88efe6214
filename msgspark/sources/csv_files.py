"""CSV files of messages: profiling and loading many files per job."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import strip
from ..operators.ranking import global_rank
from ..operators.rows import clean_labelled
from ..operators.validate import file_head_error, file_name_error, validate_messages
from ..session import cut_lineage
from . import headers as H, quoted_csv

HEAD_RECORDS = 11       # header and the ten rows that are looked at
HEAD_BYTES = 16 << 20   # within which they have to end; a file with a longer head is failed
FIRST_BYTES = 1024      # of an upload that are looked at before it is taken


def list_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, length, modified) of files; their content is not read.

    Scans skip files of length 0, so those are added from the list of names.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(paths)
    filled = found.select(F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified"))
    # local paths are written file:/x by scans and file:///x by the name list
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    names = spark.createDataFrame([(n,) for n in found.inputFiles()], "path string").withColumn("_k", same("path"))
    empty = names.join(filled.select(same("path").alias("_k")), "_k", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modified"))
    return filled.unionByName(empty)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of some candidate paths that exists on its file system."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


@F.udf(returnType=ArrayType(ArrayType(StringType())), useArrow=True)
def _records(records):
    """Fields of some records, each as ``csv.reader`` gives them."""
    import csv
    import sys

    if records is None:
        return None
    csv.field_size_limit(sys.maxsize)
    out = []
    for record in records:
        try:
            out.append(next(csv.reader([record]), []))
        except csv.Error:
            out.append(record.split(","))
    return out


def _cut_heads(limit: int):
    """(path, head, open, size, first_kb) of each file from its first split: HEAD_RECORDS records, or those that begin within
    ``limit`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held, begins, inside, size, kb = None, [], [], False, 0, []

        def done() -> bool:
            return sum(begins) - inside >= HEAD_RECORDS or size > limit

        def row() -> pa.RecordBatch:
            at = [i for i, x in enumerate(begins) if x]
            whole = [b"\n".join(held[i:j]) for i, j in zip(at, [*at[1:], len(held)], strict=True)][:HEAD_RECORDS]
            cut = inside and len(at) <= HEAD_RECORDS
            return pa.RecordBatch.from_arrays([
                pa.array([path]), pa.array([whole], pa.list_(pa.binary())), pa.array([cut]), pa.array([size], pa.int64()),
                pa.array([b"\n".join(kb)[:FIRST_BYTES]], pa.binary())], ["path", "head", "open", "size", "first_kb"])

        for batch in batches:
            for own, _, lines in quoted_csv.stretches(batch):
                if own != path:
                    if path is not None:
                        yield row()
                    path, held, begins, inside, size, kb = own, [], [], False, 0, []
                for a in range(0, len(lines), HEAD_RECORDS):
                    if done():
                        break
                    for line in lines.slice(a, HEAD_RECORDS).to_pylist():
                        if done():
                            break
                        if sum(map(len, kb)) < FIRST_BYTES:
                            kb.append(line[:FIRST_BYTES])
                        held.append(line)
                        begins.append(not inside)
                        inside = quoted_csv.ends_inside(line, inside)
                        size += len(line) + 1
        if path is not None:
            yield row()
    return run


def file_heads(spark: SparkSession, paths: str | list[str], head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(path, length, modified, detected_encoding, records, first_kb, head_error): the parsed head of every file.

    The head is the first HEAD_RECORDS records, whatever number of lines they have, from the file's first split. If they do not end
    within ``head_bytes``, ``records`` is null and ``head_error`` says so. The encoding comes from every line, as a byte
    that is not UTF-8 may come anywhere; partial sums leave one row a file and task.
    """
    lines = quoted_csv.lines_of(spark, paths)
    encoding = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("utf8"))
    found = lines.filter("block = 0").mapInArrow(
        _cut_heads(head_bytes), "path string, head array<binary>, open boolean, size long, first_kb binary").join(encoding, "path")
    files = list_files(spark, paths).join(found.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"), "left").drop("_path")
    # a record that goes on in the next split is left out of the head, unless it is the only one
    whole = F.when(F.col("open") & (F.col("length") > F.col("size")) & (F.size("head") > 1),
                   F.slice("head", F.lit(1), F.size("head") - 1)).otherwise(F.col("head"))
    text = F.transform(whole, lambda x: F.when(F.col("utf8"), F.make_valid_utf8(x.cast("string"))).otherwise(F.decode(x, "ISO-8859-1")))
    text = F.transform(text, lambda s, i: F.regexp_replace(F.when(i == 0, H.strip_bom(s)).otherwise(s), "\\r\\z", ""))
    error = F.when(F.col("size") > head_bytes, F.format_string(
        f"The first {HEAD_RECORDS} records do not end within %d bytes", F.lit(head_bytes)))
    return files.withColumn("head_error", error).select(
        "path", "length", "modified", F.when(F.coalesce("utf8", F.lit(True)), "utf-8").otherwise("latin-1").alias("detected_encoding"),
        F.when(F.col("head_error").isNull(), _records(text)).alias("records"), "first_kb", "head_error")


def profile_files(spark: SparkSession, paths: str | list[str], head_bytes: int = HEAD_BYTES) -> DataFrame:
    """One row per file: format, chosen columns and their positions, checks and advice."""
    heads = file_heads(spark, paths, head_bytes).withColumns({
        "first_record": F.get(F.col("records"), F.lit(0)), "second_record": F.get(F.col("records"), F.lit(1))})
    p = H.add_profile(heads)
    rows = F.when(F.col("has_header"), F.slice("records", 2, 10)).otherwise(F.slice("records", 1, 10))
    p = p.withColumn("data_rows", F.coalesce(rows, F.expr("cast(array() as array<array<string>>)")))
    fe, fw = H.file_messages(F.col("path"), F.col("length"))
    me, mw = H.format_messages()
    se, sw = H.structure(F.coalesce("first_record", F.expr("cast(array() as array<string>)")), F.col("data_rows"),
                         F.col("column_count"), F.col("text_pos"), F.col("has_header"))
    empty = F.col("length") == 0
    none = F.expr("cast(array() as array<string>)")
    return p.withColumns({
        "errors": F.concat(fe, F.when(empty, none).when(F.col("head_error").isNotNull(), F.array("head_error")).otherwise(F.concat(me, se))),
        "warnings": F.concat(fw, F.when(empty, none).otherwise(F.concat(mw, sw))),
        "suggestion": H.suggestions(), "batch_use": H.batch_suitability(),
    }).withColumn("is_valid", F.size("errors") == 0).select(
        "path", "length", "modified", "email_column", "label_column", "column_count", "has_header", "detected_encoding",
        "format_type", "confidence_score", "text_pos", "label_pos", F.col("first_record").alias("columns"),
        F.slice("data_rows", 1, 5).alias("sample_rows"), "is_valid", "errors", "warnings", "suggestion", "batch_use", "head_error")


def _rejected(profile: DataFrame, min_confidence: float) -> DataFrame:
    low = F.format_string("Could not determine CSV format (confidence %.2f)", F.col("confidence_score").cast("double"))
    reason = F.when(F.col("length") == 0, "File is empty").when(F.col("head_error").isNotNull(), F.col("head_error")).when(
        F.coalesce(F.col("format_type"), F.lit("unknown")) == "unknown", "Could not determine CSV format").when(
        F.coalesce(F.col("confidence_score"), F.lit(0.0)) < min_confidence, low)
    return profile.withColumn("reason", reason)


def rejected_files(spark: SparkSession, paths: str | list[str], *, min_confidence: float = 0.5,
                   profile: DataFrame | None = None) -> DataFrame:
    """(path, format_type, confidence_score, reason) of the files that ``read_messages`` leaves out."""
    profile = profile_files(spark, paths) if profile is None else profile
    return _rejected(profile, min_confidence).filter("reason is not null").select("path", "format_type", "confidence_score", "reason")


def _layout(profile: DataFrame, text_col: str | None, min_confidence: float) -> DataFrame:
    """(path, has_header, detected_encoding, column_count, text_pos, label_pos, columns) of the usable files."""
    usable = _rejected(profile, min_confidence).filter("reason is null")
    if text_col is not None:
        # the name as it is, else in any case, else as a part of a name
        wanted, names = text_col.strip().lower(), F.transform("columns", lambda c: F.lower(F.trim(c)))
        place = lambda found: F.nullif(found, F.lit(0)).cast("int") - 1
        part = F.array_position(F.transform(names, lambda c: F.contains(c, F.lit(wanted))), True)
        usable = usable.withColumn("text_pos", F.coalesce(
            place(F.array_position("columns", text_col)), place(F.array_position(names, wanted)), place(part), F.col("text_pos")))
    return usable.select("path", "has_header", "detected_encoding", "column_count", "text_pos", "label_pos", "columns")


def _located(spark: SparkSession, paths, layout: DataFrame, width: int, multi_line: bool, empty: str = "") -> DataFrame:
    """Rows of the usable files with their layout: (path, position, fields, ...). ``empty`` marks an empty field's text, so
    that only a missing field is null."""
    names = [f"c{i}" for i in range(width)]
    if multi_line:
        found = quoted_csv.records(spark, paths)
    else:  # the caller knows that no field holds a line end
        lines = quoted_csv.lines_of(spark, paths).select(
            "path", F.monotonically_increasing_id().alias("position"), (F.col("block") == 0).alias("_0"), F.col("value").alias("record"))
        begin = lines.filter("_0").groupBy(F.col("path").alias("_p")).agg(F.min("position").alias("_f"))
        found = lines.join(begin, F.col("path") == F.col("_p"), "left").select(
            "path", "position", (F.col("position") == F.col("_f")).alias("first"), "record").filter(
            ~F.col("record").isin(F.lit(b""), F.lit(b"\r")))
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"} | ({"nullValue": empty} if empty else {})
    parsed = F.from_csv(quoted_csv.record_text(F.col("detected_encoding")), ", ".join(f"{c} STRING" for c in names), options)
    rows = found.join(layout, "path").filter("not (first and has_header)").withColumn("_r", parsed)
    return rows.withColumn("fields", F.array(*[f"_r.{c}" for c in names])).drop("_r", "record", "first")


def read_messages(spark: SparkSession, paths: str | list[str], *, text_col: str | None = None,
                  min_confidence: float = 0.5, multi_line: bool = True, profile: DataFrame | None = None) -> DataFrame:
    """(path, _seq, text, label) of every usable file, whatever its layout.

    Records of all files are cut in one pass, in splits, and meet their file's layout by path; no list of files is collected.
    ``_seq`` is in row order within a file. ``text_col`` overrides the detected column by name. ``profile`` takes
    the rows of ``profile_files`` if they are there already; ``rejected_files`` tells which files are left out.
    """
    layout = _layout(cut_lineage(profile_files(spark, paths)) if profile is None else profile, text_col, min_confidence)
    width = layout.agg(F.max(F.greatest("text_pos", "label_pos"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "path string, _seq bigint, text string, label string")
    rows = _located(spark, paths, layout, width + 1, multi_line)
    return rows.select("path", F.col("position").alias("_seq"), F.get("fields", F.col("text_pos")).alias("text"),
                       F.get("fields", F.col("label_pos")).alias("label")).filter("text IS NOT NULL")


def read_flexible(spark: SparkSession, paths: str | list[str], *, min_confidence: float = 0.5,
                  profile: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, _seq, text, label, problem), one report row a file): the load that forgives.

    A file with a row wider than its first one is read by hand: texts are stripped, blank ones left out, and rows without
    the text column stay with their ``problem``. Other files give every text that is there. The report has the columns left after blank
    names (or, without a header, all-empty columns) are removed and repeated names numbered, how many were removed or renamed, the
    rows read and too short, the mode, and the ``error`` of a file that gave nothing.
    """
    profile = cut_lineage(profile_files(spark, paths)) if profile is None else profile
    layout = _layout(profile, None, min_confidence).select("*", (F.size("columns")).alias("width"))
    width = layout.agg(F.max("width")).first()[0] or 1
    rows = cut_lineage(_located(spark, paths, layout, width + 1, True, empty="\0"))
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    n_fields = F.size(F.filter("fields", lambda c: c.isNotNull()))
    rows = rows.withColumn("n", n_fields).filter(F.exists("fields", lambda c: ~blank(c)))
    filled = F.array(*[F.bool_or(~blank(F.get("fields", F.lit(i)))) for i in range(width)])
    stats = rows.groupBy("path").agg(F.bool_or(F.col("n") > F.col("width")).alias("by_hand"), filled.alias("filled"))
    text = F.get("fields", F.col("text_pos"))
    stripped = F.nullif(strip(text), F.lit(""))
    short = F.col("by_hand") & (F.col("n") <= F.col("text_pos"))
    read = rows.join(stats, "path").withColumns({
        "problem": F.when(short, "Not enough columns, skipping"),
        "text": F.when(F.col("by_hand"), stripped).otherwise(F.nullif(text, F.lit(""))),
        "label": F.nullif(F.get("fields", F.col("label_pos")), F.lit(""))})
    read = read.filter("text is not null or problem is not null").select("path", F.col("position").alias("_seq"), "text", "label", "problem")
    counts = read.groupBy("path").agg(F.count("text").alias("n_rows"), F.count("problem").alias("n_short"))
    names = F.when(F.col("has_header"), F.filter("columns", lambda c: ~blank(c))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("filled", i), F.lit(False))),
                    lambda i: i.cast("string")))
    renamed = F.when(F.col("has_header"), H.unique_names(F.col("names"))).otherwise(F.col("names"))
    lost = ~F.col("has_header") & ~F.coalesce(F.get("filled", F.col("text_pos")), F.lit(False))
    report = layout.join(stats, "path", "left").join(counts, "path", "left").withColumn("names", names).select(
        "path", renamed.alias("columns"), (F.col("width") - F.size("names")).alias("n_removed"),
        F.size(F.array_except(renamed, F.col("names"))).alias("n_renamed"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_short", F.lit(0)).alias("n_short"), F.when(F.coalesce("by_hand", F.lit(False)), "manual").otherwise("plain").alias("mode"),
        F.when(lost, F.concat(F.lit("Column '"), F.col("text_pos").cast("string"), F.lit("' not found in CSV"))).when(
            F.coalesce("n_rows", F.lit(0)) == 0, "No valid email content found in CSV file").alias("error"))
    left_out = _rejected(profile, min_confidence).filter("reason is not null").select("path", F.col("reason").alias("error"))
    return read, report.unionByName(left_out, allowMissingColumns=True)


def upload_check(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, error): why a file is not taken, by its name and its first FIRST_BYTES bytes; null if it is."""
    heads = file_heads(spark, paths).withColumn("name", F.element_at(F.split("path", "/"), -1))
    start = F.make_valid_utf8(F.col("first_kb").cast("string"))
    first = F.when(F.col("head_error").isNull(), F.coalesce(F.get("records", F.lit(0)), F.array().cast("array<string>")))
    return heads.select("path", F.coalesce(file_name_error("name"), file_head_error("name", start, first)).alias("error"))


def number_messages(df: DataFrame) -> DataFrame:
    """Add the 1-based ``email_index`` within each file, in row order."""
    return global_rank(df, order_by=["_seq"], partition_by=["path"], name="_i").withColumn(
        "email_index", F.col("_i") + 1).drop("_i", "_seq")


def read_ragged(spark: SparkSession, paths: str | list[str], *, text_pos: int = 0, header: bool = True,
                encoding: str = "UTF-8") -> DataFrame:
    """Rows of any width: (path, _seq, fields, text, problem); quoted fields may span lines.

    Blank rows are dropped; rows too short for the text column carry a ``problem``.
    """
    found = quoted_csv.records(spark, paths)
    if header:
        found = found.filter("not first")
    lines = found.select("path", F.col("position").alias("_seq"), quoted_csv.record_text(encoding).alias("value"))
    return ragged_fields(lines, text_pos=text_pos).select("path", "_seq", "fields", "text", "problem")


def line_fields(line: str) -> list[str]:
    """Fields of one line as ``csv.reader`` gives them: a quote counts where a field starts, and may stay open."""
    fields, i = [], 0
    while True:
        part = []
        if line.startswith('"', i):
            i += 1
            while True:
                j = line.find('"', i)
                part.append(line[i:] if j < 0 else line[i:j])
                i = len(line) if j < 0 else j + 1
                if not line.startswith('"', i):
                    break
                part.append('"')
                i += 1
        j = line.find(",", i)
        fields.append("".join(part) + (line[i:] if j < 0 else line[i:j]))
        if j < 0:
            return fields
        i = j + 1


@F.udf(returnType=ArrayType(StringType()), useArrow=True)
def _quoted_fields(line):
    return None if line is None else line_fields(line)


def ragged_fields(lines: DataFrame, *, value: str = "value", text_pos: int = 0) -> DataFrame:
    """Split raw CSV lines into ``fields`` and pick ``text``; blank rows are dropped."""
    quoted = F.contains(value, F.lit('"'))
    fields = F.when(quoted, _quoted_fields(F.when(quoted, F.col(value)))).otherwise(F.split(value, ","))
    out = lines.withColumn("fields", fields).filter(F.exists("fields", lambda c: strip(c) != ""))
    short = F.size("fields") <= text_pos
    text = F.nullif(strip(F.get("fields", F.lit(text_pos))), F.lit(""))
    return out.withColumn("text", text).withColumn("problem", F.when(short, "Not enough columns, skipping"))


def read_labelled(spark: SparkSession, paths: str | list[str], *, text: str = "text", label: str = "label",
                  encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """Strict labelled load: required header, nulls dropped, first of equal texts, labels normalised.

    Files have to share one header, which is read without scanning the data. First means
    the lowest position in the file with the lowest path. Files are read in splits, quoted line ends included;
    ``multi_line=False`` saves the pass over the quotes for files known to have none of these.
    """
    reader = (spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
              .option("encoding", encoding))
    df = reader.csv(paths)
    missing = [c for c in (text, label) if c not in df.columns]
    if missing:
        raise ValueError("; ".join(f"Required column '{c}' not found in CSV" for c in missing))
    if multi_line:  # only the header is read by the multi-line reader, which does not split files
        at = {c: F.get("fields", F.lit(df.columns.index(c))) for c in (text, label)}
        rows = quoted_csv.rows(spark, paths, 1 + max(map(df.columns.index, (text, label))), header=True, encoding=encoding).select(
            F.struct("path", F.col("position").alias("seq")).alias("position"), at[text].alias("text"), at[label].alias("label"))
    else:
        rows = df.select(F.struct(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("seq"))
                         .alias("position"), F.col(text).alias("text"), F.col(label).alias("label"))
    return clean_labelled(rows, row_id="position").select("position.path", "position.seq", "text", "label")


def read_batch(spark: SparkSession, paths: str | list[str], **kw) -> DataFrame:
    """Strict batch load: the valid messages of ``read_labelled``."""
    return validate_messages(read_labelled(spark, paths, **kw)).filter("is_valid").select("path", "seq", "text")


def read_v1v2(spark: SparkSession, paths: str | list[str], *, multi_line: bool = True) -> DataFrame:
    """Training files with columns v1 (label) and v2 (text) in ISO-8859-1."""
    df = (spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
          .option("encoding", "ISO-8859-1").csv(paths))
    if multi_line:
        at = {c: df.columns.index(c) for c in ("v1", "v2")}
        rows = quoted_csv.rows(spark, paths, 1 + max(at.values()), header=True, encoding="ISO-8859-1")
        df = rows.select(*[F.get("fields", F.lit(i)).alias(c) for c, i in at.items()])
    return df.select(F.lower("v1").alias("label"), F.col("v2").alias("text")).dropna(subset=["label", "text"])
