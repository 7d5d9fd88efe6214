"""Token-id files: ids of all documents in doc_id order, Huffman-coded in independent blocks.

A file set is a Parquet table of blocks (``part``, ``block``, ``n_ids``, doc ids, ids per document and the coded
bits) with the code lengths beside it in a table ``codebook``. Parts follow each other in doc_id order, blocks
within their part. The code comes from the counts of all ids; a block decodes on its own, and
within it every 64th id has a bit offset to start from.

Defined results: a null or empty text has the end id alone. A null doc_id sorts first; repeated rows are written
each. A text of any length stays whole in one block. An empty table gives no blocks and an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .batches import slices, spans
from .huffman import Decoder, canonical_codes, code_lengths, encode_block
from .storage import shared_folder, written

IDS_PER_BLOCK = 1 << 16
SLICE_BYTES = 1 << 20
CACHED_UNITS = 500_000
WORD_AND_TAIL = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,;:!?#$%&*]*)$"
PLAIN = re.compile("[a-zà-öø-ÿ]+|[.,;:!?#$%&*]+")


class WordEncoder:
    """Ids of texts through the tokenizer library; each distinct unit is encoded once while it is held.

    The vocabulary lower-cases, drops white space and never joins across it, nor letters with punctuation. So the units are
    runs between white space, plain words in lower case apart from the punctuation behind them.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.at: dict[str, int] = {"": 0}
        self.kept = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.ids, self.length = self.kept
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(pieces.values()) + 1, bool)
        self.ends_word[[i for piece, i in pieces.items() if piece.endswith("</w>")]] = True

    def _library(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The units in another order, all their ids, and how many each has.

        Plain units are one word of the vocabulary's own splitting each, so all go in one call as a text of
        their own, and the ids with an end-of-word mark tell them apart.
        """
        plain, odd = [], []
        for u in units:
            (plain if PLAIN.fullmatch(u) else odd).append(u)
        found = self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != len(plain):
            odd, plain, ids, ends = units, [], ids[:0], ends[:0]
        single = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        counts = np.r_[np.diff(np.r_[-1, ends]), np.array([len(x) for x in single], np.int64)]
        return plain + odd, np.concatenate([ids, *[np.array(x, np.uint32) for x in single]]), counts

    def units(self, units: list[str]) -> np.ndarray:
        """Places of the units among ``length``. What doesn't fit the cache is held for these units only."""
        self.ids, self.length = self.kept
        new = [u for u in units if u not in self.at]
        if new:
            new, ids, counts = self._library(new)
            places = range(len(self.length), len(self.length) + len(new))
            self.ids, self.length = np.concatenate([self.ids, ids]), np.concatenate([self.length, counts])
            if len(self.at) + len(new) <= CACHED_UNITS:
                self.kept = self.ids, self.length
                self.at.update(zip(new, places, strict=True))
            else:
                held = dict(zip(new, places, strict=True))
                return np.fromiter((self.at[u] if u in self.at else held[u] for u in units), np.int64, len(units))
        return np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))

    def texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end ids, and the number of ids of each text."""
        runs = pc.ascii_split_whitespace(texts.fill_null(""))
        per_text = np.diff(runs.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = runs.flatten().dictionary_encode()
        split = pc.extract_regex(coded.dictionary, WORD_AND_TAIL)
        plain = split.is_valid()
        pair = pa.concat_arrays([
            pc.if_else(plain, pc.utf8_lower(split.field(0)), coded.dictionary),
            pc.if_else(plain, split.field(1), pa.scalar("", coded.dictionary.type))]).dictionary_encode()
        unit = self.units(pair.dictionary.to_pylist())[pair.indices.to_numpy(zero_copy_only=False)]
        unit = unit.reshape(2, -1).T[coded.indices.to_numpy(zero_copy_only=False)].reshape(-1)
        size = self.length[unit]
        before = np.r_[0, np.cumsum(size)]
        ends = before[2 * np.cumsum(per_text)]
        counts = np.diff(np.r_[0, ends]) + 1
        out = np.empty(len(texts) + before[-1], np.uint32)
        stop = np.cumsum(counts) - 1
        out[stop] = end_id
        inner = np.ones(len(out), bool)
        inner[stop] = False
        first = np.cumsum(self.length) - self.length
        out[inner] = self.ids[spans(first[unit], size)]
        return out, counts


_encoders: dict[str, WordEncoder] = {}


def encoder_of(spec: str) -> WordEncoder:
    """One encoder for all tasks of a worker, so that what it holds goes on."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = WordEncoder(spec)
    return _encoders[spec]


def width(n_ids: int) -> str:
    """Little-endian numbers that hold every id of the vocabulary."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer_file: str, end_id: int, n_ids: int, text_col: str = "text",
           id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the ids of each text as numbers of ``width(n_ids)``."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(spec)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                ids, counts = encoder.texts(part.column("text"), end_id)
                ends = np.cumsum(counts)
                data = ids.astype(width(n_ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(
                    [data[b - n: b].tobytes() for b, n in zip(ends, counts, strict=True)], pa.binary())], ["doc_id", "ids"])
            pa.default_memory_pool().release_unused()  # else a worker keeps the most that any batch took

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids binary")


def id_counts(coded: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs in all documents; the driver gets one number per vocabulary entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_ids, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                counts += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), width(n_ids)), minlength=n_ids)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["id", "n"])

    total = np.zeros(n_ids, np.int64)
    for r in coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r.id] = r.n
    return total


BLOCKS = "part int, block int, n_ids long, doc_ids binary, null_ids binary, sizes binary, bits binary"


def write_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, n_ids: int, max_bits: int = 18) -> None:
    """Encode ``docs`` and write the file set to ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    coded = written(encode(docs, tokenizer_file, end_id, n_ids), "ids")
    lengths = code_lengths(id_counts(coded, n_ids), max_bits)
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            docs, texts = [d for d, _ in held], [np.frombuffer(x, width(n_ids)) for _, x in held]
            ids = np.concatenate(texts)
            row = {"part": part, "block": block, "n_ids": len(ids),
                   "doc_ids": np.array([d or 0 for d in docs], "<i8").tobytes(),
                   "null_ids": np.packbits([d is None for d in docs]).tobytes(),
                   "sizes": np.array([len(t) for t in texts], "<u4").tobytes(), "bits": encode_block(ids, codes, lengths)}
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                held.append((d, x.as_py()))
                n += len(held[-1][1]) // np.dtype(width(n_ids)).itemsize
                if n >= IDS_PER_BLOCK:
                    yield flush()
                    block, n = block + 1, 0
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()),
                        ("null_ids", pa.binary()), ("sizes", pa.binary()), ("bits", pa.binary())])
    coded.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, BLOCKS).write.option(
        "compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, first, doc_id, ids) of every document; ``first``: ids before it in its block."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first().lengths, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for row in (r for one in range(batch.num_rows) for r in batch.slice(one, 1).to_pylist()):
                ids = decoder.ids(row["bits"]).astype("<u4")
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                n, ends = len(sizes), np.cumsum(sizes)
                null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8))[:n].astype(bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["block"], np.int32)),
                    pa.array(ends - sizes), pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null),
                    pa.array([ids[b - k: b].tobytes() for b, k in zip(ends, sizes, strict=True)], pa.binary())],
                    ["part", "block", "first", "doc_id", "ids"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(
        run, "part int, block int, first long, doc_id long, ids binary")


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, base): ids of the whole file set before each block. One total per part meets in one task."""
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_ids")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_base"))
    inner = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("block"))), F.lit(0))
    return blocks.withColumn("inner", inner).join(parts, "part").select(
        "part", "block", (F.col("part_base") + F.col("inner")).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start, n_tokens and the checksum of its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([
                b.column("part"), b.column("block"), b.column("first"), b.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                ["part", "block", "first", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_files(spark, path).mapInArrow(
        run, "part int, block int, first long, doc_id long, n_tokens long, ids_crc32 long")
    return rows.join(block_starts(spark, path), ["part", "block"]).select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
