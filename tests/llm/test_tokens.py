"""op3, op5 and the codes they use: exact round trips and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from msgspark.llm import huffman, piece_nbest, token_file

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["don't THE!!! ÀÉÿß, naïve. x#$% µª º", "a|b | |c$$$ $$$ ÷ × é.", "a b", "", "  ", None, "x<|endoftext|>y <|startoftext|> z",
       "é ́a", "ΑΣ ΟΔΟΣ. it's we'll 'S", "a　b\x85d\x1cq", "가 ᆨ", "İI ǅ ﬁ", "日本語 123 ½", "\x00 \x01", "word " * 5000]


def test_ids_equal_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in token_file.encode(df, BPE, 2, 49_408).collect():
        want = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u2").tolist() == want


def test_frozen_cache_encodes_alike(monkeypatch):
    import pyarrow as pa

    with open(BPE, encoding="utf-8") as f:
        spec = f.read()
    texts = pa.array(ODD)
    want = token_file.WordEncoder(spec).texts(texts, 2)
    monkeypatch.setattr(token_file, "CACHED_UNITS", 5)
    got = token_file.WordEncoder(spec).texts(texts, 2)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_a_slice_takes_little_memory():
    import pyarrow as pa

    with open(BPE, encoding="utf-8") as f:
        encoder = token_file.WordEncoder(f.read())
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(token_file.SLICE_BYTES // 7))
    encoder.texts(pa.array([text]), 2)
    before = pa.total_allocated_bytes()
    peak = pa.default_memory_pool().max_memory()
    encoder.texts(pa.array([text]), 2)
    assert token_file.SLICE_BYTES <= 1 << 20  # two workers share an executor with its JVM
    assert pa.total_allocated_bytes() <= before + (1 << 20) and peak < 128 << 20


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_file, "IDS_PER_BLOCK", 200)
    rows = [(i * 7 % 41, ODD[i % len(ODD)]) for i in range(41)] + [(None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = token_file.new_path(spark)
    token_file.write_files(df, path, BPE, 2, 49_408)
    got = token_file.digests(spark, path).orderBy("start").collect()
    ids = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in ids]
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(BPE), 0
    for r, (d, t) in zip(got, ids, strict=True):
        if d != 3:
            want = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))
        assert r.start == start
        start += r.n_tokens


def test_no_documents_no_blocks(spark):
    path = token_file.new_path(spark)
    token_file.write_files(spark.createDataFrame([], "doc_id long, text string"), path, BPE, 2, 49_408)
    assert token_file.digests(spark, path).count() == 0


@pytest.mark.parametrize("counts", [[0, 0], [5], [0, 7, 0], [1, 1], [2 ** i for i in range(30)], list(range(300))])
def test_huffman_lengths_and_round_trip(counts):
    counts = np.array(counts, np.int64)
    lengths = huffman.code_lengths(counts, 12)
    used = np.flatnonzero(counts)
    assert (lengths[used] > 0).all() and lengths.max(initial=0) <= 12 and not lengths[counts == 0].any()
    if len(used) > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
    if len(used):
        ids = np.random.default_rng(1).choice(used, 1000)
        for n in (0, 1, 63, 64, 65, 1000):
            block = huffman.encode_block(ids[:n], huffman.canonical_codes(lengths), lengths)
            assert (huffman.Decoder(lengths).ids(block) == ids[:n]).all()


def test_huffman_is_optimal_without_a_limit():
    import heapq

    counts = np.random.default_rng(2).integers(1, 1000, 60)
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    assert int((huffman.code_lengths(counts, 24) * counts).sum()) == total


def brute_scores(p, text, n):
    """Scores of the n best paths by keeping n at every place of the lattice."""
    s = (" " + text).replace(piece_nbest.SPACE, piece_nbest.LITERAL).replace(" ", piece_nbest.SPACE) if text else ""
    best = [[0]]
    for j in range(1, len(s) + 1):
        scores = [x + p.score[s[i:j]][1] for i in range(max(0, j - p.longest), j) if s[i:j] in p.score for x in best[i]]
        if s[j - 1] not in p.score:
            spelt = (piece_nbest.SPACE if s[j - 1] == piece_nbest.LITERAL else s[j - 1]).encode()
            scores += [x + p.byte_score * len(spelt) for x in best[j - 1]]
        best.append(sorted(scores, reverse=True)[:n])
    return [x / piece_nbest.SCALE for x in best[-1]]


def test_n_best_segmentations():
    with open(PIECES, "rb") as f:
        p = piece_nbest.Pieces(f.read(), 4)
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", "word", ".", ",!", "é", "日", "▁", "_", "x_y", "1", "\t", "ß.", '"q"', " | ", ".)", "²", "\x00", "😀", "$_"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        found = next(p.encode([text]))
        assert np.allclose([s for s, _ in found], brute_scores(p, text, 4))
        assert all(p.decode(ids) == text.encode() for _, ids in found)
        assert len({tuple(ids) for _, ids in found}) == len(found)


def test_pieces_query_and_decoding(spark):
    rows = list(enumerate([None, "", "a  b\nc", "x" * 30000, "▁ ▁", "same", "same"]))
    coded = piece_nbest.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES)
    got = {r.doc_id: r for r in coded.collect()}
    assert all(r.restored for r in got.values()) and got[0].scores == [0.0] and got[0].n_pieces == 0
    assert got[5].ids == got[6].ids and sorted(got[2].scores, reverse=True) == got[2].scores
    back = {r.doc_id: r.text for r in piece_nbest.decode(coded, PIECES).collect()}
    assert back == {d: t or "" for d, t in rows}
    assert coded.limit(0).count() == 0
