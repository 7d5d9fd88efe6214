"""SentencePiece encoding and decoding: the n best segmentations of each text into the pieces of a model file.

A piece's score is its log probability by Zipf's law at its place in the model's merge order; a character without a piece is
spelt in byte pieces, whose scores lie below all others. A text's segmentations are the paths of the lattice of its pieces.
A forward Viterbi pass gives the best score of every prefix; a backward A* search from the end, with those scores as
its heuristic, then completes paths in exact order of their scores. The forward pass also tells what the second best path of a
unit loses, so the search runs only for units that a text's n best segmentations can change.

No piece of the model spans white space from the left, a line break, or a plain letter next to plain punctuation (checked when
the model is read). The lattice falls apart there, so those units are searched once each while they are held, and
the n best of a text are combined from the n best of its units: only the n - 1 units that lose least can change.

Texts are taken as they are: a space becomes U+2581, one stands before the text, and a U+2581 of the text itself is spelt in
bytes, so decoding gives back every text exactly.

Defined results: a null or empty text has no pieces, one segmentation, and score 0; texts with fewer segmentations than n have
that many. Equal scores go by the earlier choice in the text. Repeated rows get equal results. Other columns are not
read. Empty in, empty out.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import slices, spans

SPACE, LITERAL = "▁", "\U0010fffe"  # the mark of a space; stands for a U+2581 of the text
LETTER, POINT = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?|#$%&*"
UNITS = re.compile(rf" *[{LETTER}]+(?=[ \n{POINT}]|$)| *[{POINT}]+(?=[ \n{LETTER}]|$)|\n| *[^ \n]+| +")
COARSE = re.compile(r"\n| *[^ \n]+| +")
CACHED_UNITS = 400_000
SLICE_BYTES = 2 << 20
SCALE = 1 << 20  # scores are whole numbers of 2^-20, so that sums and ties are exact
NEVER = 1 << 62  # the loss of a unit without another segmentation


class Pieces:
    """The lattice search over one model's pieces."""

    def __init__(self, model: bytes, n: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        self.n, self.spelling = n, {}
        names = [sp.id_to_piece(i) for i in range(size)]
        zipf = log(sum(1 / (r + 2.7) for r in range(size)))
        self.score: dict[str, tuple[int, int]] = {}
        self.raw = [b""] * size
        rank = 0
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.raw[i] = bytes([int(name[3:5], 16)])
                self.spelling[self.raw[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = name.replace(SPACE, " ").encode()
                self.score[name] = (i, -round(SCALE * (log(rank + 2.7) + zipf)))
                rank += 1
        self.byte_score = -round(SCALE * (log(size + 2.7) + zipf))
        self.longest = max(map(len, self.score))
        # every beginning of a piece, with the piece's ids and score if it is one itself
        self.begins: dict[str, tuple | None] = {name[:k]: None for name in self.score for k in range(1, len(name))}
        self.begins |= {name: ((i,), score) for name, (i, score) in self.score.items()}
        bare = [name.replace(SPACE, "") for name in self.score]
        near = re.compile(rf"[{LETTER}][{POINT}]|[{POINT}][{LETTER}]")
        self.units_of = (COARSE if any(map(near.search, bare)) else UNITS).findall
        if any(SPACE in name.lstrip(SPACE) or "\n" in name for name in self.score):
            raise ValueError("pieces of this model span white space")
        self.lengths = np.array([len(r) for r in self.raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        # the units held: places of their best ids, and the loss of their second best segmentation
        self.at: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.loss: list[int] = []
        self.best: list[int] = []

    def spelt(self, char: str) -> tuple[tuple[int, ...], int]:
        ids = tuple(self.spelling[b] for b in (SPACE if char == LITERAL else char).encode())
        return ids, self.byte_score * len(ids)

    def forward(self, unit: str) -> tuple[list[int], int, int]:
        """Ids and score of a best segmentation, and the loss of the best other one.

        The second best path has an edge off the best one; the best score through an edge is the best before it, its
        own, and the best after it.
        """
        s = unit.replace(SPACE, LITERAL).replace(" ", SPACE)
        look, size, edges = self.begins.get, len(s), []
        best, came = [0] + [-NEVER] * size, [None] * (size + 1)
        for i in range(size):
            here, j = best[i], i + 1
            if s[i] not in self.score:
                edges.append((i, j, self.spelt(s[i])))
                if here + edges[-1][2][1] > best[j]:
                    best[j], came[j] = here + edges[-1][2][1], edges[-1]
            while j <= size:
                found = look(s[i:j], 0)
                if found == 0:
                    break
                if found is not None:
                    edge = (i, j, found)
                    edges.append(edge)
                    if here + found[1] > best[j]:
                        best[j], came[j] = here + found[1], edge
                j += 1
        after, second, path, j = [-NEVER] * size + [0], -NEVER, [], size
        while j:
            path.append(came[j])
            j = came[j][0]
        on_path = set(map(id, path))
        for edge in reversed(edges):
            i, j, (_, score) = edge
            rest = score + after[j]
            if rest > after[i]:
                after[i] = rest
            if best[i] + rest > second and id(edge) not in on_path:
                second = best[i] + rest
        ids = [x for edge in reversed(path) for x in edge[2][0]]
        return ids, best[size], best[size] - second if second > -NEVER else NEVER

    def others(self, unit: str, ids: list[int], best: int) -> list[tuple[int, list[int]]]:
        """The n - 1 best segmentations besides ``ids``, with their losses."""
        found = [(best - score, own) for score, own in self.segment(unit, self.n) if own != ids]
        return found[: self.n - 1]

    def segment(self, unit: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a unit, best first."""
        s = unit.replace(SPACE, LITERAL).replace(" ", SPACE)
        get, longest, size = self.score.get, self.longest, len(s)
        best, edges = [0] + [-NEVER] * size, [()] * (size + 1)
        for j in range(1, size + 1):
            own, top = [], -NEVER
            for i in range(max(0, j - longest), j):
                found = get(s[i:j])
                if found is not None:
                    own.append((i, found[1], (found[0],)))
                    top = max(top, best[i] + found[1])
            if s[j - 1] not in self.score:
                spelt, score = self.spelt(s[j - 1])
                own.append((j - 1, score, spelt))
                top = max(top, best[j - 1] + own[-1][1])
            best[j], edges[j] = top, own
        # among equal scores the path nearest to its end goes first, or ties would grow without end
        queue, found, ties = [(-best[size], size, 0, 0, None)], [], 1
        while queue and len(found) < n:
            _, j, _, behind, path = heapq.heappop(queue)
            if not j:
                ids = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                found.append((behind, ids))
                continue
            for i, score, own in edges[j]:
                heapq.heappush(queue, (-(behind + score + best[i]), i, ties, behind + score, (own, path)))
                ties += 1
        return found

    def places(self, units: list[str]) -> np.ndarray:
        if len(self.at) > CACHED_UNITS:  # what came first stays: it is what comes most
            for u in list(self.at)[CACHED_UNITS:]:
                del self.at[u]
            for held in (self.ids, self.loss, self.best):
                del held[CACHED_UNITS:]
        out = np.empty(len(units), np.int64)
        for k, u in enumerate(units):
            p = self.at.get(u)
            if p is None:
                p = self.at[u] = len(self.ids)
                ids, best, loss = self.forward(u)
                self.ids.append(np.array(ids, "<u4").tobytes())
                self.best.append(best)
                self.loss.append(loss)
            out[k] = p
        return out

    def variants(self, losses: list[list[int]]) -> list[tuple[int, tuple]]:
        """The n least total losses over texts' units, and the choice each makes: ((unit, segmentation), ...)."""
        first = sorted((x[0], k) for k, x in enumerate(losses) if x)[: self.n - 1]
        kept: list[tuple[int, tuple]] = [(0, ())]
        for k in sorted(k for _, k in first):
            more = [(a + b, c + ((k, m + 1),)) for a, c in kept for m, b in enumerate(losses[k])]
            kept = sorted(kept + more)[: self.n]
        return kept

    def encode(self, texts: list[str]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """The n best (score, ids) of each text."""
        split = [self.units_of(" " + t) if t else [] for t in texts]
        distinct = list(dict.fromkeys(u for units in split for u in units))
        place = dict(zip(distinct, self.places(distinct).tolist(), strict=True))
        used = sorted(set(place.values()))
        local = {p: k for k, p in enumerate(used)}
        flat = np.frombuffer(b"".join(self.ids[p] for p in used), "<u4").astype(np.int64)
        count = np.array([len(self.ids[p]) // 4 for p in used], np.int64)
        start = np.cumsum(count) - count
        least = np.array([self.loss[p] for p in used], np.int64)
        score = np.array([self.best[p] for p in used], np.int64)
        place = {u: local[p] for u, p in place.items()}
        others: dict[int, list] = {}
        for units in split:
            own = np.fromiter(map(place.__getitem__, units), np.int64, len(units))
            total = int(score[own].sum()) if len(own) else 0
            ids = flat[spans(start[own], count[own])] if len(own) else np.zeros(0, np.int64)
            loss = least[own] if len(own) else least[:0]
            if len(loss) >= self.n:
                some = np.flatnonzero(loss <= np.partition(loss, self.n - 2)[self.n - 2])
            else:
                some = np.arange(len(loss))
            some = some[np.argsort(loss[some], kind="stable")][: self.n - 1]
            some = np.sort(some[loss[some] < NEVER])
            found, before = [], np.r_[0, np.cumsum(count[own])] if len(own) else np.zeros(1, np.int64)
            for k in some:
                if own[k] not in others:
                    p = used[own[k]]
                    others[own[k]] = self.others(units[k], np.frombuffer(self.ids[p], "<u4").tolist(), self.best[p])
            changes = [others[own[k]] for k in some]
            for lost, choice in self.variants([[x for x, _ in c] for c in changes]):
                parts, at = [], 0
                for c, m in choice:
                    k = int(some[c])
                    parts += [ids[at: before[k]], np.array(changes[c][m - 1][1], np.int64)]
                    at = before[k + 1]
                found.append(((total - lost) / SCALE, np.concatenate([*parts, ids[at:]])))
            yield found

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation, as UTF-8."""
        if not len(ids):
            return b""
        return self.bytes[spans(self.starts[ids], self.lengths[ids])].tobytes()[1:]


_models: dict[tuple, Pieces] = {}


def pieces_of(model: bytes, n: int) -> Pieces:
    """One search for all tasks of a worker, so that the units it holds go on."""
    key = (zlib.crc32(model), n)
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(model, n)
    return _models[key]


def encode(docs: DataFrame, model_file: str, n: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_pieces, ids, scores, ids_crc32, restored): the best ids as little-endian 32-bit numbers, and of each of
    the n best segmentations its score and the checksum of its ids; restored: every one decodes to the text."""
    with open(model_file, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, n)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for text, found in zip(texts, pieces.encode(texts), strict=True):
                    data, raw = text.encode(), [ids.astype("<u4").tobytes() for _, ids in found]
                    rows.append((len(found[0][1]), raw[0], [s for s, _ in found], [zlib.crc32(x) for x in raw],
                                 all(pieces.decode(ids) == data for _, ids in found)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_()), strict=True)]], names)

    names = ["doc_id", "n_pieces", "ids", "scores", "ids_crc32", "restored"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_pieces long, ids binary, scores array<double>, ids_crc32 array<long>, restored boolean")


def decode(coded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of rows with (doc_id, ids)."""
    with open(model_file, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, 1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(
                [pieces.decode(np.frombuffer(x, "<u4").astype(np.int64)).decode() for x in batch.column("ids").to_pylist()],
                pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
