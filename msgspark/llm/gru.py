"""A gated recurrent language model in numpy.

Items (frequent words, the end token, groups of rare words) are put into classes by the square root of their counts, so that
P(item) = P(class | state) * P(item | class, state) costs one softmax over the classes and one within a class. Training
goes through many streams of documents in windows and propagates errors back to the window's start only; the state goes on
into the next window and is set to zero where a document begins. Scoring lays whole documents into streams in the
same way, so a document's log probability is that of all its items, however long it is.
"""

from __future__ import annotations

import heapq

import numpy as np

WIDTH, EMBED, CLASSES = 24, 20, 64
STREAMS, WINDOW = 96, 24
BLOCK, TARGET_ROWS = 1 << 15, 768
SCORE_STREAMS, SCORE_ROWS = 256, 8192
NAMES = ("embed", "inward", "inner", "offset", "inner_offset", "to_class", "class_offset", "to_item", "item_offset")


def classes_of(counts: np.ndarray, n_classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the items by class, first place of each class, and class of each item; every class has an item."""
    by_count = np.argsort(-counts, kind="stable")
    n_classes = max(1, min(n_classes, len(counts)))
    weight = np.sqrt(np.maximum(counts[by_count], 1.0))
    edge = (np.cumsum(weight) - weight) / weight.sum() * n_classes
    own = np.minimum(edge.astype(np.int64), np.arange(len(counts)))  # no class is skipped
    own = np.unique(own, return_inverse=True)[1]
    of_item = np.empty(len(counts), np.int64)
    of_item[by_count] = own
    return by_count, np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(counts)], of_item


class Room:
    """Arrays by name that are used again: a window's arrays are as large as the next one's."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def array(self, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.kept or len(self.kept[name]) < size or self.kept[name].dtype != kind:
            self.kept[name] = np.empty(size, kind)
        return self.kept[name][:size].reshape(shape)


class Gru:
    """Parameters by name; items are numbered so that a class is a range."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        """``counts`` of the items in any order; ``number`` maps an item to its place."""
        order, self.first, of_item = classes_of(np.asarray(counts, float))
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.arange(len(order))
        self.class_of = of_item[order]
        rng, n, c = np.random.default_rng(seed), len(order), len(self.first) - 1
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        mass = np.asarray(counts, float)[order] + 0.1
        of_class = np.add.reduceat(mass, self.first[:-1])
        self.p = {
            "embed": draw(n, EMBED, scale=0.3), "inward": draw(EMBED, 3 * WIDTH, scale=EMBED ** -0.5),
            "inner": draw(WIDTH, 3 * WIDTH, scale=0.7 * WIDTH ** -0.5), "offset": np.zeros(3 * WIDTH, np.float32),
            "inner_offset": np.zeros(WIDTH, np.float32), "to_class": draw(WIDTH, c, scale=0.02),
            "class_offset": np.log(of_class / of_class.sum()).astype(np.float32), "to_item": draw(n, WIDTH, scale=0.02),
            "item_offset": np.log(mass / of_class[self.class_of]).astype(np.float32)}

    def packed(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in NAMES])

    def views(self, values: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters' shapes, by name, on parts of one array."""
        cut = np.cumsum([self.p[k].size for k in NAMES])[:-1]
        return {k: part.reshape(self.p[k].shape) for k, part in zip(NAMES, np.split(values, cut), strict=True)}

    def unpack(self, values: np.ndarray, copy: bool = True) -> None:
        self.p = {k: v.astype(np.float32, copy=copy) for k, v in self.views(values).items()}

    def targets(self, h: np.ndarray, y: np.ndarray, back: np.ndarray | None, room: Room):
        """Natural log probability of items ``y``, in ascending order, in states ``h``; with ``back``, also gradients of their
        sum with weights ``-back``, and the states'. The last column of ``h`` is 1, so that offsets are the last row of a
        layer's matrix. The largest logit of a row is taken off first only where an overflow is not ruled out."""
        first, kind, c = self.first, h.dtype, self.class_of[y]
        to_class = np.concatenate([self.p["to_class"], self.p["class_offset"][None]])
        back_to, d_class = np.ascontiguousarray(to_class[:-1].T), np.zeros_like(to_class)
        out, ones = np.empty(len(y)), np.ones(to_class.shape[1], kind)
        dh = None if back is None else np.empty((len(y), WIDTH), kind)
        for i in range(0, len(y), TARGET_ROWS):
            own = slice(i, i + TARGET_ROWS)
            states, at = h[own], c[own]
            rows = np.arange(len(at))
            e = np.matmul(states, to_class, out=room.array("class", (len(at), len(ones)), kind))
            if not -60 < e.min() <= e.max() < 60:
                e -= e.max(1, keepdims=True)
            chosen = e[rows, at]
            np.exp(e, out=e)
            total = e @ ones
            out[own] = chosen - np.log(total)
            if back is not None:  # softmax less the target, times the row's total: the division is left to the rows of the states
                e[rows, at] -= total
                share = (back[own] / total)[:, None]
                d_class += (states * share).T @ e
                np.matmul(e, back_to, out=dh[own])
                dh[own] *= share

        # logits of all classes end to end in one array
        to_item = room.array("to_item", (len(self.class_of), WIDTH + 1), kind)
        to_item[:, :-1], to_item[:, -1] = self.p["to_item"], self.p["item_offset"]
        size = np.diff(first)
        ends = np.searchsorted(c, np.arange(len(first))).tolist()
        at = np.cumsum(size[c]) - size[c]
        e = room.array("item", (int(at[-1] + size[c[-1]]) if len(y) else 0,), kind)
        blocks, begin = [], 0
        for a, b, i, j in zip(first[:-1].tolist(), first[1:].tolist(), ends[:-1], ends[1:], strict=True):
            if i < j:
                end = begin + (j - i) * (b - a)
                block, begin = e[begin:end].reshape(j - i, b - a), end
                np.matmul(h[i:j], to_item[a:b].T, out=block)
                blocks.append((block, a, b, i, j))
        if len(y) and not -60 < e.min() <= e.max() < 60:
            for block, *_ in blocks:
                block -= block.max(1, keepdims=True)
        place = at + y - first[c]
        chosen = e[place]
        np.exp(e, out=e)
        total = np.add.reduceat(e, at) if len(y) else np.ones(0, kind)
        out += chosen - np.log(total)
        if back is None:
            return out
        e[place] -= total
        share = (back / total)[:, None]
        states, d_item, inner = h * share, room.array("d_item", to_item.shape, kind), np.empty_like(dh)
        d_item[:] = 0
        for block, a, b, i, j in blocks:
            np.matmul(block, to_item[a:b, :-1], out=inner[i:j])
            np.matmul(block.T, states[i:j], out=d_item[a:b])
        inner *= share
        dh += inner
        return out, {"to_class": d_class[:-1], "class_offset": d_class[-1], "to_item": d_item[:, :-1], "item_offset": d_item[:, -1]}, dh

    def states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, room: Room):
        """The states after items ``x`` from ``h``, and what going back needs: inputs, states before, gates with the new value, the
        states' share and where they were kept. Arrays are (time, value, stream)."""
        # 1 / (1 + exp(v)) with the sign in the weights; the last row of inputs and states is 1, for the offsets
        (steps, streams), w, p = x.shape, WIDTH, self.p
        kind = p["inner"].dtype
        one, sign = kind.type(1), np.where(np.arange(3 * w) < 2 * w, -1, 1).astype(kind)
        inward = np.ascontiguousarray((np.concatenate([p["inward"], p["offset"][None]]) * sign).T)
        inner = np.ascontiguousarray((np.concatenate([p["inner"], np.r_[np.zeros(2 * w, kind), p["inner_offset"]][None]]) * sign).T)
        inputs, before = (room.array(name, (steps, n + 1, streams), kind) for name, n in (("inputs", EMBED), ("before", w)))
        inputs[:, :EMBED] = p["embed"][x].transpose(0, 2, 1)
        inputs[:, EMBED] = before[:, w] = 1
        gates = np.matmul(inward, inputs, out=room.array("gates", (steps, 3 * w, streams), kind))
        g, states = room.array("g", gates.shape, kind), room.array("states", (steps, w, streams), kind)
        keep, part = (~fresh).astype(kind), np.empty((w, streams), kind)
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the limit
            for was, u, rz, n, k, after in zip(before, g, gates[:, : 2 * w], gates[:, 2 * w:], keep, states, strict=True):
                last = was[:w]
                np.multiply(h, k, out=last)
                np.matmul(inner, was, out=u)
                np.add(rz, u[: 2 * w], out=rz)
                np.exp(rz, out=rz)
                np.add(rz, one, out=rz)
                np.reciprocal(rz, out=rz)
                np.multiply(rz[:w], u[2 * w:], out=part)
                np.add(n, part, out=n)
                np.tanh(n, out=n)
                np.subtract(last, n, out=part)
                np.multiply(part, rz[w:], out=part)
                h = np.add(part, n, out=after)
        return states, inputs, before, gates, g, keep

    def sorted_by(self, items: np.ndarray) -> np.ndarray:
        return np.argsort(items.astype(np.uint16) if len(self.class_of) <= 1 << 16 else items, kind="stable")

    def in_order(self, states: np.ndarray, order: np.ndarray, room: Room) -> np.ndarray:
        """States as rows, a 1 behind each."""
        found = room.array("in_order", (len(order), WIDTH + 1), states.dtype)
        found[:, :-1] = states.transpose(0, 2, 1).reshape(-1, WIDTH)[order]
        found[:, -1] = 1
        return found

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, weight: np.ndarray, h: np.ndarray, room: Room | None = None,
               embed: np.ndarray | None = None):
        """Loss, gradients and last state of one window; arrays are (time, stream). What it returns may lie in ``room``; the
        embedding's gradient is put into ``embed``."""
        (steps, streams), w, p, room = x.shape, WIDTH, self.p, room or Room()
        kind = p["inner"].dtype
        states, inputs, before, gates, g, keep = self.states(x, fresh, np.ascontiguousarray(h.T), room)

        # rows in the order of their items; rows without weight have no part
        flat, share = y.ravel(), weight.ravel()
        order = self.sorted_by(flat)
        if not share.all():
            order = order[share[order] > 0]
        rows = share[order] / max(1.0, weight.sum())
        in_order = self.in_order(states, order, room)
        logp, grads, dh_in_order = self.targets(in_order, flat[order].astype(np.int64), rows.astype(kind), room)
        dh = np.zeros((steps * streams, w), kind)
        dh[order] = dh_in_order
        dh = np.ascontiguousarray(dh.reshape(steps, streams, w).transpose(0, 2, 1))

        # a state's error is multiplied with these to become that of the gates, for all steps at once
        one, r, z, n = kind.type(1), gates[:, :w], gates[:, w: 2 * w], gates[:, 2 * w:]
        by_r, by_z, by_n = g[:, :w], g[:, w: 2 * w], g[:, 2 * w:]
        np.subtract(before[:, :w], n, out=by_z)
        by_z *= z
        n *= n
        np.subtract(one, n, out=n)
        np.subtract(one, z, out=by_r)
        n *= by_r
        by_z *= by_r
        np.subtract(one, r, out=by_r)
        by_r *= by_n
        np.multiply(n, r, out=by_n)
        by_r *= by_n
        inner, carry, part = np.ascontiguousarray(p["inner"]), np.zeros((w, streams), kind), np.empty((w, streams), kind)
        for d, k, own, move in zip(dh[::-1], keep[::-1], g[::-1], z[::-1], strict=True):
            d += carry
            three = own.reshape(3, w, streams)
            np.multiply(three, d, out=three)
            np.matmul(inner, own, out=carry)
            np.multiply(d, move, out=part)
            carry += part
            carry *= k
        d_inner = np.matmul(before, g.transpose(0, 2, 1)).sum(0)
        np.multiply(dh, n, out=by_n)  # from here the errors of the inputs' share
        d_inward = np.matmul(inputs, g.transpose(0, 2, 1)).sum(0)
        grads |= {"inner": d_inner[:w], "inner_offset": d_inner[w, 2 * w:], "inward": d_inward[:EMBED], "offset": d_inward[EMBED]}
        d_inputs = np.matmul(p["inward"], g, out=inputs[:, :EMBED])
        order = self.sorted_by(x.ravel())
        own = x.ravel()[order]
        at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        grads["embed"] = np.empty_like(p["embed"]) if embed is None else embed
        grads["embed"][:] = 0
        grads["embed"][own[at]] = np.add.reduceat(d_inputs.transpose(0, 2, 1).reshape(-1, EMBED)[order], at)
        return -(logp * rows).sum(), grads, states[-1].T

    def fit(self, texts: list[np.ndarray], start: int, rate: float) -> None:
        """One pass over documents, each an array of item numbers with its end; ``start`` is the input before the first."""
        x, y, fresh, weight = streams_of(texts, start, STREAMS)
        live = (weight > 0).sum(1)  # streams come longest first
        values = self.packed()
        self.unpack(values, copy=False)
        g, m, v = (np.zeros_like(values) for _ in range(3))
        of, room, n = self.views(g), Room(), 0
        h, q = np.zeros((x.shape[1], WIDTH), np.float32), np.empty(min(BLOCK, len(g)), np.float32)
        for a in range(0, len(x), WINDOW):
            own = slice(a, a + WINDOW), slice(0, live[a])
            _, grads, h = self.window(x[own], y[own], fresh[own], weight[own], h[: live[a]], room, of["embed"])
            del grads["embed"]  # is in its place
            for k, d in grads.items():
                of[k][...] = d
            n += 1
            norm = np.sqrt(float(np.vdot(g, g)))
            if norm > 2:
                g *= np.float32(2 / norm)
            # means of 0.9 m + 0.1 g and 0.995 v + 0.005 g g, over 0.1 and 0.005; the factors are in the size and the least divisor
            size = np.float32(rate * np.sqrt(1 - 0.995 ** n) / (1 - 0.9 ** n) * 0.1 / np.sqrt(0.005))
            for b in range(0, len(g), BLOCK):  # blocks stay in the cache from one operation to the next
                (d, mean, square), part = (z[b: b + BLOCK] for z in (g, m, v)), q[: len(g) - b]
                mean *= np.float32(0.9)
                mean += d
                square *= np.float32(0.995)
                d *= d
                square += d
                np.sqrt(square, out=part)
                part += np.float32(1e-6 / np.sqrt(0.005))
                np.divide(mean, part, out=part)
                part *= size
                values[b: b + BLOCK] -= part

    def score(self, texts: list[np.ndarray], start: int) -> np.ndarray:
        """Natural log probability of every document."""
        owner, x, y, fresh, live = streams_of(texts, start, SCORE_STREAMS, owners=True)
        out, h, room, a = np.zeros(len(texts)), np.zeros((WIDTH, x.shape[1]), np.float32), Room(), 0
        while a < len(x):
            k = int(live[a])
            part = slice(a, min(a - (-SCORE_ROWS // k), len(x))), slice(0, k)
            states = self.states(x[part], fresh[part], np.ascontiguousarray(h[:, :k]), room)[0]
            h = states[-1].copy()
            own, items = owner[part].ravel(), y[part].ravel()
            order = self.sorted_by(items)
            if own.min() < 0:
                order = order[own[order] >= 0]
            logp = self.targets(self.in_order(states, order, room), items[order].astype(np.int64), None, room)
            out += np.bincount(own[order], logp, minlength=len(texts))
            a = part[0].stop
        return out


def streams_of(texts: list[np.ndarray], start: int, streams: int, owners: bool = False):
    """Documents laid end to end in ``streams`` streams of like lengths, longest first: inputs, targets, where documents
    begin, and weights; or the owner of each place and the number of streams that go on."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    if texts:  # no more streams than a longest document leaves work for, so the arrays are about as large as the texts
        streams = min(streams, len(texts), 1 + sum(map(len, texts)) // max(1, len(texts[order[0]])))
    ends = [(0, s) for s in range(streams if texts else 0)]
    rows: list[list[int]] = [[] for _ in ends]
    for i in order:
        n, s = heapq.heappop(ends)
        rows[s].append(i)
        heapq.heappush(ends, (n + len(texts[i]), s))
    size = sorted(((n, s) for n, s in ends), reverse=True)
    steps = size[0][0] if size else 0
    x = np.full((steps, len(size)), start, np.int32)
    y, owner = np.full_like(x, start), np.full_like(x, -1)
    fresh = np.zeros(x.shape, bool)
    for column, (_, s) in enumerate(size):
        at = 0
        for i in rows[s]:
            n = len(texts[i])
            y[at: at + n, column] = texts[i]
            x[at + 1: at + n, column] = texts[i][:-1]
            owner[at: at + n, column] = i
            fresh[at, column] = True
            at += n
    if not owners:
        return x, y, fresh, (owner >= 0).astype(np.float32)
    lengths = np.array([n for n, _ in size])
    return owner, x, y, fresh, (lengths[None] > np.arange(steps)[:, None]).sum(1) if steps else np.zeros(0, int)
