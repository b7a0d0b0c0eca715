"""A gated recurrent language model in numpy with a class-factored softmax.

P(word | before) = P(class | state) * P(word | class, state). The most frequent
words are members of classes of equal size, each with its own softmax. All
other words are in tail classes that their spelling names; within one of them a
word has its smoothed share of the corpus counts. Training is by truncated
backpropagation over windows, the state being carried from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class Shape:
    """Members in the head, their number in a class, tail classes, widths, window and lanes."""

    head: int = 4096
    per_class: int = 64
    tails: int = 27
    embedding: int = 24
    hidden: int = 32
    window: int = 16
    lanes: int = 256
    rate: float = 0.012

    @property
    def head_classes(self) -> int:
        return -(-self.head // self.per_class)

    @property
    def classes(self) -> int:
        """Head classes, tail classes, and the end of a text."""
        return self.head_classes + self.tails + 1

    @property
    def end(self) -> int:
        return self.head + self.tails

    @property
    def symbols(self) -> int:
        return self.end + 1


def tail_class(word: bytes) -> int:
    """0..26: how the word ends, and its first letter beyond ASCII."""
    last = word[-1:]
    ending = 1 if last == b"." else 2 if last == b"," else 0
    if word.isascii():
        return 9 * ending
    lead = next(i for i, b in enumerate(word) if b >= 192)
    return 9 * ending + 1 + (word[lead + 1] if lead + 1 < len(word) else 0) % 8


def tail_classes(words: pa.Array) -> np.ndarray:
    """tail_class of each of an array of words (binary, none of them empty)."""
    if not len(words):
        return np.zeros(0, np.int32)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]
    last = data[offsets[1:] - 1]
    out = 9 * np.where(last == ord("."), 1, np.where(last == ord(","), 2, 0))
    leads = np.append(np.flatnonzero(data >= 192), len(data))
    lead = leads[np.searchsorted(leads, offsets[:-1])]
    beyond = lead < offsets[1:]
    out[beyond] += 1 + np.append(data, 0)[lead[beyond] + 1] % 8
    return out.astype(np.int32)


def start(shape: Shape, member_counts: np.ndarray, class_counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters whose first predictions are the corpus frequencies."""
    r = np.random.default_rng(seed)
    small = lambda *n: (r.standard_normal(n) * 0.1).astype(np.float32)
    hidden = shape.hidden
    return {
        "emb": small(shape.symbols, shape.embedding) * 3, "wx": small(shape.embedding, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
        "u": small(hidden, 3 * hidden), "wc": small(hidden, shape.classes) * 0.1, "bc": np.log(class_counts + 0.5).astype(np.float32),
        "wm": small(shape.head_classes, hidden, shape.per_class) * 0.1, "bm": np.log(member_counts + 0.5).astype(np.float32),
    }


def class_of(shape: Shape, symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < shape.head, symbols // shape.per_class, symbols - shape.head + shape.head_classes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def windows(shape: Shape, texts: Iterable[np.ndarray], lanes: int, steps: int):
    """Texts side by side, a window after the other: lanes that go on, inputs, targets, numbers of the texts (-1: none)
    and whether a text begins; all but the first are steps x lanes.

    A lane whose text ends takes the next one, so that one text of each lane is
    held and no more. When no text is left, empty lanes go.
    """
    source = enumerate(texts)
    held: list = [None] * lanes
    at = [0] * lanes  # where the next window of a lane begins in its text
    number, last = np.full(lanes, -1, np.int32), np.full(lanes, shape.end, np.int32)
    going = np.arange(lanes)
    more = True
    while True:
        y = np.full((len(held), steps), shape.end, np.int32)
        doc, new = np.repeat(number[:, None], steps, axis=1), np.zeros(y.shape, bool)
        for k, (text, i) in enumerate(zip(held, at)):
            if i and i + steps < len(text):  # all of the window is within one text
                y[k] = text[i : i + steps]
                at[k] = i + steps
                continue
            doc[k] = -1
            t = 0
            while t < steps:
                if text is None:
                    number[k], text = next(source, (-1, None)) if more else (-1, None)
                    more, i = text is not None, 0
                    if text is None:
                        break
                n = min(steps - t, len(text) - i)
                y[k, t : t + n] = text[i : i + n]
                doc[k, t : t + n] = number[k]
                new[k, t] |= i == 0
                i, t = i + n, t + n
                if i == len(text):
                    text, i = None, 0
            held[k], at[k] = text, i
        # What is read is what came before; after the end of a text, or of all texts, that is an end.
        x = np.concatenate((last[:, None], y[:, :-1]), axis=1)
        x[new] = shape.end
        last = y[:, -1]
        live = doc[:, 0] >= 0
        if not live.all():
            some = np.flatnonzero(live)
            if not len(some):
                return
            x, y, doc, new, number, last, going = x[some], y[some], doc[some], new[some], number[some], last[some], going[some]
            held, at = [held[k] for k in some], [at[k] for k in some]
        yield (going, *(np.ascontiguousarray(z.T) for z in (x, y, doc, new)))
        going = np.arange(len(held))


def _by_class(shape: Shape, y: np.ndarray, classes: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Places of head members in y in order of their classes, and (class, its part of them) for each class that occurs."""
    places = np.flatnonzero(live & (y < shape.head))
    counts = np.bincount(of := classes.take(places).astype(np.int16), minlength=shape.head_classes)
    places = places.take(np.argsort(of, kind="stable"))
    ends = np.cumsum(counts)
    return places, [(int(k), slice(ends[k] - counts[k], ends[k])) for k in np.flatnonzero(counts)]


#: Rows of logits, and parameters, that are worked on at once, which a core keeps near.
ROWS, NEAR = 512, 1 << 14


def _calm(w: np.ndarray, axis: int) -> bool:
    """Whether logits stay small whatever the state, which is between -1 and 1; w: weights and biases, summed along the axis."""
    return float(np.abs(w).sum(axis=axis).max(initial=0)) < 60


def _shifted(z: np.ndarray, axis: int, calm: bool):
    """Exponentials of logits, in place, and by how much they were shifted along the axis, if any is large."""
    top = 0
    if not calm and z.size and max(float(z.max()), -float(z.min())) > 60:
        top = z.max(axis=axis)
        z -= np.expand_dims(top, axis)
    np.exp(z, out=z)
    return top


def _sums(z: np.ndarray, axis: int) -> np.ndarray:
    one = np.ones(z.shape[axis], z.dtype)
    return z @ one if axis else one @ z


def _errors(z: np.ndarray, chosen: np.ndarray, weight: np.ndarray, axis: int = 1, calm: bool = False) -> float:
    """Sum of the log probabilities of the chosen columns of logits (axis 0: rows), in rows of some weight; z becomes the weighted gradient by the logits."""
    others = np.arange(z.shape[1 - axis])
    place = (others, chosen) if axis else (chosen, others)
    own = z[place]
    top = _shifted(z, axis, calm)
    sums = _sums(z, axis)
    z *= np.expand_dims(weight / sums, axis)
    z[place] -= weight
    return float((own - np.log(sums) - top)[weight > 0].sum())


def _log_sums(z: np.ndarray, axis: int = 1, calm: bool = False) -> np.ndarray:
    """Log of the sum of exponentials of each row (axis 0: column); changes z. Rows are shifted by their maximum where any logit is large."""
    top = _shifted(z, axis, calm)
    return np.log(_sums(z, axis)) + top


def _recurrent(p: dict, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by what is read and a one, and by the state, a row for each gate; those of the sigmoids are negated: 1 / (1 + exp(-a))."""
    wx, u = np.concatenate((p["wx"], p["b"][None])).T.copy(), p["u"].T.copy()
    wx[: 2 * hidden] *= -1
    u[: 2 * hidden] *= -1
    return wx, u


def _read(p: dict, x: np.ndarray) -> np.ndarray:
    """Embeddings of what is read in each step, and a one for the biases: steps x lanes x width."""
    emb = np.concatenate((p["emb"], np.ones((len(p["emb"]), 1), p["emb"].dtype)), axis=1)
    return emb.take(x.ravel(), axis=0).reshape(*x.shape, -1)


def _step(e, wx, u, h, a, hu, gates, news, tops=None) -> np.ndarray:
    """The next state, features x lanes. a, hu: room for what gates take in; gates, news, tops: get z and r, n, and what r lets through."""
    hidden = len(h)
    two = 2 * hidden
    np.dot(wx, e.T, out=a)
    np.dot(u, h, out=hu)
    np.add(a[:two], hu[:two], out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    if tops is not None:
        tops[:] = hu[two:]
    # tanh(n) = 1 - 2 / (1 + exp(2 n))
    np.multiply(hu[two:], gates[hidden:], out=news)
    news += a[two:]
    news *= 2
    np.exp(news, out=news)
    news += 1
    np.divide(-2, news, out=news)
    news += 1
    out = h - news
    out *= gates[:hidden]
    out += news
    return out


def score(p: dict, shape: Shape, texts: list[np.ndarray], lanes: int = 256, window: int = 16) -> np.ndarray:
    """Natural log probability of each text's classes and members; what tail classes leave open is not in it. Texts aren't empty."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    lanes = max(1, min(lanes, len(texts)))
    order = np.argsort([-len(t) for t in texts], kind="stable")  # the longest first, so that lanes end together
    hidden = shape.hidden
    wx, u = _recurrent(p, hidden)
    emb = np.concatenate((p["emb"], np.ones((len(p["emb"]), 1), np.float32)), axis=1)
    wc, wm = np.concatenate((p["wc"], p["bc"][None])).T.copy(), np.concatenate((p["wm"], p["bm"][:, None]), axis=1)
    calm_c, calm_m = _calm(wc, 1), _calm(wm, 1)
    h = np.zeros((hidden, lanes), np.float32)
    with np.errstate(over="ignore"):  # of exp: a gate that is shut
        for going, x, y, doc, new in windows(shape, (texts[i] for i in order), lanes, window):
            width = len(going)
            h = h.take(going, axis=1) if width < h.shape[1] else h
            states, logs = np.ones((window, width, hidden + 1), np.float32), np.empty((window, width), np.float32)
            a, hu, gates, news = (np.empty((n * hidden, width), np.float32) for n in (3, 3, 2, 1))
            z, one = np.empty((len(wc), width), np.float32), np.ones((hidden + 1, width), np.float32)
            classes, at, fresh = class_of(shape, y), np.arange(width), new.any(axis=1)
            for t in range(window):
                if fresh[t]:
                    h[:, new[t]] = 0
                h = _step(emb.take(x[t], axis=0), wx, u, h, a, hu, gates, news)
                one[:hidden] = h
                states[t, :, :hidden] = h.T
                np.dot(wc, one, out=z)
                logs[t] = z[classes[t], at] - _log_sums(z, 0, calm_c)
            live = (doc >= 0).ravel()
            ys, logp = y.ravel(), logs.ravel()
            head, parts = _by_class(shape, ys, classes.ravel(), live)
            sorted_states, own = states.reshape(-1, hidden + 1).take(head, axis=0), ys.take(head) % shape.per_class
            m = np.empty((len(head), shape.per_class), np.float32)
            for k, part in parts:
                np.dot(sorted_states[part], wm[k], out=m[part])
            for i in range(0, len(head), ROWS):
                part = slice(i, i + ROWS)
                chosen = m[np.arange(i, min(i + ROWS, len(head))), own[part]]
                logp[head[part]] += chosen - _log_sums(m[part], 1, calm_m)
            d = doc.ravel()
            if not live.all():
                d, logp = d[live], logp[live]
            total += np.bincount(d, weights=logp, minlength=len(texts))
    out = np.empty_like(total)
    out[order] = total
    return out


def _gradients(p: dict, shape: Shape, x, y, live, starts, h):
    """Loss, gradients and last state of one window. Within it states and gates are features x lanes, each gate a block."""
    steps, lanes = x.shape
    hidden, kind = shape.hidden, p["wx"].dtype
    two = 2 * hidden
    e = _read(p, x)
    wx, u = _recurrent(p, hidden)
    kept, news, tops = (np.empty((steps, hidden, lanes), kind) for _ in range(3))
    gates, a, hu = np.empty((steps, two, lanes), kind), np.empty((3 * hidden, lanes), kind), np.empty((3 * hidden, lanes), kind)
    classes, ys, on = class_of(shape, y), y.ravel(), live.ravel()
    count = max(1, int(on.sum()))
    weight = live.astype(kind) / kind.type(count)
    loss, ds, at = 0.0, np.empty((steps, hidden, lanes), kind), np.arange(lanes)
    # States, and a one for the biases: of a step, and of all of them with lanes first.
    one, states = np.ones((hidden + 1, lanes), kind), np.ones((steps, lanes, hidden + 1), kind)
    wc = np.concatenate((p["wc"], p["bc"][None])).T.copy()
    gc, d, calm = np.zeros_like(wc), np.empty((len(wc), lanes), kind), _calm(wc, 1)
    fresh = starts.any(axis=1)
    h = h.T
    for t in range(steps):
        kept[t] = h
        if fresh[t]:
            kept[t][:, starts[t]] = 0
        h = _step(e[t], wx, u, kept[t], a, hu, gates[t], news[t], tops[t])
        one[:hidden] = h
        states[t, :, :hidden] = h.T
        np.dot(wc, one, out=d)
        loss -= _errors(d, classes[t], weight[t], 0, calm)
        gc += d @ one.T
        np.dot(p["wc"], d, out=ds[t])
    places, parts = _by_class(shape, ys, classes.ravel(), on)
    tops_of, own = states.reshape(-1, hidden + 1).take(places, axis=0), ys.take(places) % shape.per_class
    heavy = weight.ravel().take(places)
    m, dtops = np.empty((len(places), shape.per_class), kind), np.empty((len(places), hidden), kind)
    wm = np.concatenate((p["wm"], p["bm"][:, None]), axis=1)
    gm, calm = np.zeros_like(wm), _calm(wm, 1)
    for k, part in parts:
        np.dot(tops_of[part], wm[k], out=m[part])
    for i in range(0, len(places), ROWS):
        part = slice(i, i + ROWS)
        loss -= _errors(m[part], own[part], heavy[part], 1, calm)
    for k, part in parts:
        np.dot(tops_of[part].T, m[part], out=gm[k])
        np.dot(m[part], p["wm"][k].T, out=dtops[part])
    more = np.zeros((steps * lanes, hidden), kind)
    more[places] = dtops
    more = more.reshape(steps, lanes, hidden)
    g = {"wc": np.ascontiguousarray(gc[:, :-1].T), "bc": gc[:, -1].copy(), "wm": gm[:, :-1], "bm": gm[:, -1]}
    gu, gwx, de = np.zeros_like(u), np.zeros_like(wx), np.empty((steps, lanes, e.shape[2] - 1), kind)
    da, dh, back = np.empty((3 * hidden, lanes), kind), np.zeros((hidden, lanes), kind), np.ascontiguousarray(p["wx"].T)
    dz, dr, dn = da[:hidden], da[hidden:two], da[two:]
    rest = np.empty_like(dh)
    for t in range(steps - 1, -1, -1):
        dh += ds[t]
        dh += more[t].T
        z, r, n = gates[t, :hidden], gates[t, hidden:], news[t]
        np.subtract(1, z, out=rest)
        rest *= dh
        np.subtract(kept[t], n, out=dz)
        dz *= z
        dz *= rest
        np.multiply(n, n, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= rest
        np.subtract(1, r, out=dr)
        dr *= r
        dr *= tops[t]
        dr *= dn
        gwx += da @ e[t]
        np.dot(da.T, back, out=de[t])
        dn *= r
        gu += da @ kept[t].T
        dh *= z
        dh += p["u"] @ da
        if fresh[t]:
            dh[:, starts[t]] = 0
    g["u"], g["wx"], g["b"] = np.ascontiguousarray(gu.T), np.ascontiguousarray(gwx[:, :-1].T), gwx[:, -1].copy()
    order = np.argsort(x.ravel().astype(np.uint16) if shape.symbols <= 1 << 16 else x.ravel(), kind="stable")
    read = x.ravel().take(order)
    first = np.flatnonzero(np.concatenate(([True], read[1:] != read[:-1])))
    g["emb"] = np.zeros_like(p["emb"])
    g["emb"][read[first]] = np.add.reduceat(de.reshape(steps * lanes, -1).take(order, axis=0), first, axis=0)
    return loss, count, g, h.T


class Trainer:
    """Adam over windows of the texts that come in."""

    def __init__(self, p: dict, shape: Shape):
        self.p, self.shape = {k: v.copy() for k, v in p.items()}, shape
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.steps, self.tokens, self.loss = 0, 0, 0.0

    def learn(self, texts: Iterable[np.ndarray]) -> None:
        """Go once through texts that come one by one; none of them is empty. A window of few tokens changes little."""
        shape = self.shape
        h = np.zeros((shape.lanes, shape.hidden), np.float32)
        for going, x, y, doc, new in windows(shape, texts, shape.lanes, shape.window):
            with np.errstate(over="ignore"):  # of exp: a gate that is shut
                loss, count, g, h = _gradients(self.p, shape, x, y, doc >= 0, new, h[going])
            self.steps, self.tokens, self.loss = self.steps + 1, self.tokens + count, self.loss + loss
            rate = shape.rate / (1 + self.steps / 2000) * count / (shape.lanes * shape.window)
            norm = float(np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())))
            shrink = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            a, b = 1 - 0.9 ** min(self.steps, 1000), 1 - 0.999 ** min(self.steps, 20_000)
            # m and v are kept without the factors 0.1 and 0.001 of what comes in.
            scale = np.sqrt(b / 0.001)
            for k, d in g.items():
                flat = [z.reshape(-1) for z in (self.p[k], self.m[k], self.v[k], d)]
                for at in range(0, d.size, NEAR):
                    self._move(*(z[at : at + NEAR] for z in flat), shrink, 0.1 * rate / a * scale, 1e-6 * scale)

    @staticmethod
    def _move(p, m, v, d, shrink, rate, least) -> None:
        step = d * shrink
        m *= np.float32(0.9)
        m += step
        step *= step
        v *= np.float32(0.999)
        v += step
        np.sqrt(v, out=step)
        step += np.float32(least)
        np.divide(m, step, out=step)
        step *= np.float32(rate)
        p -= step
