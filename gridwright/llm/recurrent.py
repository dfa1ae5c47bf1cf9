"""A gated recurrent network over symbol sequences in numpy: class-factored softmax, truncated backpropagation, carried state.

Symbols are words 0 to ``words - 1``, by falling frequency, and after them tail classes, which stand for all other
words of one kind. The output layer is factored: a softmax over classes, which are runs of ``per_class`` words and
the tail classes, and within a run a softmax over its words. Within a tail class nothing depends on the state; what its
words cost there is the caller's business. Inputs are one-hot, so a symbol's row of ``x`` is its share of the gates.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np

LN10 = float(np.log(10.0))
WIDEST = 256  # steps of a window at most
CHUNK = 1024  # rows whose class scores fit in a core's cache


class Room:
    """Arrays by name, in memory that is kept: what is made anew for each window costs more in page faults than in arithmetic."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        """An array of this shape, not cleared; it is good until the name is asked for again."""
        n = math.prod(shape)
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, np.float32)
        return self.held[name][:n].reshape(shape)


def _softmax(room: Room, h: np.ndarray, w: np.ndarray, y: np.ndarray, wild: bool, grads: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each ``y`` by a softmax of ``h @ w``; ``grads`` get the loss' gradient, as does the second result for ``h``.

    The last column of ``h`` is 1, the last row of ``w`` the biases; what the second result has there is no use.
    ``wild`` is whether a score can be beyond 80.
    """
    e = np.matmul(h, w, out=room("scores", len(y), w.shape[1]))
    flat, at = e.reshape(-1), np.arange(0, e.size, e.shape[1]) + y
    chosen = flat[at]
    if wild and (e.max() > 80.0 or chosen.min() < -80.0):  # else no sum is infinite, none is 0
        e -= e.max(axis=1, keepdims=True)
        chosen = flat[at]
    np.exp(e, out=e)
    if grads is None:
        return chosen - np.log(e @ np.ones(e.shape[1], np.float32)), None
    # Shares are e / total: only what is narrow is divided, and the totals come with the product that the states get.
    back = np.array(w.T, order="C")
    back[:, -1] = 1.0
    d = np.matmul(e, back, out=room("back", *h.shape))
    total = d[:, -1].copy()
    flat[at] -= total
    d /= total[:, None]
    got = e.T @ np.divide(h, total[:, None], out=room("weighed", *h.shape))
    grads[0][...] += got[:, :-1].T
    grads[1][...] += got[:, -1]
    d -= np.take(back, y, axis=0, out=room("own", *h.shape), mode="clip")
    return chosen - np.log(total), d


class Network:
    """Weights and what is done with them. ``start`` is the input before a sequence's first symbol."""

    def __init__(self, words: int, tails: int, hidden: int, per_class: int, log_share: np.ndarray | None = None, seed: int = 7):
        self.words, self.tails, self.hidden, self.per_class = words, tails, hidden, per_class
        self.runs = -(-words // per_class)
        self.classes = self.runs + tails
        self.start = words + tails
        rng = np.random.default_rng(seed)
        self.p = {
            "x": rng.normal(0, 0.3, (words + tails + 1, 3 * hidden)), "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)),
            "c": rng.normal(0, 0.05, (hidden, self.classes)), "cb": np.zeros(self.classes),
            "w": rng.normal(0, 0.05, (words, hidden)), "wb": np.zeros(words),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        if log_share is not None:
            self._from_shares(log_share)
        self.room = Room()
        self.class_of = np.concatenate([np.arange(words) // per_class, self.runs + np.arange(tails)]).astype(np.int64)

    def _from_shares(self, log_share: np.ndarray) -> None:
        """Biases by which the untrained network gives every symbol its share, whatever the state."""
        for k in range(self.runs):
            own = log_share[k * self.per_class : min(self.words, (k + 1) * self.per_class)]
            self.p["cb"][k] = np.logaddexp.reduce(own)
        self.p["cb"][self.runs :] = log_share[self.words :]
        self.p["wb"][:] = log_share[: self.words]

    # Weights as one vector, in pieces of equal length for averaging.

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = np.ascontiguousarray(flat[at : at + n].reshape(self.p[k].shape), dtype=np.float32)
            at += n

    # Forward

    def gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights by gate, from symbols (3, symbols, hidden) and states (3, hidden, hidden); those of z and r negated for the sigmoid."""
        x, u = (np.ascontiguousarray(self.p[k].reshape(-1, 3, self.hidden).transpose(1, 0, 2)) for k in ("x", "u"))
        for w in (x, u):
            np.negative(w[:2], out=w[:2])
        return x, u

    @staticmethod
    def step(gates: np.ndarray, u: np.ndarray, h: np.ndarray, rec: np.ndarray, out: np.ndarray) -> None:
        """New state in ``out`` from the state before; ``gates`` (3, lanes, hidden) has the symbols' shares and gets z, r and n, ``rec`` the state's shares."""
        np.matmul(h, u, out=rec)
        zr, n = gates[:2], gates[2]
        zr += rec[:2]
        np.exp(zr, out=zr)
        zr += 1.0
        np.reciprocal(zr, out=zr)
        n += zr[1] * rec[2]
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= zr[0]
        out += n

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each ``y`` after its state; with ``grads`` also what of the loss reaches the states."""
        cls, k, p = self.class_of[y], self.hidden, self.p
        order = np.argsort(cls.astype(np.uint16), kind="stable")  # rows of a run lie together, those of no run behind
        y, cls = y[order], cls[order]
        one = self.room("states and 1", len(y), k + 1)
        one[:, :k], one[:, k] = np.take(h, order, axis=0, out=self.room("by class", len(y), k), mode="clip"), 1.0
        # States are within 1.
        top, low = np.vstack([p["c"], p["cb"]]), np.column_stack([p["w"], p["wb"]])
        wild = [bool(len(w)) and float(np.abs(w).sum(axis=1).max()) > 80.0 for w in (top.T, low)]
        lp = np.empty(len(y), np.float32)
        dh = None if grads is None else self.room("to states and 1", len(y), k + 1)
        for a in range(0, len(y), CHUNK):
            part = slice(a, a + CHUNK)
            own = None if grads is None else (grads["c"], grads["cb"])
            lp[part], d = _softmax(self.room, one[part], top, cls[part], wild[0], own)
            if d is not None:
                dh[part] = d
        ends = np.searchsorted(cls, np.arange(self.runs + 1)).tolist()
        for run in range(self.runs):
            part = slice(ends[run], ends[run + 1])
            if ends[run] < ends[run + 1]:
                a, b = run * self.per_class, min(self.words, (run + 1) * self.per_class)
                own = None if grads is None else (grads["w"][a:b].T, grads["wb"][a:b])
                within, d = _softmax(self.room, one[part], low[a:b].T, y[part] - a, wild[1], own)
                lp[part] += within
                if d is not None:
                    dh[part] += d
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return lp[back], None if dh is None else np.take(dh, back, axis=0, out=self.room("to states", len(y), k + 1), mode="clip")[:, :k]

    # Training

    def gradient(self, grads: dict, x: np.ndarray, y: np.ndarray, first: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Add the gradient over a window of (steps, lanes), cut at its begin, to ``grads``: (log probability, state behind)."""
        steps, lanes = y.shape
        k = self.hidden
        wx, wu = self.gates()
        on = [(~f).astype(np.float32)[:, None] if f.any() else None for f in first]
        before, states, dh_out, to_z, to_n = (self.room(name, steps, lanes, k) for name in ("before", "states", "dh_out", "to_z", "to_n"))
        rec = self.room("rec", 3, steps, lanes, k)
        gates = np.take(wx, x.ravel(), axis=1, out=self.room("gates", 3, steps * lanes, k), mode="clip").reshape(3, steps, lanes, k)
        for t in range(steps):
            before[t] = h if on[t] is None else h * on[t]
            self.step(gates[:, t], wu, before[t], rec[:, t], states[t])
            h = states[t]
        at = np.flatnonzero(live.ravel())
        flat, whole = states.reshape(-1, k), len(at) == steps * lanes
        lp, d = self.log_probs(flat if whole else flat[at], y.ravel() if whole else y.ravel()[at], grads)
        if not whole:
            dh_out[...] = 0
        dh_out.reshape(-1, k)[slice(None) if whole else at] = d
        # What a step's gates get is a product of these with what its state gets.
        z, r, n = gates
        np.subtract(1, z, out=to_z)
        to_z *= np.subtract(before, n, out=to_n)
        to_r = rec[1:]  # and to the recurrent part of n
        np.multiply(rec[2], np.subtract(1, r, out=to_n), out=to_r[0])
        to_r[0] *= r
        to_r[1] = r
        np.subtract(1, np.multiply(n, n, out=to_n), out=to_n)
        out = self.room("out", 4, steps, lanes, k)  # z, r, recurrent part of n, n
        back = self.room("back of a step", 3, lanes, k)
        dh, keep = np.zeros((lanes, k), np.float32), np.empty((lanes, k), np.float32)
        u = np.ascontiguousarray(self.p["u"].reshape(k, 3, k).transpose(1, 2, 0))
        for t in range(steps - 1, -1, -1):
            own = out[:, t]
            dh += dh_out[t]
            np.multiply(dh, z[t], out=keep)
            dh -= keep
            np.multiply(dh, to_n[t], out=own[3])
            np.multiply(keep, to_z[t], out=own[0])
            np.multiply(own[3], to_r[:, t], out=own[1:3])
            np.add.reduce(np.matmul(own[:3], u, out=back), axis=0, out=dh)
            dh += keep
            if on[t] is not None:
                dh *= on[t]
        past = before.reshape(-1, k).T
        for g in range(3):
            grads["u"][:, g * k : (g + 1) * k] += past @ out[g].reshape(-1, k)
        symbols = x.ravel()[at].astype(np.uint16)
        order = np.argsort(symbols, kind="stable")
        found, begins = np.unique(symbols[order], return_index=True)
        rows = self.room("by symbol", len(order), 3 * k)
        for i, g in enumerate((0, 1, 3)):
            rows[:, i * k : (i + 1) * k] = np.take(out[g].reshape(-1, k), at[order], axis=0, out=self.room("of one gate", len(order), k), mode="clip")
        grads["x"][found] += np.add.reduceat(rows, begins, axis=0)
        return float(lp.sum(dtype=np.float64)), h.copy()


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}

    def update(self, grads: dict, rate: float | None = None) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        cut = min(1.0, 1.0 / norm) if norm > 0 else 1.0
        step = np.float32((self.rate if rate is None else rate) * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            g *= np.float32(cut)
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            v *= np.float32(0.999)
            g *= g
            g *= np.float32(0.001)
            v += g
            d = np.sqrt(v)
            d += np.float32(1e-6)
            np.divide(m, d, out=d)
            d *= step
            self.net.p[k] -= d


def ahead(sequences: Iterable, symbols: int, length) -> Iterator[list]:
    """Runs of sequences of about ``symbols`` symbols, the longest first in each, so that lanes end about together."""
    some, held = [], 0
    for s in sequences:
        if length(s):
            some.append(s)
            held += length(s)
        if held >= symbols:
            yield sorted(some, key=length, reverse=True)
            some, held = [], 0
    if some:
        yield sorted(some, key=length, reverse=True)


def _width(steps: int, lanes: int, live: int) -> int:
    """Steps of a window: more where few lanes are live, so that windows stay about as large."""
    return max(steps, min(WIDEST, lanes * steps // (2 * live)))


def windows(sequences: list[np.ndarray], lanes: int, steps: int, start: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole sequences dealt to lanes, each lane's one behind the other, in windows.

    (inputs, targets, first of its sequence, live, lanes that go on); a lane that doesn't is not in the next window.
    """
    if not sequences:
        return
    # Sequences lie one behind the other; a lane has the one it is in, and how many of its symbols are done.
    flat, length = np.concatenate(sequences), np.array([len(s) for s in sequences])
    begin = np.cumsum(length) - length
    now, taken = np.arange(min(lanes, len(sequences))), min(lanes, len(sequences))
    at = np.zeros(len(now), np.int64)
    while n := len(now):
        more = taken < len(sequences)
        left = length[now] - at
        wide = steps if more else min(_width(steps, lanes, n), int(left.max()))
        place = np.arange(wide)[:, None]
        here = (begin[now] + at)[None, :] + place
        live = place < left[None, :]
        y = np.where(live, flat.take(here, mode="clip").astype(np.int64), 0)
        x = np.where(live, flat.take(here - 1, mode="clip").astype(np.int64), start)
        first = np.zeros((wide, n), bool)
        first[0] = (at == 0) & live[0]
        at += np.minimum(left, wide)
        # Lanes that get to an end within the window go on with the next sequences.
        for i in np.flatnonzero(left < wide).tolist() if more else ():
            t = int(left[i])
            while t < wide and taken < len(sequences):
                now[i], a, m = taken, int(begin[taken]), min(wide - t, int(length[taken]))
                y[t : t + m, i], x[t + 1 : t + m, i] = flat[a : a + m], flat[a : a + m - 1]
                first[t, i], live[t : t + m, i] = True, True
                at[i], t, taken = m, t + m, taken + 1
        x[first] = start
        on = np.flatnonzero((at < length[now]) | (taken < len(sequences)))
        yield x, y, first, live, on
        now, at = now[on], at[on]


def fit(net: Network, sequences: Iterable[np.ndarray], lanes: int, steps: int, rate: float, symbols: int = 4_000_000) -> tuple[int, float]:
    """One pass of truncated backpropagation; the state goes on from window to window. (symbols, their log probability)

    An update takes place once half a full window's symbols have been seen, so that narrow windows share one.
    """
    adam = Adam(net, rate)
    grads = {n: np.zeros_like(v) for n, v in net.p.items()}
    seen, pending, total = 0, 0, 0.0

    def update() -> None:
        for g in grads.values():
            g *= np.float32(1.0 / pending)
        adam.update(grads)
        for g in grads.values():
            g[...] = 0

    for some in ahead(sequences, symbols, len):
        h = np.zeros((min(lanes, len(some)), net.hidden), np.float32)
        for x, y, first, live, on in windows(some, lanes, steps, net.start):
            lp, h = net.gradient(grads, x, y, first, live, h)
            h = h[on]
            n = int(live.sum())
            pending, seen, total = pending + n, seen + n, total + lp
            if 2 * pending >= lanes * steps:
                update()
                pending = 0
    if pending:
        update()
    return seen, total


def score(net: Network, sequences: Iterable[tuple[object, np.ndarray]], lanes: int = 512, steps: int = 48, symbols: int = 4_000_000) -> Iterator[tuple[object, float]]:
    """(key, log10 probability of the whole sequence) of each (key, sequence), the state carried from its first symbol to its last."""
    for some in ahead(sequences, symbols, lambda s: len(s[1])):
        yield from _scored(net, some, lanes, steps)


def _scored(net: Network, some: list[tuple[object, np.ndarray]], lanes: int, steps: int) -> Iterator[tuple[object, float]]:
    sums = np.zeros(len(some))
    length = np.array([len(s) for _, s in some])
    symbols, begin = np.concatenate([s for _, s in some]), np.cumsum(length) - length
    lane_of, at = np.arange(min(lanes, len(some))), np.zeros(min(lanes, len(some)), np.int64)
    taken = len(lane_of)
    h = np.zeros((taken, net.hidden), np.float32)
    wx, wu = net.gates()
    while n := len(lane_of):
        left = length[lane_of] - at
        wide = min(_width(steps, lanes, n), int(left.max()))
        here = (begin[lane_of] + at)[None, :] + np.arange(wide)[:, None]
        y, x = (symbols.take(i, mode="clip").astype(np.int64) for i in (here, here - 1))  # beyond a sequence's end what follows, which is not scored
        x[0, at == 0] = net.start
        states, gates, rec = net.room("states", wide, n, net.hidden), net.room("gates", 3, n, net.hidden), net.room("rec", 3, n, net.hidden)
        for t in range(wide):
            np.take(wx, x[t], axis=1, out=gates, mode="clip")
            net.step(gates, wu, h, rec, states[t])
            h = states[t]
        where = np.flatnonzero((np.arange(wide)[:, None] < left[None, :]).ravel())
        lp, flat = np.zeros(wide * n), states.reshape(-1, net.hidden)
        if len(where) == len(lp):
            lp[:] = net.log_probs(flat, y.ravel())[0]
        else:
            lp[where] = net.log_probs(flat[where], y.ravel()[where])[0]
        sums[lane_of] += lp.reshape(wide, n).sum(axis=0)
        on = left > wide
        new = np.arange(taken, min(len(some), taken + lanes - int(on.sum())))
        taken += len(new)
        lane_of, at = np.concatenate([lane_of[on], new]), np.concatenate([at[on] + wide, np.zeros(len(new), np.int64)])
        h = np.concatenate([h[on], np.zeros((len(new), net.hidden), np.float32)])
    for (key, _), v in zip(some, sums):
        yield key, float(v) / LN10
