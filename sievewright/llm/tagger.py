"""Character tagger in numpy: a bidirectional LSTM whose outputs feed a linear-chain CRF."""

from __future__ import annotations

import numpy as np

HIDDEN, STEPS, BATCH, RATE = 12, 160, 48, 2e-2


def _gates(z, h):
    """Input, forget and output gates and the candidate."""
    s = 0.5 * (1 + np.tanh(0.5 * z[:, :3 * h]))
    return s[:, :h], s[:, h:2 * h], s[:, 2 * h:], np.tanh(z[:, 3 * h:])


class Tagger:
    """`allowed[a, b]` says whether tag b may follow tag a; `first` which tags may begin."""

    def __init__(self, symbols: int, allowed: np.ndarray, first: np.ndarray):
        rng = np.random.default_rng(5)
        tags = len(allowed)
        self.allowed, self.first = allowed, first
        self.weights = {"out": rng.normal(0, 0.3, (2 * HIDDEN, tags)), "shift": np.zeros(tags), "move": np.zeros((tags, tags))}
        for side in ("left", "right"):
            self.weights[f"in_{side}"] = rng.normal(0, 0.5, (symbols, 4 * HIDDEN))
            self.weights[f"in_{side}"][:, HIDDEN:2 * HIDDEN] += 1
            self.weights[f"re_{side}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))

    def _run(self, x, side, cache=None):
        """Hidden states (time, row, hidden) of one direction, in the order of `x`."""
        into, again = self.weights[f"in_{side}"], self.weights[f"re_{side}"]
        steps = range(x.shape[1]) if side == "left" else range(x.shape[1] - 1, -1, -1)
        h = np.zeros((len(x), HIDDEN), into.dtype)
        c = np.zeros_like(h)
        out = np.empty((x.shape[1], len(x), HIDDEN), into.dtype)
        for t in steps:
            i, f, o, g = _gates(into[x[:, t]] + h @ again, HIDDEN)
            before, c = c, f * c + i * g
            u = np.tanh(c)
            if cache is not None:
                cache[t] = (h, before, i, f, o, g, u)
            h = o * u
            out[t] = h
        return out

    def emissions(self, x, caches=None):
        """(time, row, tag) scores."""
        left = self._run(x, "left", None if caches is None else caches[0])
        right = self._run(x, "right", None if caches is None else caches[1])
        both = np.concatenate((left, right), axis=2)
        return both, both @ self.weights["out"] + self.weights["shift"]

    def _moves(self):
        return np.where(self.allowed, self.weights["move"], -1e4).astype(self.weights["move"].dtype)

    def _gradients(self, x, y):
        caches = ({}, {})
        both, score = self.emissions(x, caches)
        steps, n, tags = score.shape
        move, enter = self._moves(), np.where(self.first, 0.0, -1e4)
        ahead, behind = np.empty_like(score), np.zeros_like(score)
        ahead[0] = score[0] + enter
        for t in range(1, steps):
            v = ahead[t - 1][:, :, None] + move
            top = v.max(axis=1)
            ahead[t] = score[t] + top + np.log(np.exp(v - top[:, None]).sum(axis=1))
        for t in range(steps - 2, -1, -1):
            v = move + (score[t + 1] + behind[t + 1])[:, None, :]
            top = v.max(axis=2)
            behind[t] = top + np.log(np.exp(v - top[:, :, None]).sum(axis=2))
        last = ahead[-1]
        top = last.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(last - top).sum(axis=1, keepdims=True))
        d = np.exp(ahead + behind - total)
        pair = np.zeros((tags, tags))
        for t in range(steps - 1):
            pair += np.exp(ahead[t][:, :, None] + move + (score[t + 1] + behind[t + 1])[:, None, :] - total[:, :, None]).sum(axis=0)
            np.subtract.at(pair, (y[:, t], y[:, t + 1]), 1)
        d[np.arange(steps)[:, None], np.arange(n), y.T] -= 1
        scale = 1.0 / n
        d *= scale
        grad = {"move": np.where(self.allowed, pair * scale, 0), "out": np.einsum("tnh,tnk->hk", both, d), "shift": d.sum(axis=(0, 1))}
        back = d @ self.weights["out"].T
        for side, cache, part in (("left", caches[0], back[:, :, :HIDDEN]), ("right", caches[1], back[:, :, HIDDEN:])):
            again = self.weights[f"re_{side}"]
            g_in, g_re = np.zeros_like(self.weights[f"in_{side}"]), np.zeros_like(again)
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            order = range(steps - 1, -1, -1) if side == "left" else range(steps)
            for t in order:
                h, before, i, f, o, g, u = cache[t]
                dh = dh + part[t]
                dc = dc + dh * o * (1 - u * u)
                dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * u * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                np.add.at(g_in, x[:, t], dz)
                g_re += h.T @ dz
                dh, dc = dz @ again.T, dc * f
            grad[f"in_{side}"], grad[f"re_{side}"] = g_in, g_re
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Tagger":
        rng = np.random.default_rng(9)
        one = {k: np.zeros_like(v) for k, v in self.weights.items()}
        two = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, STEPS + 1):
            rows = rng.choice(len(x), min(BATCH, len(x)), replace=False)
            grad = self._gradients(x[rows], y[rows])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                one[k] += 0.1 * (g - one[k])
                two[k] += 0.01 * (g * g - two[k])
                self.weights[k] -= rate * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.99 ** step)) + 1e-8)
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most probable tags (row, time) of every window."""
        _, score = self.emissions(x)
        steps, n, _ = score.shape
        move = self._moves()
        back = np.empty(score.shape, np.int8)
        best = score[0] + np.where(self.first, 0, -1e4).astype(np.float32)
        for t in range(1, steps):
            v = best[:, :, None] + move
            back[t] = v.argmax(axis=1)
            best = score[t] + v.max(axis=1)
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags
