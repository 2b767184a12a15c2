"""A character-level bidirectional LSTM with CRF transitions in numpy: training, and Viterbi decoding in batches."""

from __future__ import annotations

import numpy as np


def char_classes() -> np.ndarray:
    """Class of each code point below 128: digits, hex letters and other letters by case, marks one by one."""
    out = np.full(128, 2, np.int64)  # controls
    out[[9, 10, 11, 12, 13, 32]] = 3
    out[48:58], out[97:103], out[103:123], out[65:71], out[71:91] = 4, 5, 6, 7, 8
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[marks] = 9 + np.arange(len(marks))
    return out


#: Classes 0 and 1: beyond the text's ends, beyond ASCII.
_ASCII = char_classes()
CLASSES = int(_ASCII.max()) + 1


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    """Tags of windows of characters; ``fit`` trains on (windows, tags), ``decode`` gives the best tag sequences."""

    def __init__(self, tags: int, width: int = 12, hidden: int = 20, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"E": make(CLASSES, width), "O": make(2 * hidden, tags), "o": np.zeros(tags, np.float32),
                  "T": np.zeros((tags, tags), np.float32), "S": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {"X" + d: make(width, 4 * hidden), "H" + d: make(hidden, 4 * hidden),
                       "c" + d: np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}

    def _lstm(self, x, d, keep):
        steps, batch, n = x.shape[0], x.shape[1], self.hidden
        gates = x @ self.p["X" + d] + self.p["c" + d]
        h = np.zeros((steps + 1, batch, n), np.float32)
        c = np.zeros_like(h)
        acts = np.empty((steps, batch, 4 * n), np.float32) if keep else None
        for t in range(steps):
            g = gates[t] + h[t] @ self.p["H" + d]
            g[:, :3 * n] = _sigmoid(g[:, :3 * n])
            g[:, 3 * n:] = np.tanh(g[:, 3 * n:])
            c[t + 1] = g[:, :n] * g[:, 3 * n:] + g[:, n:2 * n] * c[t]
            h[t + 1] = g[:, 2 * n:3 * n] * np.tanh(c[t + 1])
            if keep:
                acts[t] = g
        return h, c, acts

    def _lstm_grad(self, x, d, state, dh_out, grads):
        h, c, acts = state
        n, steps = self.hidden, len(x)
        dg = np.empty_like(acts)
        dh, dc = np.zeros_like(h[0]), np.zeros_like(c[0])
        for t in range(steps - 1, -1, -1):
            i, f, o, g = (acts[t][:, k * n:(k + 1) * n] for k in range(4))
            dh = dh + dh_out[t]
            tc = np.tanh(c[t + 1])
            dc = dc + dh * o * (1 - tc * tc)
            dg[t] = np.concatenate((dc * g * i * (1 - i), dc * c[t] * f * (1 - f), dh * tc * o * (1 - o),
                                    dc * i * (1 - g * g)), 1)
            dh, dc = dg[t] @ self.p["H" + d].T, dc * f
        flat = dg.reshape(-1, 4 * n)
        grads["X" + d] = x.reshape(-1, x.shape[2]).T @ flat
        grads["H" + d] = h[:-1].reshape(-1, n).T @ flat
        grads["c" + d] = flat.sum(0)
        return dg @ self.p["X" + d].T

    def _scores(self, windows, keep=False):
        x = self.p["E"][windows.T]
        f, b = self._lstm(x, "f", keep), self._lstm(x[::-1], "b", keep)
        both = np.concatenate((f[0][1:], b[0][1:][::-1]), 2)
        return x, f, b, both, both @ self.p["O"] + self.p["o"]

    def step(self, windows, tags) -> tuple[float, dict]:
        """Mean negative log-likelihood of a batch, and its gradients."""
        p, (x, f, b, both, e) = self.p, self._scores(windows, True)
        steps, batch, k = e.shape
        up, down = np.empty_like(e), np.zeros_like(e)
        up[0] = e[0] + p["S"]
        for t in range(1, steps):
            up[t] = e[t] + _logsum(up[t - 1][:, :, None] + p["T"], 1)
        for t in range(steps - 2, -1, -1):
            down[t] = _logsum(p["T"] + (e[t + 1] + down[t + 1])[:, None, :], 2)
        z = _logsum(up[-1], 1)
        node = np.exp(up + down - z[None, :, None])
        pair = np.exp(up[:-1, :, :, None] + p["T"] + (e[1:] + down[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        gold, rows = tags.T, np.arange(batch)
        score = p["S"][gold[0]] + np.take_along_axis(e, gold[:, :, None], 2)[:, :, 0].sum(0) + p["T"][gold[:-1], gold[1:]].sum(0)
        seen = np.zeros_like(p["T"])
        np.add.at(seen, (gold[:-1], gold[1:]), 1)
        de = node
        np.put_along_axis(de, gold[:, :, None], np.take_along_axis(de, gold[:, :, None], 2) - 1, 2)
        grads = {"T": pair - seen, "S": de[0].sum(0), "o": de.sum((0, 1)),
                 "O": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, k)}
        dboth = de @ p["O"].T
        n = self.hidden
        dx = self._lstm_grad(x, "f", f, dboth[:, :, :n], grads)
        dx = dx + self._lstm_grad(x[::-1], "b", b, dboth[::-1, :, n:], grads)[::-1]
        grads["E"] = np.zeros_like(p["E"])
        np.add.at(grads["E"], windows.T, dx)
        return float((z - score).mean()), {key: g / batch for key, g in grads.items()}

    def fit(self, windows, tags, turns: int = 260, batch: int = 48, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam on random batches, the rate falling to a tenth; returns the losses."""
        rng, m, v, losses = np.random.default_rng(seed), {}, {}, []
        for turn in range(1, turns + 1):
            rows = rng.integers(0, len(windows), batch)
            loss, grads = self.step(windows[rows], tags[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for key, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[key] = 0.9 * m.get(key, 0) + 0.1 * g
                v[key] = 0.99 * v.get(key, 0) + 0.01 * g * g
                move = m[key] / (1 - 0.9 ** turn) / (np.sqrt(v[key] / (1 - 0.99 ** turn)) + 1e-8)
                self.p[key] = (self.p[key] - rate * (1 - 0.9 * turn / turns) * move).astype(np.float32)
        return losses

    def decode(self, windows, batch: int = 1024) -> np.ndarray:
        """Viterbi: the best tags of each window."""
        out = np.zeros(windows.shape, np.int64)
        for lo in range(0, len(windows), batch):
            e = self._scores(windows[lo:lo + batch])[4]
            best, back = e[0] + self.p["S"], []
            for t in range(1, len(e)):
                ways = best[:, :, None] + self.p["T"]
                back.append(ways.argmax(1))
                best = np.take_along_axis(ways, back[-1][:, None, :], 1)[:, 0] + e[t]
            tag = best.argmax(1)
            out[lo:lo + batch, -1] = tag
            for t in range(len(e) - 2, -1, -1):
                tag = np.take_along_axis(back[t], tag[:, None], 1)[:, 0]
                out[lo:lo + batch, t] = tag
        return out
