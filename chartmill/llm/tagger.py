"""A character-level bidirectional LSTM with a conditional random field, in numpy.

Sequences are windows of equal length; all arrays are (time, window, ...), and both directions run side by side: the
second sees its windows from their ends.  The network is small: its inputs are character shapes, not characters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

HIDDEN = 16
EMBED = 8


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Tagger:
    shapes: int
    tags: int
    seed: int = 11
    kind: type = np.float32
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng, h = np.random.default_rng(self.seed), HIDDEN
        gate = np.zeros((2, 4 * h))
        gate[:, h : 2 * h] = 1  # gates are input, forget, output, new
        made = {
            "embed": rng.normal(0, 0.3, (self.shapes, EMBED)), "out": rng.normal(0, 0.3, (2 * h, self.tags)), "bias": np.zeros(self.tags), "move": np.zeros((self.tags, self.tags)),
            "x": rng.normal(0, 0.3, (2, EMBED, 4 * h)), "h": rng.normal(0, 0.2, (2, h, 4 * h)), "g": gate,
        }
        self.weights = {name: w.astype(self.kind) for name, w in made.items()}

    def scores(self, shapes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Score of each tag at each place; keep gets what the gradient needs."""
        w, h = self.weights, HIDDEN
        steps, n = shapes.shape
        seen = np.stack([shapes, shapes[::-1]])
        x = w["embed"][seen]
        into = x @ w["x"][:, None] + w["g"][:, None, None]
        state, cell = np.zeros((2, n, h), self.kind), np.zeros((2, n, h), self.kind)
        out, trace = np.empty((2, steps, n, h), self.kind), []
        for t in range(steps):
            z = into[:, t] + state @ w["h"]
            gates, new = sigmoid(z[:, :, : 3 * h]), np.tanh(z[:, :, 3 * h :])
            before, last = cell, state
            cell = gates[:, :, h : 2 * h] * cell + gates[:, :, :h] * new
            curve = np.tanh(cell)
            state = gates[:, :, 2 * h :] * curve
            out[:, t] = state
            if keep is not None:
                trace.append((gates, new, before, curve, last))
        states = np.concatenate([out[0], out[1, ::-1]], axis=2)
        if keep is not None:
            keep |= {"seen": seen, "x": x, "states": states, "trace": trace}
        return states @ w["out"] + w["bias"]

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each tag at each place, of each pair of neighbouring tags, summed over places and windows,
        and the log of each window's sum over all tag sequences; forward and backward sums are scaled place by place."""
        steps, n, k = scores.shape
        move = np.exp(self.weights["move"])
        top = scores.max(axis=2, keepdims=True)
        odds = np.exp(scores - top)
        a, b, scale = np.empty_like(scores), np.ones_like(scores), np.empty((steps, n, 1), scores.dtype)
        for t in range(steps):
            a[t] = odds[t] if t == 0 else (a[t - 1] @ move) * odds[t]
            scale[t] = a[t].sum(axis=1, keepdims=True)
            a[t] /= scale[t]
        ahead = np.empty_like(scores)
        for t in range(steps - 1, 0, -1):
            ahead[t] = odds[t] * b[t] / scale[t]
            b[t - 1] = ahead[t] @ move.T
        pairs = np.einsum("tni,tnj->ij", a[:-1], ahead[1:]) * move
        return a * b, pairs, (np.log(scale) + top).sum(axis=(0, 2))

    def gradient(self, shapes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradient."""
        keep: dict = {}
        scores = self.scores(shapes, keep)
        w, h = self.weights, HIDDEN
        steps, n, k = scores.shape
        likely, pairs, whole = self.marginals(scores)
        truth = np.eye(k, dtype=self.kind)[tags]
        d_scores = (likely - truth) / n
        gold = (scores * truth).sum() + w["move"][tags[:-1], tags[1:]].sum()
        grad = {"move": (pairs - np.einsum("tni,tnj->ij", truth[:-1], truth[1:])) / n, "out": np.einsum("tnh,tnk->hk", keep["states"], d_scores), "bias": d_scores.sum(axis=(0, 1))}
        d_states = d_scores @ w["out"].T
        part = np.stack([d_states[:, :, :h], d_states[::-1, :, h:]])
        d_h, d_c = np.zeros((2, n, h), self.kind), np.zeros((2, n, h), self.kind)
        d_z, lasts = np.empty((2, steps, n, 4 * h), self.kind), np.empty((2, steps, n, h), self.kind)
        back = w["h"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            gates, new, before, curve, lasts[:, t] = keep["trace"][t]
            i, f, o = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            d_h = d_h + part[:, t]
            d_c = d_c + d_h * o * (1 - curve**2)
            d_z[:, t, :, : 3 * h] = np.concatenate([d_c * new, d_c * before, d_h * curve], axis=2) * gates * (1 - gates)
            d_z[:, t, :, 3 * h :] = d_c * i * (1 - new**2)
            d_h, d_c = d_z[:, t] @ back, d_c * f
        flat = lambda v: v.reshape(2, steps * n, -1)
        grad |= {"x": flat(keep["x"]).transpose(0, 2, 1) @ flat(d_z), "h": flat(lasts).transpose(0, 2, 1) @ flat(d_z), "g": d_z.sum(axis=(1, 2))}
        d_x = flat(d_z @ w["x"].transpose(0, 2, 1)[:, None])
        one_hot = np.eye(self.shapes, dtype=self.kind)[keep["seen"]].reshape(2, steps * n, -1)
        grad["embed"] = (one_hot.transpose(0, 2, 1) @ d_x).sum(axis=0)
        return float((whole.sum() - gold) / n), grad

    def train(self, shapes: np.ndarray, tags: np.ndarray, steps: int = 900, batch: int = 64, rate: float = 0.02) -> list[float]:
        """So many Adam steps over windows (a row each), whatever their number; returns the loss of each step."""
        first, second, losses = {}, {}, []
        rng, order = np.random.default_rng(self.seed), np.zeros(0, np.int64)
        for step in range(1, steps + 1 if len(shapes) else 1):
            while len(order) < min(batch, len(shapes)):
                order = np.append(order, rng.permutation(len(shapes)))
            rows, order = order[:batch], order[batch:]
            loss, grad = self.gradient(shapes[rows].T, tags[rows].T)
            losses.append(loss)
            norm = max(1.0, np.sqrt(sum(float((g**2).sum()) for g in grad.values())) / 5)
            slower = rate * min(1.0, 2 - 2 * step / steps)  # falls over the second half
            for name, g in grad.items():
                g = g / norm
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.99 * second.get(name, 0) + 0.01 * g**2
                self.weights[name] = (self.weights[name] - slower * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(self.kind)
        return losses

    def decode(self, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window (a row each), and the marginal probability of each of them."""
        scores = self.scores(shapes.T)
        steps, n, _ = scores.shape
        best, back = scores[0], np.zeros(scores.shape, np.int8)
        for t in range(1, steps):
            through = best[:, :, None] + self.weights["move"]
            back[t] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[t]
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None], axis=1)[:, 0]
        sure = np.take_along_axis(self.marginals(scores)[0], tags[:, :, None], axis=2)[:, :, 0]
        return tags.T, sure.T
