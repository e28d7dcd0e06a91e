"""A character-level bidirectional LSTM with a CRF over its tags, in numpy."""

from __future__ import annotations

import numpy as np

_FAR = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    """Tags sequences of character ids; id 0 is padding and only stands at the end."""

    def __init__(self, n_ids: int, n_tags: int, allowed: np.ndarray, starts: np.ndarray, embed: int = 16, hidden: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)

        def made(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.hidden = hidden
        self.forbidden = np.where(allowed, 0.0, _FAR)
        self.not_first = np.where(starts, 0.0, _FAR)
        self.p = {
            "embed": rng.normal(0, 0.3, (n_ids, embed)),
            "out": made(2 * hidden, n_tags),
            "out_bias": np.zeros(n_tags),
            "moves": np.zeros((n_tags, n_tags)),
            "first": np.zeros(n_tags),
        }
        for d in "lr":
            self.p[f"{d}_in"] = made(embed, 4 * hidden)
            self.p[f"{d}_state"] = made(hidden, 4 * hidden)
            self.p[f"{d}_bias"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction; x is (time, batch, embed) in the order that is read."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), x.dtype)
        c, states, saved = h.copy(), np.zeros((*x.shape[:2], n), x.dtype), []
        inputs = x @ self.p[f"{d}_in"] + self.p[f"{d}_bias"]
        for t in range(len(x)):
            a = inputs[t] + h @ self.p[f"{d}_state"]
            gates, new = _sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            if keep:
                saved.append((i, f, o, new, c, h))
            c = (f * c + i * new) * mask[t]
            h = o * np.tanh(c) * mask[t]
            states[t] = h
            if keep:
                saved[-1] += (c,)
        return states, saved

    def _lstm_back(self, x, mask, d, saved, slope, grads):
        n = self.hidden
        back_h = np.zeros_like(slope[0])
        back_c, out = np.zeros_like(back_h), np.zeros_like(x)
        state = self.p[f"{d}_state"]
        for t in range(len(x) - 1, -1, -1):
            i, f, o, new, c_before, h_before, c = saved[t]
            dh = (slope[t] + back_h) * mask[t]
            squashed = np.tanh(c)
            dc = (back_c + dh * o * (1 - squashed**2)) * mask[t]
            a = np.concatenate(
                [dc * new * i * (1 - i), dc * c_before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1
            )
            grads[f"{d}_in"] += x[t].T @ a
            grads[f"{d}_state"] += h_before.T @ a
            grads[f"{d}_bias"] += a.sum(0)
            out[t] = a @ self.p[f"{d}_in"].T
            back_h, back_c = a @ state.T, dc * f
        return out

    def _states(self, ids: np.ndarray, keep: bool = False):
        mask = (ids > 0).T[:, :, None].astype(self.p["embed"].dtype)
        x = self.p["embed"][ids.T]
        left, saved_l = self._lstm(x, mask, "l", keep)
        right, saved_r = self._lstm(x[::-1], mask[::-1], "r", keep)
        both = np.concatenate([left, right[::-1]], axis=2)
        return x, mask, both, saved_l, saved_r

    def _emissions(self, both: np.ndarray) -> np.ndarray:
        return both @ self.p["out"] + self.p["out_bias"]

    def _forward(self, scores: np.ndarray, mask: np.ndarray):
        """Log sums of paths up to each place, and from each place on, and over all."""
        moves, first = self.p["moves"] + self.forbidden, self.p["first"] + self.not_first
        n_steps = len(scores)
        ahead = np.zeros_like(scores)
        ahead[0] = first + scores[0]
        for t in range(1, n_steps):
            new = _logsumexp(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
            ahead[t] = np.where(mask[t] > 0, new, ahead[t - 1])
        behind = np.zeros_like(scores)
        for t in range(n_steps - 2, -1, -1):
            new = _logsumexp(moves + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
            behind[t] = np.where(mask[t + 1] > 0, new, behind[t + 1])
        return ahead, behind, _logsumexp(ahead[-1], 1)

    def train(self, ids: np.ndarray, tags: np.ndarray, rounds: int, batch: int = 48, rate: float = 0.02, seed: int = 1) -> None:
        """Maximise the likelihood of the tags with Adam; rows are windows of equal length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.zeros(0, np.int64)
        for step in range(1, rounds + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(ids))])
            some, order = order[:batch], order[batch:]
            grads = self._gradients(ids[some], tags[some])
            size = np.sqrt(sum((g**2).sum() for g in grads.values()))
            pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g**2 - second[k])
                self.p[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _gradients(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        x, mask, both, saved_l, saved_r = self._states(ids, keep=True)
        scores = self._emissions(both)
        ahead, behind, total = self._forward(scores, mask)
        n = ids.shape[0]
        seen = np.eye(scores.shape[2])[tags.T]
        slope = (np.exp(ahead + behind - total[:, None]) - seen) * mask / n
        grads["first"] += slope[0].sum(0)
        moves = self.p["moves"] + self.forbidden
        for t in range(1, len(scores)):
            pair = ahead[t - 1][:, :, None] + moves + (scores[t] + behind[t])[:, None, :] - total[:, None, None]
            pair = np.exp(pair) - seen[t - 1][:, :, None] * seen[t][:, None, :]
            grads["moves"] += (pair * mask[t][:, :, None]).sum(0) / n
        grads["out"] += np.einsum("tbh,tbk->hk", both, slope)
        grads["out_bias"] += slope.sum((0, 1))
        back = slope @ self.p["out"].T
        left = self._lstm_back(x, mask, "l", saved_l, back[:, :, : self.hidden], grads)
        right = self._lstm_back(x[::-1], mask[::-1], "r", saved_r, back[::-1, :, self.hidden :], grads)
        np.add.at(grads["embed"], ids.T, left + right[::-1])
        grads["embed"][0] = 0
        return grads

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window and, of each tag, its probability."""
        _, mask, both, _, _ = self._states(ids)
        scores = self._emissions(both).astype(np.float64)
        ahead, behind, total = self._forward(scores, mask)
        moves = self.p["moves"] + self.forbidden
        best = self.p["first"] + self.not_first + scores[0]
        came = []
        for t in range(1, len(scores)):
            step = best[:, :, None] + moves
            choice = step.argmax(1)
            inside = mask[t] > 0
            came.append(np.where(inside, choice, np.arange(choice.shape[1])))
            best = np.where(inside, step.max(1) + scores[t], best)
        tags = np.zeros(ids.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(len(ids))
        for t in range(len(scores) - 2, -1, -1):
            tags[:, t] = came[t][rows, tags[:, t + 1]]
        shares = np.exp(ahead + behind - total[:, None])
        return tags, np.take_along_axis(shares.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0]
