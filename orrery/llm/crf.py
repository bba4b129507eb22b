"""A linear-chain conditional random field over hashed binary features, in numpy batches.

Sequences are laid side by side, longest first, and every step advances all sequences that
are still running, so the cost is that of a few array operations for each position.
"""

from __future__ import annotations

import numpy as np

LONGEST = 128
FIT_TOKENS = 1 << 16


def sequences(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths from a mask of first tokens; a run of over LONGEST tokens is cut."""
    start = np.flatnonzero(breaks)
    if not len(start):
        return start, start
    length = np.diff(np.append(start, len(breaks)))
    many = -(-length // LONGEST)
    inner = np.arange(many.sum()) - np.repeat(np.append(0, np.cumsum(many)[:-1]), many)
    start = np.repeat(start, many) + inner * LONGEST
    return start, np.diff(np.append(start, len(breaks)))


class Chain:
    """Weights: emission (features, states), transition (states, states), opening (states)."""

    def __init__(self, features: int, states: int):
        self.emission = np.zeros((features, states))
        self.transition = np.zeros((states, states))
        self.opening = np.zeros(states)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """ids (tokens, features of a token) -> (tokens, states)."""
        total = self.emission[ids[:, 0]].copy()
        for k in range(1, ids.shape[1]):
            total += self.emission[ids[:, k]]
        return total

    def marginals(self, scores: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward-backward: P(state) of each token, expected transitions, log partition sum."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        top = scores.max(axis=1, keepdims=True)
        local = np.exp(scores - top)
        step = np.exp(self.transition)
        forward, scale = np.empty_like(local), np.ones(len(local))
        longest = int(length.max(initial=0))
        count = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        for t in range(longest):
            at = start[: count[t]] + t
            now = local[at] * (np.exp(self.opening) if t == 0 else forward[at - 1] @ step)
            scale[at] = now.sum(axis=1)
            forward[at] = now / scale[at][:, None]
        backward = np.ones_like(local)
        for t in range(longest - 2, -1, -1):
            at = start[: count[t + 1]] + t
            backward[at] = ((local[at + 1] * backward[at + 1]) @ step.T) / scale[at + 1][:, None]
        inside = np.ones(len(scores), dtype=bool)
        inside[start] = False
        at = np.flatnonzero(inside)
        pair = forward[at - 1].T @ (local[at] * backward[at] / scale[at][:, None]) * step
        return forward * backward, pair, float(np.log(scale).sum() + top.sum())

    def decode(self, scores: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Viterbi: the best state of each token."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        best, back = np.empty_like(scores), np.zeros(scores.shape, dtype=np.int8)
        longest = int(length.max(initial=0))
        count = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        for t in range(longest):
            at = start[: count[t]] + t
            if t == 0:
                best[at] = scores[at] + self.opening
                continue
            ways = best[at - 1][:, :, None] + self.transition[None]
            back[at] = ways.argmax(axis=1)
            best[at] = scores[at] + ways.max(axis=1)
        path = np.zeros(len(scores), dtype=np.int8)
        path[start + length - 1] = best[start + length - 1].argmax(axis=1)
        for t in range(longest - 1, 0, -1):
            at = start[: count[t]] + t
            path[at - 1] = back[at, path[at]]
        return path

    def fit(self, ids: np.ndarray, state: np.ndarray, start: np.ndarray, length: np.ndarray, rounds: int = 30, rate: float = 0.5, decay: float = 1e-6) -> Chain:
        """Maximum likelihood by full-batch AdaGrad on tokens with known states."""
        states = len(self.opening)
        first = np.zeros(len(ids), dtype=bool)
        first[start] = True
        seen = np.zeros((states, states))
        at = np.flatnonzero(~first)
        np.add.at(seen, (state[at - 1], state[at]), 1)
        sums = [np.full_like(w, 1e-8) for w in (self.emission, self.transition, self.opening)]
        n = max(1, len(start))
        # a bounded number of tokens at a time
        size = np.cumsum(length)
        edge = np.unique(np.append(0, np.searchsorted(size, np.arange(FIT_TOKENS, int(size[-1]) + FIT_TOKENS, FIT_TOKENS), side="right"))) if len(size) else np.zeros(1, np.int64)
        edge = np.append(edge[edge < len(start)], len(start))
        for _ in range(rounds):
            slope, pairs, opening = np.zeros_like(self.emission), np.zeros_like(self.transition), np.zeros_like(self.opening)
            for a, z in zip(edge[:-1], edge[1:]):
                lo, hi = int(start[a]), int(start[z - 1] + length[z - 1])
                own = ids[lo:hi]
                chance, pair, _ = self.marginals(self.scores(own), start[a:z] - lo, length[a:z])
                off = np.eye(states)[state[lo:hi]] - chance
                for k in range(ids.shape[1]):
                    for s in range(states):
                        slope[:, s] += np.bincount(own[:, k], weights=off[:, s], minlength=len(slope))
                pairs += pair
                opening += off[first[lo:hi]].sum(axis=0)
            slopes = [slope / n - decay * self.emission, (seen - pairs) / n, opening / n]
            for w, s, g in zip((self.emission, self.transition, self.opening), sums, slopes):
                s += g * g
                w += rate * g / np.sqrt(s)
        return self
