"""A linear-chain conditional random field over word shapes, in numpy: batched training and Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gainsieve.llm.common import word_bounds

#: Tags; the first is "nothing". Words without a digit or an at-sign can have no other.
TAGS = ("O", "email", "ip", "card", "phone")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SIGNS = b"@.+-():=_/#$%,;\"'"
#: Kinds of first and last bytes: digit, letter, each sign, anything else.
_EDGE = np.full(256, len(_SIGNS) + 2, np.int64)
_EDGE[_DIGIT], _EDGE[_LETTER] = 0, 1
_EDGE[list(_SIGNS)] = np.arange(2, len(_SIGNS) + 2)
_EDGES = len(_SIGNS) + 3

_DIGIT_STEPS, _LETTER_STEPS, _DOT_STEPS = np.array([1, 2, 3, 4, 5, 7, 8, 10, 12, 13, 16, 17, 20]), np.array([1, 2, 4, 8, 16]), np.array([1, 2, 3, 4, 5])
_OWN = len(_SIGNS) + (len(_DIGIT_STEPS) + 1) + (len(_LETTER_STEPS) + 1) + (len(_DOT_STEPS) + 1) + 2 * _EDGES + 3
_NEAR = 2 * _EDGES + 3
SIZE = _OWN + 2 * _NEAR + 1


def _one_hot(values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(values), size), np.float32)
    out[np.arange(len(values)), values] = 1
    return out


#: Open words whose features are made at a time when a text is decoded.
PIECE_WORDS = 8192


@dataclass
class Words:
    """Words of a block of texts and the ones that may be tagged (open: those with a digit or an at-sign). Their shape features are
    made piece by piece, as they take a thousand times a word's room."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    open: np.ndarray
    digits: np.ndarray  # digits before each byte

    @property
    def x(self) -> np.ndarray:
        return self.features(0, len(self.open))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Features times weights for all open words."""
        parts = [self.features(lo, lo + PIECE_WORDS).astype(np.float64) @ weights for lo in range(0, len(self.open), PIECE_WORDS)]
        return np.concatenate(parts) if parts else np.zeros((0, weights.shape[1]))

    def features(self, lo: int, hi: int) -> np.ndarray:
        """A row of features for each of the open words from lo up to hi."""
        at, starts, ends, data = self.open[lo:hi], self.starts, self.ends, self.data
        n = len(at)
        if not n:
            return np.zeros((0, SIZE), np.float32)
        s, e = starts[at], ends[at]
        # the bytes of these words alone, one after the other
        length = e - s
        first = np.concatenate([[0], np.cumsum(length)])
        flat = data[np.repeat(s - first[:-1], length) + np.arange(first[-1])]

        def count(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask.astype(np.int64), first[:-1])

        digits, letters, dots = count(_DIGIT[flat]), count(_LETTER[flat]), count(flat == 0x2E)
        own = [np.column_stack([count(flat == c) > 0 for c in _SIGNS])]
        own += [_one_hot(np.searchsorted(k, v, side="right"), len(k) + 1) for k, v in ((_DIGIT_STEPS, digits), (_LETTER_STEPS, letters), (_DOT_STEPS, dots))]
        own += [_one_hot(_EDGE[data[s]], _EDGES), _one_hot(_EDGE[data[e - 1]], _EDGES)]
        own += [np.column_stack([digits == length, (digits > 0) & (letters > 0), (digits + dots == length) & (dots == 3)])]

        def near(step: int) -> np.ndarray:
            other = at + step
            there = (other >= 0) & (other < len(starts))
            other = np.where(there, other, 0)
            there &= self.text[other] == self.text[at]
            d = self.digits[ends[other]] - self.digits[starts[other]]
            parts = [_one_hot(_EDGE[data[starts[other]]], _EDGES), _one_hot(_EDGE[data[ends[other] - 1]], _EDGES), np.column_stack([d > 0, d == ends[other] - starts[other]])]
            return np.column_stack([np.column_stack(parts) * there[:, None], ~there])

        return np.column_stack([*own, near(-1), near(1), np.ones(n)]).astype(np.float32)


def _before(mask: np.ndarray) -> np.ndarray:
    """How many are true before each place, and in all."""
    out = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def shapes(data: np.ndarray, off: np.ndarray) -> Words:
    """Words (runs of anything but ASCII white space) of texts."""
    starts, ends, counts = word_bounds(~_SPACE[data], off)
    text = np.repeat(np.arange(len(counts)), counts)
    marks = _before(_DIGIT[data] | (data == 0x40))
    return Words(data, starts, ends, text, np.flatnonzero(marks[ends] > marks[starts]), _before(_DIGIT[data]))


def runs(words: Words) -> np.ndarray:
    """First indexes, into the open words, of runs that follow each other in one text."""
    if not len(words.open):
        return np.zeros(0, np.int64)
    new = np.ones(len(words.open), bool)
    new[1:] = (np.diff(words.open) != 1) | (np.diff(words.text[words.open]) != 0)
    return np.flatnonzero(new)


@dataclass
class Field:
    """Weights of features by tag, and of a tag after a tag. A run of open words stands between two words tagged O."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, words: Words) -> np.ndarray:
        """The best tag of each open word. Runs are independent given the O around them; all are decoded at once, step by step."""
        score = words.scores(self.weights)
        first = runs(words)
        out = np.zeros(len(score), np.int64)
        if not len(first):
            return out
        length = np.diff(np.append(first, len(score)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        back = np.zeros(score.shape, np.int8)
        last = np.zeros((len(first), score.shape[1]))
        best = self.moves[0] + score[first]
        for step in range(1, int(length[0]) + 1):
            live = int(np.searchsorted(-length, -step, side="left"))  # runs longer than step
            last[live : len(best)] = best[live:]
            if not live:
                break
            paths = best[:live, :, None] + self.moves
            at = first[:live] + step
            back[at] = paths.argmax(1)
            best = paths.max(1) + score[at]
        tag = (last + self.moves[:, 0]).argmax(1)
        for step in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -step, side="left"))
            at = first[:live] + step
            out[at] = tag[:live]
            if step:
                tag[:live] = back[at, tag[:live]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(words: Words, tags: np.ndarray, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty over all runs, by Adam on exact gradients (forward and backward sums)."""
    k, x = len(TAGS), words.x
    first = runs(words)
    length = np.diff(np.append(first, len(tags)))
    n, t = len(first), int(length.max(initial=1))
    place = first[:, None] + np.arange(t)
    there = np.arange(t) < length[:, None]
    place = np.where(there, place, 0)
    gold = np.where(there, tags[place] if len(tags) else 0, 0)
    theta = [np.zeros((SIZE, k)), np.zeros((k, k))]
    mean, square = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    one = np.eye(k)
    for r in range(1, rounds + 1 if n else 1):
        w, moves = theta
        # after a run's end the tag is O: the same chain, with only O allowed there, closes every run
        score = np.where(there[..., None], (x @ w)[place], np.where(np.arange(k) == 0, 0.0, -1e9))
        fore, aft = np.empty((t, n, k)), np.empty((t, n, k))
        fore[0] = moves[0] + score[:, 0]
        for i in range(1, t):
            stop = ~there[:, i - 1 : i]  # past the end nothing more is paid
            fore[i] = np.where(stop, fore[i - 1], _log_sum(fore[i - 1][:, :, None] + moves, 1)) + score[:, i]
        aft[t - 1] = np.where(there[:, t - 1 :], moves[:, 0], 0.0)
        for i in range(t - 2, -1, -1):
            aft[i] = np.where(there[:, i : i + 1], _log_sum(moves + (score[:, i + 1] + aft[i + 1])[:, None, :], 2), 0.0 + np.where(np.arange(k) == 0, 0.0, -1e9))
        total = _log_sum(fore[0] + aft[0], 1)
        p = np.exp(fore + aft - total[None, :, None]).transpose(1, 0, 2)
        miss = np.zeros((len(tags), k))
        miss[place[there]] = (one[gold] - p)[there]
        grad_moves = (one[gold[:, 0]] - p[:, 0]).sum(0)[None, :] * one[0][:, None]
        for i in range(t):
            own = there[:, i]
            if i + 1 < t:
                pair = np.exp(fore[i][:, :, None] + moves + (score[:, i + 1] + aft[i + 1])[:, None, :] - total[:, None, None])[own]
                grad_moves += (one[gold[own, i]][:, :, None] * one[gold[own, i + 1]][:, None, :] - pair).sum(0)
            else:
                grad_moves[:, 0] += (one[gold[own, i]] - p[own, i]).sum(0)
        grads = [x.T @ miss / n - ridge * w, grad_moves / n - ridge * moves]
        for j, g in enumerate(grads):
            mean[j] = 0.9 * mean[j] + 0.1 * g
            square[j] = 0.999 * square[j] + 0.001 * g * g
            theta[j] = theta[j] + rate * (mean[j] / (1 - 0.9**r)) / (np.sqrt(square[j] / (1 - 0.999**r)) + 1e-8)
    return Field(*theta)
