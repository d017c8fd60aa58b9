"""A gated recurrent language model in numpy with a class-factored softmax.

Words are numbered by frequency; the last number stands for every rarer word.  The next word is predicted as
its class and then itself within the class; rarer words are a class of their own, shared out outside the model.
Several texts run side by side in lanes; the state passes from window to window and is cleared where a
text begins.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
CLASSES = 32
STEPS = 32
RATE = 0.1
BOUND = 60.0
#: States whose words are looked up together, and columns of logits that stay in a core's cache.
TOGETHER = 32768
BLOCK = 1024


def classes(counts: np.ndarray, n: int = CLASSES) -> np.ndarray:
    """First word of each class (and the end): equal shares of the square roots of the counts."""
    if not len(counts):
        return np.zeros(1, np.int64)
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1)))
    cut = np.searchsorted(mass, mass[-1] * np.arange(1, n) / n, side="left") + 1
    return np.unique(np.concatenate([[0], np.minimum(cut, len(counts)), [len(counts)]]))


def initial(words: int, n_classes: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {"embed": draw(words + 1, hidden), "wx": draw(hidden, 3 * hidden), "wh": draw(hidden, 3 * hidden),
            "b": np.zeros(3 * hidden, np.float32), "wc": draw(hidden, n_classes + 1), "bc": np.zeros(n_classes + 1, np.float32),
            "ww": draw(words, hidden), "bw": np.zeros(words, np.float32)}


def _with_one(states: np.ndarray) -> np.ndarray:
    """A one behind each state, which takes the bias."""
    return np.concatenate([states, np.ones((len(states), 1), states.dtype)], 1)


def _logits(w: np.ndarray, states: np.ndarray, far: bool) -> np.ndarray:
    """A column for each state; if they can be ``far``, logits count up to a bound that no exponential overflows at."""
    out = w @ states.T
    if far:
        np.clip(out, -BOUND, BOUND, out=out)
    return out


def _error(logits: np.ndarray, place: np.ndarray, scale: float) -> np.ndarray:
    """Probabilities less one at the place of each column's target, times ``scale``; in place."""
    np.exp(logits, out=logits)
    logits *= scale / logits.sum(0)
    logits[place, np.arange(len(place))] -= scale
    return logits


def _log_softmax(logits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The log probability of one place in each column."""
    own = logits[place, np.arange(len(place))]
    return own - np.log(np.exp(logits, out=logits).sum(0))


def lanes(lengths: np.ndarray, width: int) -> list[np.ndarray]:
    """Texts for each lane, longest first onto the shortest lane."""
    import heapq
    load = [(0, k) for k in range(width)]
    out: list[list[int]] = [[] for _ in range(width)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(load)
        out[k].append(i)
        heapq.heappush(load, (n + int(lengths[i]), k))
    return [np.array(x, np.int64) for x in out]


def _parts(w: np.ndarray) -> np.ndarray:
    """Reset gate, update gate and new state apart."""
    return np.ascontiguousarray(w.reshape(len(w), 3, -1).transpose(1, 0, 2))


def _joined(parts: np.ndarray) -> np.ndarray:
    return parts.transpose(1, 0, 2).reshape(parts.shape[1], -1)


class Model:
    def __init__(self, weights: dict[str, np.ndarray], starts: np.ndarray) -> None:
        self.w, self.starts = weights, starts
        self.words = len(weights["ww"])
        self.of = (np.searchsorted(starts, np.arange(self.words + 1), side="right") - 1).astype(np.int16)  # class of each word
        self.of[self.words] = len(starts) - 1  # the rarer words
        self.projected: np.ndarray | None = None

    def _inputs(self) -> np.ndarray:
        """What each word adds to the two gates, halved as their tanh takes it, and to the new state."""
        table = self.w["embed"] @ self.w["wx"] + self.w["b"]
        table = np.ascontiguousarray(table.reshape(len(table), 3, -1).transpose(1, 0, 2))
        table[:2] *= table.dtype.type(0.5)
        return table

    def _run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False
             ) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
        """States for ``x`` (steps x lanes of inputs); ``fresh`` marks texts' first inputs.  Kept for learning:
        the states before each step, twice the gates, the new states, half of what the reset gate meets."""
        steps, size = len(x), h.shape[1]
        half = h.dtype.type(0.5)
        wh = _parts(self.w["wh"]) * half
        table = self._inputs() if self.projected is None else self.projected
        to_gates, to_new = table[:2].take(x, 1), table[2].take(x, 0)
        shape = (*x.shape, size)
        states, rows = np.empty(shape, h.dtype), steps if keep else 1  # without ``keep`` one step's room serves all
        before = np.empty(shape, h.dtype) if keep else None
        gates = np.empty((2, rows, *shape[1:]), h.dtype)
        news, products = np.empty((rows, *shape[1:]), h.dtype), np.empty((rows, *shape[1:]), h.dtype)
        begins = fresh.any(1).tolist()
        for t in range(steps):
            if begins[t]:
                h = np.where(fresh[t][:, None], half * 0, h)
            k = t if keep else 0
            g, n, product = gates[:, k], news[k], products[k]
            np.matmul(h, wh[:2], out=g)
            g += to_gates[:, t]
            np.tanh(g, out=g)
            g += 1
            np.matmul(h, wh[2], out=product)
            np.multiply(g[0], product, out=n)
            n += to_new[t]
            np.tanh(n, out=n)
            if keep:
                before[t] = h
            h = np.subtract(h, n, out=states[t])
            h *= g[1]
            h *= half
            h += n
        return states, (before, gates, news, products), h

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Order of rows by class of their target, and where each class begins (and the last ends)."""
        of = self.of.take(target)
        order = np.argsort(of, kind="stable")
        return order, np.searchsorted(of[order], np.arange(len(self.starts) + 1, dtype=of.dtype)).tolist()

    def _outputs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights and bias of each class and of each word, and whether logits of such states can pass the bound."""
        w = self.w
        by_class, by_word = np.vstack([w["wc"], w["bc"]]).T, np.hstack([w["ww"], w["bw"][:, None]])
        reach = np.abs(states).max(initial=0)
        most = max(np.abs(x).sum(1).max(initial=0) for x in (by_class, by_word))
        return by_class, by_word, not reach * most <= BOUND

    def log_probs(self, hs: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target (of the class alone for rarer words)."""
        order, edges = self._by_class(target)
        hs, target = _with_one(hs.take(order, 0)), target.take(order)
        of = self.of.take(target)
        by_class, by_word, far = self._outputs(hs)
        logs = np.empty(len(order))
        for low in range(0, len(order), BLOCK):
            rows = slice(low, low + BLOCK)
            logs[rows] = _log_softmax(_logits(by_class, hs[rows], far), of[rows])
        for c in range(len(self.starts) - 1):
            rows, a, b = slice(edges[c], edges[c + 1]), self.starts[c], self.starts[c + 1]
            if edges[c + 1] > edges[c]:
                logs[rows] += _log_softmax(_logits(by_word[a:b], hs[rows], far), target[rows] - a)
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def score(self, texts: list[np.ndarray], first: int, width: int = 1024) -> np.ndarray:
        """Natural log probability of every whole text; ``first`` is the word before each text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        total = np.zeros(len(texts))
        if not lengths.sum():
            return total
        self.projected = self._inputs()
        width = int(max(1, min(width, len(texts), lengths.sum() // max(lengths.max(), 1) + 1)))
        plan = lanes(lengths, width)
        depth = max(int(lengths[p].sum()) for p in plan)
        x = np.full((width, depth), self.words, np.int32)
        y = np.full((width, depth), -1, np.int32)
        fresh, owner = np.zeros((width, depth), bool), np.zeros((width, depth), np.int32)
        for k, ids in enumerate(plan):
            at = 0
            for i in ids.tolist():
                n = len(texts[i])
                x[k, at] = first
                x[k, at + 1:at + n] = texts[i][:-1]
                y[k, at:at + n] = texts[i]
                owner[k, at:at + n] = i
                if n:
                    fresh[k, at] = True
                at += n
        h = np.zeros((width, self.w["wh"].shape[0]), np.float32)
        steps = max(STEPS, TOGETHER // width)  # nothing is learnt here, so longer windows give the same
        for t in range(0, depth, steps):
            window = slice(t, t + steps)
            hs, _, h = self._run(x[:, window].T, fresh[:, window].T, h)
            target = y[:, window].T.ravel()
            real = np.flatnonzero(target >= 0)
            logs = self.log_probs(hs.reshape(-1, hs.shape[2])[real], target[real])
            total += np.bincount(owner[:, window].T.ravel()[real], weights=logs, minlength=len(texts))
        return total

    def fit(self, texts: list[np.ndarray], first: int, width: int = 64, steps: int = STEPS, rate: float = RATE,
            squares: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """One pass of truncated backpropagation over all texts; the weights change in place."""
        squares = squares or {k: np.full_like(v, 1e-3) for k, v in self.w.items()}
        texts = [t for t in texts if len(t)]
        if not texts:
            return squares
        y = np.concatenate(texts)
        x = np.concatenate([[first], y[:-1]])
        begin = np.cumsum([0, *[len(t) for t in texts[:-1]]])
        x[begin] = first
        fresh = np.zeros(len(y), bool)
        fresh[begin] = True
        width = int(max(1, min(width, len(y) // steps)))
        depth = -(-len(y) // width)  # lanes are equal parts of the row of texts; the last may end early
        pad = width * depth - len(y)
        x, y = np.append(x, np.full(pad, self.words)).reshape(width, depth), np.append(y, np.full(pad, -1)).reshape(width, depth)
        fresh = np.append(fresh, np.zeros(pad, bool)).reshape(width, depth)
        h = np.zeros((width, self.w["wh"].shape[0]), np.float32)
        self.projected = None
        for t in range(0, depth, steps):
            window = slice(t, t + steps)
            h = self._learn(x[:, window].T, y[:, window].T, fresh[:, window].T, h, rate, squares)
        return squares

    def _learn(self, x, y, fresh, h, rate, squares) -> np.ndarray:
        w, size = self.w, h.shape[1]
        hs, (before, gates, n, product), last = self._run(x, fresh, h, keep=True)
        flat, target = hs.reshape(-1, size), y.ravel()
        real = np.flatnonzero(target >= 0)
        order, edges = self._by_class(target[real])
        real = real[order]
        own, target = _with_one(flat.take(real, 0)), target.take(real)
        by_class, by_word, far = self._outputs(own)
        scale, grad = h.dtype.type(1 / max(1, len(real))), {}
        error = _error(_logits(by_class, own, far), self.of.take(target), scale)
        of_class, of_word = error @ own, np.zeros_like(by_word)
        of_own = error.T @ by_class[:, :size]
        for c in range(len(self.starts) - 1):
            rows, a, b = slice(edges[c], edges[c + 1]), self.starts[c], self.starts[c + 1]
            if edges[c + 1] > edges[c]:
                error = _error(_logits(by_word[a:b], own[rows], far), target[rows] - a, scale)
                of_word[a:b] = error @ own[rows]
                of_own[rows] += error.T @ by_word[a:b, :size]
        grad["wc"], grad["bc"] = of_class[:, :size].T, of_class[:, size]
        grad["ww"], grad["bw"] = of_word[:, :size], of_word[:, size]
        back = np.zeros_like(flat)
        back[real] = of_own
        back = back.reshape(hs.shape)
        # what doesn't depend on the error that comes from later steps is taken for the whole window
        gates *= h.dtype.type(0.5)
        r, z = gates
        to_n = (1 - z) * (1 - n * n)
        share = np.empty((3, *hs.shape), h.dtype)  # of the error at a state, that at the gates and at what the reset gate meets
        share[0] = to_n * (2 * product) * (r * (1 - r))
        share[1] = (before - n) * (z * (1 - z))
        share[2] = to_n * r
        down, wh_t, begins = np.zeros_like(h), _parts(w["wh"]).transpose(0, 2, 1).copy(), fresh.any(1).tolist()
        onward = np.empty((3, *h.shape), h.dtype)
        for t in range(len(x) - 1, -1, -1):
            back[t] += down
            share[:, t] *= back[t]
            np.matmul(share[:, t], wh_t, out=onward)
            down = back[t] * z[t]
            down += onward[0]
            down += onward[1]
            down += onward[2]
            if begins[t]:
                down[fresh[t]] = 0
        dg = share.reshape(3, -1, size)
        grad["wh"] = _joined(before.reshape(-1, size).T @ dg)
        np.multiply(back, to_n, out=share[2])
        ids, wx_t = x.ravel(), _parts(w["wx"]).transpose(0, 2, 1)
        grad["wx"], grad["b"] = _joined(w["embed"].take(ids, 0).T @ dg), (np.ones(len(ids), h.dtype) @ dg).ravel()
        rows = (dg[0] @ wx_t[0] + dg[1] @ wx_t[1] + dg[2] @ wx_t[2]).T.astype(np.float64)
        grad["embed"] = np.stack([np.bincount(ids, weights=c, minlength=len(w["embed"])) for c in rows], 1).astype(h.dtype)
        for k, g in grad.items():
            squares[k] += g * g
            w[k] -= rate * g / np.sqrt(squares[k])
        return last
