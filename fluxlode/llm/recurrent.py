"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state."""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 24
CLASSES = 32
WINDOW = 128
#: Tokens whose classes are told together, so that their logits stay in the cache.
TOGETHER = 1024
#: Rows of a word that are added one by one, and numbers that are moved at once.
SHORT = 8
CACHED = 16384


def classes_of(counts: np.ndarray, classes: int | None = None) -> np.ndarray:
    """Bounds of runs of words, in order of frequency. A class costs every token a column and its own tokens its size,
    so the least is spent if runs have equal sums of the roots of their words' shares; by default they are as many as
    that asks for when a class costs somewhat more than a word."""
    root = np.sqrt(counts / max(counts.sum(), 1))
    classes = max(CLASSES, round(0.6 * root.sum())) if classes is None else classes
    cls = np.minimum((np.cumsum(root) - root / 2) / max(root.sum(), 1e-9) * classes, classes - 1).astype(int)
    return np.r_[0, np.flatnonzero(np.diff(cls)) + 1, len(counts)] if len(counts) else np.zeros(1, int)


def exponentials(logits: np.ndarray, far: bool = True) -> tuple[np.ndarray, np.ndarray | float]:
    """Turns logits into exp(logits - top) in place; (their sums by row, top). top is 0 unless they may be far from it."""
    top: np.ndarray | float = 0.0
    if far:
        top = logits.max(1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype), top


def grouped(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, bounds of their runs, order that makes them runs)."""
    order = np.argsort(words.astype(np.min_scalar_type(words.max(initial=0))), kind="stable")
    words = words[order]
    first = np.r_[0, np.flatnonzero(np.diff(words)) + 1]
    return words[first], np.r_[first, len(words)], order


def sums(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each run of rows: long runs one by one, short ones all together, row after row."""
    size, out = np.diff(bounds), rows.take(bounds[:-1], axis=0)
    for k in np.flatnonzero(size > SHORT):
        out[k] = np.ones(size[k], rows.dtype) @ rows[bounds[k] : bounds[k + 1]]
    left = np.flatnonzero((size > 1) & (size <= SHORT))
    for i in range(1, SHORT):
        out[left] = out.take(left, axis=0) + rows.take(bounds[left] + i, axis=0)
        left = left[size[left] > i + 1]
    return out


def move(p: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray, seen: int, pace: float) -> None:
    """Adam's step in place by the sum g of seen tokens' gradients, in blocks that stay in the cache; g is used up."""
    p, first, second, g = (v.reshape(-1) for v in (p, first, second, np.ascontiguousarray(g)))
    for a in range(0, len(p), CACHED):
        own, m, v, d = (x[a : a + CACHED] for x in (p, first, second, g))
        d *= np.float32(0.1 / seen)
        m *= np.float32(0.9)
        m += d
        d *= d
        d *= np.float32(0.1)
        v *= np.float32(0.999)
        v += d
        np.sqrt(v, out=d)
        d += np.float32(1e-6)
        np.divide(m, d, out=d)
        d *= np.float32(pace)
        own -= d


class Model:
    """Words 0..m-1 are in len(bounds)-1 classes; word m is any other and a class of its own.

    P(word | past) = P(class | state) P(word | class, state). x holds the gates' input for each word; row m+1 is
    the start of a text. All arrays are float32; state and inputs are (lanes, hidden).
    """

    def __init__(self, bounds: np.ndarray, hidden: int = HIDDEN, seed: int = 0, counts: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        m = int(bounds[-1])
        normal = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        self.bounds, self.hidden = bounds, hidden
        self.word_class = np.r_[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), len(bounds) - 1].astype(np.min_scalar_type(len(bounds)))
        self.p = {"x": normal(m + 2, 3 * hidden), "u": normal(hidden, 3 * hidden), "c": normal(hidden, len(bounds)), "cb": np.zeros(len(bounds), np.float32), "w": normal(m, hidden), "wb": np.zeros(m, np.float32)}
        if counts is not None:  # from the words' shares, so that only what depends on the past is left to learn
            share = np.log(counts.astype(float) + 1)
            self.p["wb"] = share[:m].astype(np.float32)
            self.p["cb"] = np.log(np.add.reduceat(np.r_[counts].astype(float) + 1, bounds)).astype(np.float32)

    def steps(self, x: np.ndarray, start: np.ndarray, h: np.ndarray, keep: bool = False):
        """States before each token's prediction: x (t, lanes) are the tokens read, start: the state begins anew.
        keep: also (gates z, r and c, h @ u) of all steps, both (t, 3, lanes, hidden)."""
        n, (many, lanes) = self.hidden, x.shape
        table, u = self.p["x"].reshape(-1, n), np.ascontiguousarray(self.p["u"].reshape(n, 3, n).swapaxes(0, 1))
        u[:2] *= -1  # so that a gate's exponent takes one subtraction
        rows, anew = (x.astype(np.int64) * 3)[:, None] + np.arange(3)[:, None], start.any(1)
        out = np.empty((many, lanes, n), table.dtype)
        gates, inner = (np.empty((many if keep else 1, 3, lanes, n), table.dtype) for _ in range(2))
        for t in range(many):
            if anew[t]:
                h = h * ~start[t][:, None]
            gate, g = (gates[t], inner[t]) if keep else (gates[0], inner[0])
            np.take(table, rows[t], axis=0, out=gate, mode="clip")
            np.matmul(h, u, out=g)
            zr, c, own = gate[:2], gate[2], out[t]
            np.subtract(g[:2], zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c += np.multiply(g[2], zr[1], out=own)
            np.tanh(c, out=c)
            np.subtract(h, c, out=own)
            own *= zr[0]
            own += c
            h = own
        return out, h, (gates, inner)

    def rows_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of classes and of words, each with its bias at the end of its row."""
        p = self.p
        return np.c_[p["c"].T, p["cb"]], np.c_[p["w"], p["wb"]]

    def log_prob(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, rows: tuple | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of tokens y after states h; with grads, puts -log's gradients there and returns that of h.
        rows: what rows_of gives, if it is known."""
        n, (c, w) = self.hidden, rows or self.rows_of()
        cls = self.word_class[y]
        order = np.argsort(cls, kind="stable")  # a class's tokens lie together
        y, cls = y[order], cls[order]
        own = np.ones((len(y), n + 1), np.result_type(h, c))  # a state and 1, for the bias
        own[:, :n] = h
        own = own.take(order, axis=0)
        reach = np.r_[np.full(n, max(h.max(initial=0), -h.min(initial=0))), 1].astype(own.dtype)
        far = not max((np.abs(c) @ reach).max(initial=0), (np.abs(w) @ reach).max(initial=0)) < 60
        logp, dh, of_c, of_w = np.zeros(len(y)), None, None, None
        if grads is not None:
            dh, of_c, of_w = np.empty_like(own), np.zeros_like(c), np.zeros_like(w)

        def choice(at: slice, weights: np.ndarray, chosen: np.ndarray):
            """Of rows `at` one of the weights' rows each: adds the log probability, gives the gradients of own and weights."""
            hk, pick = own[at], (np.arange(len(chosen)), chosen)
            logits = hk @ weights.T
            logp[at] += logits[pick]
            total, top = exponentials(logits, far)
            logp[at] -= np.log(total) + top
            if grads is None:
                return None, None
            logits[pick] -= total  # the gradient times the total, which the small sides are divided by
            by = (1 / total)[:, None]
            back = logits @ weights
            back *= by
            return back, logits.T @ (hk * by)

        for a in range(0, len(y), TOGETHER):
            at = slice(a, a + TOGETHER)
            back, of = choice(at, c, cls[at])
            if grads is not None:
                dh[at] = back
                of_c += of
        edges = np.searchsorted(cls, np.arange(len(self.bounds) + 1))
        for k in np.flatnonzero((np.diff(edges)[: len(self.bounds) - 1] > 0) & (np.diff(self.bounds) > 1)):
            at, lo, hi = slice(edges[k], edges[k + 1]), self.bounds[k], self.bounds[k + 1]
            back, of = choice(at, w[lo:hi], y[at] - lo)
            if grads is not None:
                dh[at] += back
                of_w[lo:hi] = of
        out = np.empty(len(y))
        out[order] = logp
        if grads is None:
            return out, None
        grads |= {"c": of_c[:, :n].T, "cb": of_c[:, n], "w": of_w[:, :n], "wb": of_w[:, n]}
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return out, dh.take(place, axis=0)[:, :n]

    def gradients(self, x: np.ndarray, y: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """(-log probability, its gradients, last state) of a window; backpropagation ends at its first token.
        y < 0: there is no token. The gradient of x is (the words read, their rows)."""
        n, grads, (many, lanes) = self.hidden, {"u": np.zeros_like(self.p["u"])}, x.shape
        states, last, (gates, inner) = self.steps(x, start, h, keep=True)
        real = np.flatnonzero(y.ravel() >= 0)
        logp, dh = self.log_prob(states.reshape(-1, n).take(real, axis=0), y.ravel()[real], grads)
        given = np.zeros_like(states)
        if len(real) == y.size:
            given.reshape(-1, n)[:] = dh
        else:
            given.reshape(-1, n)[real] = dh
        before = np.empty_like(states)
        before[0], before[1:] = h, states[:-1]
        before[start] = 0
        z, r, c = gates[:, 0], gates[:, 1], gates[:, 2]
        slope = np.empty_like(gates)  # of the gates' inputs by the state; c's is that of h @ u
        rest = 1 - z
        new = rest * (1 - c * c)
        np.multiply(before - c, z, out=slope[:, 0])
        slope[:, 0] *= rest
        np.multiply(new, r, out=slope[:, 2])
        np.multiply(slope[:, 2], inner[:, 2], out=slope[:, 1])
        slope[:, 1] *= 1 - r
        u, anew = self.p["u"].reshape(n, 3, n), start.any(1)
        back, d = np.ascontiguousarray(u.transpose(1, 2, 0)), np.zeros_like(given[0])
        for t in range(many - 1, -1, -1):
            d += given[t]
            given[t] = d
            slope[t] *= d
            by = slope[t] @ back
            d *= z[t]
            for g in by:
                d += g
            if anew[t]:
                d *= ~start[t][:, None]
        before = before.reshape(-1, n).T
        for j in range(3):
            grads["u"][:, j * n : (j + 1) * n] += before @ slope[:, j].reshape(-1, n)
        np.multiply(given, new, out=slope[:, 2])
        word, at, order = grouped(x.ravel())
        rows = (order // lanes * (3 * lanes) + order % lanes)[:, None] + np.arange(3) * lanes
        grads["x"] = word, sums(slope.reshape(-1, n).take(rows, axis=0).reshape(-1, 3 * n), at)
        return -float(logp.sum()), grads, last

    def fit(self, texts: list[np.ndarray], lanes: int = 16, window: int = 16, rate: float = 0.01, passes: int = 1, moments: dict | None = None) -> None:
        """Adam over windows of the texts; the state goes on, gradients end at the window's first token. Of x only the
        rows of words that were read are moved. moments: Adam's state of earlier calls, which goes on in this one."""
        moments = {} if moments is None else moments
        for n in ("first", "second"):
            moments.setdefault(n, {k: np.zeros_like(v) for k, v in self.p.items()})
        first, second, step = moments["first"], moments["second"], moments.get("step", 0)
        for _ in range(passes):
            x, y, start, _ = lay_out(texts, lanes, int(self.bounds[-1]) + 1)
            h = np.zeros((x.shape[1], self.hidden), np.float32)
            for a in range(0, len(x), window):
                part = slice(a, a + window)
                _, grads, h = self.gradients(x[part], y[part], start[part], h)
                step += 1
                pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                seen = max(int((y[part] >= 0).sum()), 1)
                for k, g in grads.items():
                    if k == "x":
                        rows, g = g
                        own = [v.take(rows, axis=0) for v in (self.p[k], first[k], second[k])]
                        move(*own, g, seen, pace)
                        self.p[k][rows], first[k][rows], second[k][rows] = own
                    else:
                        move(self.p[k], first[k], second[k], g, seen, pace)
        moments["step"] = step

    def flat(self) -> np.ndarray:
        """All parameters on end."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(v.dtype)
            at += v.size

    def score(self, texts: list[np.ndarray], lanes: int = 512, window: int = WINDOW) -> np.ndarray:
        """Natural log probability of each whole text; the state goes on from window to window."""
        longest = max(map(len, texts), default=1)
        lanes = min(lanes, max(1, sum(map(len, texts)) // max(longest, 1)))  # else most lanes would wait for the longest text
        x, y, start, owner = lay_out(texts, lanes, int(self.bounds[-1]) + 1)
        h, out, rows = np.zeros((x.shape[1], self.hidden), np.float32), np.zeros(len(texts)), self.rows_of()
        for a in range(0, len(x), window):
            part = slice(a, a + window)
            states, h, _ = self.steps(x[part], start[part], h)
            real = y[part] >= 0
            logp, _ = self.log_prob(states[real], y[part][real], rows=rows)
            out += np.bincount(owner[part][real], weights=logp, minlength=len(texts))
        return out


def lay_out(texts: list[np.ndarray], lanes: int, begin: int) -> tuple[np.ndarray, ...]:
    """Texts on end in lanes of about equal length: (tokens read, tokens to predict or -1, starts, text), all (t, lanes)."""
    texts_of: list[list[int]] = [[] for _ in range(max(1, min(lanes, len(texts))))]
    heap = [(0, i) for i in range(len(texts_of))]
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        size, lane = heapq.heappop(heap)
        texts_of[lane].append(i)
        heapq.heappush(heap, (size + len(texts[i]), lane))
    height = max(size for size, _ in heap)
    shape = (len(texts_of), height)
    x, y, start, owner = np.full(shape, begin, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, bool), np.zeros(shape, np.int32)
    for lane, own in enumerate(texts_of):
        at = 0
        for i in own:
            n = len(texts[i])
            y[lane, at : at + n] = texts[i]
            x[lane, at + 1 : at + n] = texts[i][:-1]
            start[lane, at : at + 1] = n > 0
            owner[lane, at : at + n] = i
            at += n
    return tuple(np.ascontiguousarray(v.T) for v in (x, y, start, owner))
