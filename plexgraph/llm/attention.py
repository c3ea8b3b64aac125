"""A small causal self-attention language model in numpy: training, and scoring in overlapping windows.

Tokens are leaves of a two-level tree (``FAN`` classes of ``FAN`` leaves): the model gives the probability of a class
and of a leaf in its class, so each prediction costs two softmaxes of ``FAN``. Windows hold three cells of ``CELL``
tokens and advance by two; the last two cells are scored, so each token is scored once with ``CELL`` to
``3 * CELL - 1`` tokens before it, all windows of a batch at once under one causal mask.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

FAN, CELL, WIDTH, HIDDEN = 32, 8, 24, 32
LEAVES = FAN * FAN
#: The leaf before a text and the one that fills windows; both are inputs only or, for END, also the last target.
END, PAD = 0, LEAVES
WINDOW, SCORED = 3 * CELL, 2 * CELL
#: Products with ones are the fast way to sum short rows.
_ONES = np.ones((max(WINDOW, WIDTH, FAN), 1), np.float32)
_ZERO, _LARGE = np.float32(0), np.float32(np.inf)
#: Rows of a block of ``_crossed``.
_BLOCK = 768
_MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(CELL, WINDOW)[:, None], 0.0, -1e9).astype(np.float32)


def layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (windows, WINDOW), targets (windows, SCORED; -1 where there is none) and the text of each window."""
    starts, sizes = [], []
    total = 0
    for t in texts:
        padded = -(-len(t) // SCORED) * SCORED
        starts.append(total)
        sizes.append(padded // SCORED)
        total += CELL + padded
    flat_in, flat_out = np.full(total, PAD, np.int16), np.full(total, -1, np.int16)
    for s, t in zip(starts, texts):
        a = s + CELL
        flat_in[a] = END
        flat_in[a + 1 : a + len(t)] = t[:-1]
        flat_out[a : a + len(t)] = t
    count = np.array(sizes)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.repeat(np.array(starts), count) + SCORED * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    return flat_in[first[:, None] + np.arange(WINDOW)], flat_out[first[:, None] + np.arange(CELL, WINDOW)], owner


def initial(frequency: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters whose predictions are the leaves' frequencies."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    mass = frequency.reshape(FAN, FAN) + 0.5
    return {
        "E": (rng.standard_normal((LEAVES + 1, WIDTH)) * 0.5).astype(np.float32),
        "P": (rng.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32),
        "Q": normal(WIDTH, WIDTH), "K": normal(WIDTH, WIDTH), "V": normal(WIDTH, WIDTH), "O": normal(WIDTH, WIDTH),
        "A": normal(WIDTH, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "B": normal(HIDDEN, WIDTH) * np.float32(0.5),
        "C": normal(WIDTH, FAN) * np.float32(0.1), "c": np.log(mass.sum(1) / mass.sum()).astype(np.float32),
        "L": normal(FAN, WIDTH, FAN) * np.float32(0.1), "l": np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32),
    }


def _softmax(x: np.ndarray, share: float) -> np.ndarray:
    """Softmax of rows of ``FAN``, times ``share``; rows are shifted only if some sum leaves the range of floats."""
    with np.errstate(over="ignore"):
        out = np.exp(x)
        total = out @ _ONES[:FAN]
    if not (np.isfinite(total) & (total > 1e-30)).all():
        np.exp(x - x.max(1, keepdims=True), out=out)
        total = out @ _ONES[:FAN]
    out *= np.divide(share, total, out=total)
    return out


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` as one product of matrices."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], -1)


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b``, in blocks of rows small enough for the fast way of products."""
    out = a[:_BLOCK].T @ b[:_BLOCK]
    for k in range(_BLOCK, len(a), _BLOCK):
        out += a[k : k + _BLOCK].T @ b[k : k + _BLOCK]
    return out


def _with_ones(h: np.ndarray) -> np.ndarray:
    """Rows with a 1 at their end, which meets the biases in ``_folded``'s matrices."""
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)


def _hidden(p: dict[str, np.ndarray], inputs: np.ndarray) -> dict[str, np.ndarray]:
    """What training needs of a forward pass, by the matrices of ``_folded``."""
    f = _folded(p)
    x = p["E"].take(inputs, axis=0)
    x += p["P"]
    asking = np.ascontiguousarray(x[:, CELL:])
    asked = _times(asking, f["QK"])
    turned = np.ascontiguousarray(x.transpose(0, 2, 1))
    w = asked @ turned
    np.clip(w, -60, 60, out=w)  # in place of the usual shift; no sum of WINDOW such terms overflows or vanishes
    w += _MASK
    np.exp(w, out=w)
    w /= _times(w, _ONES[:WINDOW])
    mixed = w @ x
    h0 = _times(mixed, f["VO"])
    h0 += asking
    z = _times(h0, p["A"])
    z += p["a"]
    np.clip(z, _ZERO, _LARGE, out=z)
    h = _times(z, p["B"])
    h += h0
    return f | {"x": x, "turned": turned, "asking": asking, "asked": asked, "w": w, "mixed": mixed, "h0": h0, "z": z, "h": h}


def _folded(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parameters and what they give: queries meet inputs through one matrix, what is mixed leaves by another, and biases are rows."""
    return p | {
        "QK": p["Q"] @ p["K"].T * np.float32(1 / np.sqrt(WIDTH)), "VO": p["V"] @ p["O"],
        "Cc": np.concatenate([p["C"], p["c"][None]]), "Ll": np.concatenate([p["L"], p["l"][:, None]], 1),
    }


def _states(p: dict[str, np.ndarray], inputs: np.ndarray) -> np.ndarray:
    """The same as ``_hidden``'s ``h``, with fewer products."""
    x = p["E"].take(inputs, axis=0)
    x += p["P"]
    asking = np.ascontiguousarray(x[:, CELL:])
    w = _times(asking, p["QK"]) @ x.transpose(0, 2, 1)
    np.clip(w, -60, 60, out=w)
    w += _MASK
    np.exp(w, out=w)
    total = _times(w, _ONES[:WINDOW])
    mixed = w @ x
    mixed /= total
    h = _times(mixed, p["VO"])
    h += asking
    z = _times(h, p["A"])
    z += p["a"]
    np.clip(z, _ZERO, _LARGE, out=z)
    h += _times(z, p["B"])
    return h


def scores(p: dict[str, np.ndarray], texts: list[np.ndarray], batch: int = 512) -> np.ndarray:
    """Natural-log probability of each text, a sequence of leaves that ends with END."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    p = _folded(p)
    inputs, targets, owner = layout(texts)
    for a in range(0, len(inputs), batch):
        y = targets[a : a + batch]
        real = y >= 0
        states = _states(p, inputs[a : a + batch])
        if real.all():
            logp = _log_probability(p, states.reshape(-1, WIDTH), y.ravel()).reshape(y.shape).sum(1)
        else:
            logp = np.zeros(y.shape)
            logp[real] = _log_probability(p, states[real], y[real])
            logp = logp.sum(1)
        out += np.bincount(owner[a : a + batch], weights=logp, minlength=len(texts))
    return out


def _log_total(x: np.ndarray) -> np.ndarray:
    """Logarithms of the rows' sums of exponentials; rows are shifted only if some sum leaves the range of floats."""
    with np.errstate(over="ignore", divide="ignore"):
        out = np.log(np.exp(x) @ _ONES[:FAN])[:, 0]
    if not np.isfinite(out).all():
        top = x.max(1, keepdims=True)
        out = (np.log(np.exp(x - top) @ _ONES[:FAN]) + top)[:, 0]
    return out


def _logits(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Logits of the classes and of the leaves in the target's class (2, rows, FAN), where the targets' own stand in them, and each
    class's block of rows; h has ones, and y is in order."""
    out = np.empty((2, len(y), FAN), h.dtype)
    np.matmul(h, p["Cc"], out=out[0])
    edges = np.searchsorted(y, np.arange(0, LEAVES + 1, FAN)).tolist()
    blocks = [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
    for c, a, b in blocks:
        np.matmul(h[a:b], p["Ll"][c], out=out[1, a:b])
    return out, np.arange(0, 2 * FAN * len(y), FAN) + np.concatenate([y // FAN, y % FAN]), blocks


def _log_probability(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> np.ndarray:
    order = np.argsort(y, kind="stable")
    logits, own, _ = _logits(p, _with_ones(h.take(order, axis=0)), y.take(order).astype(np.int64))
    logp = logits.ravel().take(own)
    logp -= _log_total(logits.reshape(-1, FAN))
    back = np.empty(len(h))
    back[order] = logp[: len(h)] + logp[len(h) :]
    return back


def _sums_by(keys: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of each key below ``size``; as complex numbers, two columns are summed at a time."""
    order = np.argsort(keys, kind="stable")
    ordered = keys.take(order)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    pairs = rows.take(order, axis=0).view(np.result_type(rows, np.complex64))
    out[ordered[first]] = np.add.reduceat(pairs, first, axis=0).view(rows.dtype)
    return out


def _gradients(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradients of the mean loss a target, and that loss. Targets are taken in the order of their classes, each a block of rows."""
    f, g = _hidden(p, inputs), {}
    flat = lambda x: x.reshape(-1, x.shape[-1])
    total = lambda x: np.ones(len(x), x.dtype) @ x
    y = targets.ravel()
    order = np.argsort(y, kind="stable")[np.count_nonzero(y < 0) :]
    h, y = _with_ones(flat(f["h"]).take(order, axis=0)), y.take(order).astype(np.int64)
    n = max(1, len(y))
    logits, own, blocks = _logits(f, h, y)
    both = _softmax(logits.reshape(-1, FAN), 1 / n).ravel()
    right = both.take(own)
    loss = -float(np.log(right * n + 1e-30).sum()) / n
    both[own] = right - 1 / n
    one, two = both.reshape(2, -1, FAN)
    dh, more, d = one @ p["C"].T, np.empty((len(y), WIDTH), h.dtype), np.zeros_like(f["Ll"])
    for c, a, b in blocks:
        np.matmul(two[a:b], p["L"][c].T, out=more[a:b])
        np.matmul(h[a:b].T, two[a:b], out=d[c])
    dh += more
    g["L"], g["l"] = d[:, :-1], d[:, -1]
    d = _crossed(h, one)
    g["C"], g["c"] = d[:-1], d[-1]
    full = np.zeros_like(f["h"])
    flat(full)[order] = dh
    dz = _times(full, p["B"].T)
    dz *= f["z"] > 0
    g["B"] = _crossed(flat(f["z"]), flat(full))
    g["A"], g["a"] = _crossed(flat(f["h0"]), flat(dz)), total(flat(dz))
    dh0 = _times(dz, p["A"].T)
    dh0 += full
    # Of a product of two matrices, each gets the product's gradient times the other.
    d = _crossed(flat(f["mixed"]), flat(dh0))
    g["V"], g["O"] = d @ p["O"].T, p["V"].T @ d
    dm = _times(dh0, f["VO"].T)
    ds = dm @ f["turned"]
    ds -= _times(dm * f["mixed"], _ONES[:WIDTH])
    ds *= f["w"]
    dx = f["w"].transpose(0, 2, 1) @ dm
    dx += ds.transpose(0, 2, 1) @ f["asked"]
    da = ds @ f["x"]
    d = _crossed(flat(f["asking"]), flat(da)) * np.float32(1 / np.sqrt(WIDTH))
    g["Q"], g["K"] = d @ p["K"], d.T @ p["Q"]
    dh0 += _times(da, f["QK"].T)
    dx[:, CELL:] += dh0
    g["P"] = total(dx.reshape(len(dx), -1)).reshape(p["P"].shape)
    g["E"] = _sums_by(inputs.ravel(), flat(dx), len(p["E"]))
    return g, loss


class Adam:
    """A copy ``p`` of parameters, all in one row, that takes the steps that the moments of the gradients give.

    The moments are held as plain decaying sums, which costs fewer passes over the row.
    """

    def __init__(self, p: dict[str, np.ndarray]):
        self._row = np.concatenate([x.ravel() for x in p.values()])
        ends = np.cumsum([x.size for x in p.values()]).tolist()
        self.p = {k: self._row[b - x.size : b].reshape(x.shape) for (k, x), b in zip(p.items(), ends)}
        self._m, self._v, self._g = (np.zeros_like(self._row) for _ in range(3))
        self.t = 0

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        row, m, v = self._g, self._m, self._v
        np.concatenate([g[k].ravel() for k in self.p], out=row)
        m *= np.float32(0.9)
        m += row
        row *= row
        v *= np.float32(0.99)
        v += row
        # With means 0.1 * m and 0.01 * v of the moments, each freed of its bias by a factor.
        np.sqrt(v, out=row)
        scale = 0.1 / np.sqrt(1 - 0.99**self.t)
        row += np.float32(1e-8 / scale)
        np.divide(m, row, out=row)
        row *= np.float32(rate * 0.1 / (1 - 0.9**self.t) / scale)
        self._row -= row


def train(texts: list[np.ndarray], frequency: np.ndarray, steps: int = 2000, batch: int = 192, rate: float = 2e-2, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters fitted to the texts by Adam on random windows; the same input gives the same model."""
    p = initial(frequency, seed)
    if not texts:
        return p
    inputs, targets, _ = layout(texts)
    rng, adam = np.random.default_rng(seed + 1), Adam(p)
    p = adam.p
    for t in range(1, steps + 1):
        at = rng.integers(0, len(inputs), batch)
        g, _ = _gradients(p, inputs[at], targets[at])
        adam.step(g, rate * min(1.0, t / 50) * (1 - 0.95 * t / steps))
    return p


def refine(p: dict[str, np.ndarray], groups: Iterable[list[np.ndarray]], rate: float, batch: int = 192, seed: int = 7) -> tuple[dict[str, np.ndarray], int]:
    """``p`` after one pass over the windows of all groups of texts, and the number of windows; groups are held one at a time."""
    adam, rng, n = Adam(p), np.random.default_rng(seed), 0
    p = adam.p
    for texts in groups:
        inputs, targets, _ = layout(texts)
        order = rng.permutation(len(inputs))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            g, _ = _gradients(p, inputs[at], targets[at])
            adam.step(g, rate * min(1.0, (adam.t + 1) / 20) * len(at) / batch)
        n += len(order)
    return p, n


def tree_order(follows: np.ndarray) -> np.ndarray:
    """An order of the leaves in which classes of ``FAN`` neighbours precede like tokens; ``follows[a, b]`` counts b after a."""
    rows = np.sqrt(follows.T + 0.0)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9
    parts = [np.arange(len(rows))]
    while len(parts[0]) > FAN:
        split = []
        for part in parts:
            x = rows[part] - rows[part].mean(0)
            u = np.ones(len(part)) + np.linspace(0, 0.1, len(part))
            for _ in range(30):
                u = x @ (x.T @ u)
                u /= np.linalg.norm(u) + 1e-30
            order = np.argsort(u, kind="stable")
            split += [part[np.sort(order[: len(part) // 2])], part[np.sort(order[len(part) // 2 :])]]
        parts = split
    return np.concatenate(parts)
