"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy.

Sequences are padded at the end to a common length; ``mask`` tells real characters from padding. The
backward direction reads each sequence reversed within its own length, so padding never leaks in.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def initial(symbols: int, tags: int, embed: int, hidden: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)

    def scaled(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"embed": (rng.standard_normal((symbols, embed)) * 0.3).astype(np.float32)}
    for side in ("f", "b"):
        p[f"wx_{side}"] = scaled(embed, 4 * hidden)
        p[f"wh_{side}"] = scaled(hidden, 4 * hidden)
        p[f"bias_{side}"] = np.zeros(4 * hidden, np.float32)
        p[f"bias_{side}"][hidden : 2 * hidden] = 1.0  # remember at first
    p["out"] = scaled(2 * hidden, tags)
    p["out_bias"] = np.zeros(tags, np.float32)
    p["transition"] = np.zeros((tags, tags), np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _reverse(lengths: np.ndarray, steps: int) -> np.ndarray:
    """(steps, batch) positions that reverse every sequence within its length."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray, keep: list | None) -> np.ndarray:
    steps, batch, _ = x.shape
    hidden = wh.shape[0]
    inputs = x @ wx + bias
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    out = np.empty((steps, batch, hidden), np.float32)
    for t in range(steps):
        gates = inputs[t] + h @ wh
        ifo = _sigmoid(gates[:, : 3 * hidden])
        g = np.tanh(gates[:, 3 * hidden :])
        i, f, o = ifo[:, :hidden], ifo[:, hidden : 2 * hidden], ifo[:, 2 * hidden :]
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out


def _lstm_back(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list, dout: np.ndarray):
    steps = len(kept)
    dgates = np.empty((steps, x.shape[1], wx.shape[1]), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, g, tc = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        d = np.concatenate(
            [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1
        )
        dgates[t] = d
        dwh += h.T @ d
        dh = d @ wh.T
        dc = dc * f
    flat = dgates.reshape(-1, dgates.shape[2])
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0), (flat @ wx.T).reshape(x.shape)


def scores(p: Params, symbols: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """(steps, batch, tags) tag scores of the symbols (steps, batch)."""
    turn = _reverse(lengths, len(symbols))
    x = p["embed"][symbols]
    xr = np.take_along_axis(x, turn[:, :, None], axis=0)
    kept_f, kept_b = ([], []) if keep is not None else (None, None)
    hf = _lstm(x, p["wx_f"], p["wh_f"], p["bias_f"], kept_f)
    hb = np.take_along_axis(_lstm(xr, p["wx_b"], p["wh_b"], p["bias_b"], kept_b), turn[:, :, None], axis=0)
    both = np.concatenate([hf, hb], axis=2)
    if keep is not None:
        keep |= {"x": x, "xr": xr, "turn": turn, "kept_f": kept_f, "kept_b": kept_b, "both": both}
    return both @ p["out"] + p["out_bias"]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf_gradient(e: np.ndarray, transition: np.ndarray, tags: np.ndarray, lengths: np.ndarray):
    """(loss, d scores, d transitions) of the negative log-likelihood of ``tags`` (steps, batch)."""
    steps, batch, k = e.shape
    real = np.arange(steps)[:, None] < lengths[None, :]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        moved = _logsum(alpha[t - 1][:, :, None] + transition[None], 1) + e[t]
        alpha[t] = np.where(real[t][:, None], moved, alpha[t - 1])
    total = _logsum(alpha[-1], 1)
    for t in range(steps - 2, -1, -1):
        moved = _logsum(transition[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(real[t + 1][:, None], moved, 0)
    marginal = np.exp(alpha + beta - total[None, :, None])
    marginal *= real[:, :, None]
    dtransition = np.zeros_like(transition)
    for t in range(1, steps):
        pair = np.exp(
            alpha[t - 1][:, :, None] + transition[None] + (e[t] + beta[t])[:, None, :] - total[:, None, None]
        )
        dtransition += (pair * real[t][:, None, None]).sum(axis=0)
    grid = np.arange(batch)[None, :].repeat(steps, 0)
    place = np.arange(steps)[:, None].repeat(batch, 1)
    gold = (e[place, grid, tags] * real).sum()
    gold += (transition[tags[:-1], tags[1:]] * real[1:]).sum()
    np.subtract.at(dtransition, (tags[:-1][real[1:]], tags[1:][real[1:]]), 1)
    marginal[place[real], grid[real], tags[real]] -= 1
    return float(total.sum() - gold), marginal, dtransition


def gradient(p: Params, symbols: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
    """Loss and gradient of all parameters for one padded batch."""
    keep: dict = {}
    e = scores(p, symbols, lengths, keep)
    loss, de, dtransition = crf_gradient(e, p["transition"], tags, lengths)
    hidden = p["wh_f"].shape[0]
    flat = de.reshape(-1, de.shape[2])
    d = {
        "transition": dtransition,
        "out": keep["both"].reshape(-1, 2 * hidden).T @ flat,
        "out_bias": flat.sum(axis=0),
    }
    dboth = de @ p["out"].T
    dx = None
    for side, x, part in (("f", keep["x"], dboth[:, :, :hidden]), ("b", keep["xr"], dboth[:, :, hidden:])):
        if side == "b":
            part = np.take_along_axis(part, keep["turn"][:, :, None], axis=0)
        d[f"wx_{side}"], d[f"wh_{side}"], d[f"bias_{side}"], more = _lstm_back(
            x, p[f"wx_{side}"], p[f"wh_{side}"], keep[f"kept_{side}"], part
        )
        dx = more if side == "f" else dx + np.take_along_axis(more, keep["turn"][:, :, None], axis=0)
    d["embed"] = np.zeros_like(p["embed"])
    np.add.at(d["embed"], symbols, dx)
    return loss, d


def train(p: Params, symbols: np.ndarray, lengths: np.ndarray, tags: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> Params:
    """Adam over shuffled batches of (count, steps) sequences; same input, same result."""
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(symbols))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            _, d = gradient(p, symbols[pick].T, lengths[pick], tags[pick].T)
            norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
            shrink = min(1.0, 5.0 * len(pick) / max(norm, 1e-9)) / len(pick)
            step += 1
            for k, g in d.items():
                g = g * shrink
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                hat = m[k] / (1 - 0.9**step)
                p[k] = (p[k] - rate * hat / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


# steps of one segment of a long sequence
_SEGMENT = 512


def viterbi_long(e: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best tags of one long sequence (steps, tags): its segments are worked on side by side.

    For each tag that may stand before a segment the best scores behind it are found, these are chained, and
    with the tags at the edges known each segment is traced by itself. Memory is linear, and small, in the steps.
    """
    steps, tags = e.shape
    n = -(-steps // _SEGMENT)
    lengths = np.full(n, _SEGMENT)
    lengths[-1] = steps - (n - 1) * _SEGMENT
    padded = np.zeros((n * _SEGMENT, tags), e.dtype)
    padded[:steps] = e
    parts = padded.reshape(n, _SEGMENT, tags)
    ends = np.empty((n, tags, tags), np.float64)
    group = max(1, 65_536 // (tags * tags))
    for a in range(0, n, group):
        own = parts[a : a + group]
        best = transition[None].astype(np.float64) + own[:, 0][:, None, :]
        for t in range(1, _SEGMENT):
            moved = (best[:, :, :, None] + transition[None, None]).max(axis=2) + own[:, t][:, None, :]
            best = np.where((t < lengths[a : a + group])[:, None, None], moved, best)
        ends[a : a + group] = best
    came = np.zeros((n, tags), np.int64)
    # nothing stands before the first segment
    reach = _through(parts[0], transition, lengths[0])
    for k in range(1, n):
        paths = reach[:, None] + ends[k]
        came[k] = paths.argmax(axis=0)
        reach = paths.max(axis=0)
    last = np.empty(n, np.int64)
    last[-1] = int(reach.argmax())
    for k in range(n - 1, 0, -1):
        last[k - 1] = came[k, last[k]]
    out = np.empty((n, _SEGMENT), np.int8)
    for a in range(0, n, group * tags):
        own = parts[a : a + group * tags]
        rows = np.arange(len(own))
        before = np.concatenate([[0], last])[a : a + len(own)]
        best = np.where((rows + a == 0)[:, None], 0.0, transition[before]) + own[:, 0]
        back = np.empty((_SEGMENT, len(own), tags), np.int8)
        for t in range(1, _SEGMENT):
            reached = best[:, :, None] + transition[None]
            back[t] = reached.argmax(axis=1)
            best = np.where((t < lengths[a : a + len(own)])[:, None], reached.max(axis=1) + own[:, t], best)
        tag = last[a : a + len(own)]
        for t in range(_SEGMENT - 1, -1, -1):
            out[a : a + len(own), t] = tag
            if t:
                tag = np.where(t < lengths[a : a + len(own)], back[t][rows, tag], tag)
    return out.reshape(-1)[:steps]


def _through(e: np.ndarray, transition: np.ndarray, steps: int) -> np.ndarray:
    """Best scores behind the first ``steps`` of a segment that begins a sequence."""
    best = e[0].astype(np.float64)
    for t in range(1, steps):
        best = (best[:, None] + transition).max(axis=0) + e[t]
    return best


def viterbi(e: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(steps, batch) best tags; padding gets the last real tag."""
    steps, batch, _ = e.shape
    back = np.empty(e.shape, np.int8)
    best = e[0]
    rows = np.arange(batch)
    for t in range(1, steps):
        reach = best[:, :, None] + transition[None]
        back[t] = reach.argmax(axis=1)
        moved = reach.max(axis=1) + e[t]
        best = np.where((t < lengths)[:, None], moved, best)
    out = np.empty((steps, batch), np.int8)
    tag = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        out[t] = tag
        if t:
            tag = np.where(t < lengths, back[t][rows, tag], tag)
    return out
