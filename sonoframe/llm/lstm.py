"""A bidirectional LSTM over sequences of described blocks, in numpy: training with Adam, and batched inference."""

from __future__ import annotations

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sonoframe.llm.html_blocks import NUMBERS, PATH_BUCKETS, WORD_BUCKETS

WIDTH, HIDDEN = 16, 24
#: A path's names count in full, however deep it is.
PATH_DIVISOR = 3
INPUT = 2 * WIDTH + NUMBERS

Described = tuple[list[list[int]], list[list[int]], np.ndarray]


@dataclass
class Labeller:
    weights: dict[str, np.ndarray]

    @staticmethod
    def new(rng: np.random.Generator) -> Labeller:
        w = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, WIDTH)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WIDTH)), "out": rng.normal(0, 0.2, (2 * HIDDEN + INPUT, 1)), "out_b": np.zeros(1)}
        for side in ("fw", "bw"):
            w[f"{side}_x"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
            w[f"{side}_h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            w[f"{side}_b"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        return Labeller({k: v.astype(np.float32) for k, v in w.items()})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def mean_rows(table: np.ndarray, ids: list[list[int]], fixed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean embedding of each list (or its sum over ``fixed``), the flat ids, their lists' sizes and the divisors. Every list has an id."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.fromiter((x for part in ids for x in part), dtype=np.int64, count=int(sizes.sum()))
    by = np.full(len(sizes), fixed) if fixed else sizes
    return np.add.reduceat(table[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / by[:, None], flat, sizes, by


def run_side(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], side: str, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, HIDDEN) of one direction; a masked step passes its state on unchanged."""
    steps, batch, _ = x.shape
    gates = x @ w[f"{side}_x"] + w[f"{side}_b"]
    h, c = np.zeros((batch, HIDDEN), dtype=np.float32), np.zeros((batch, HIDDEN), dtype=np.float32)
    states, saved = np.zeros((steps, batch, HIDDEN), dtype=np.float32), []
    for t in range(steps) if side == "fw" else range(steps - 1, -1, -1):
        z = gates[t] + h @ w[f"{side}_h"]
        s = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * g
        tc = np.tanh(new)
        m = mask[t][:, None]
        if keep:
            saved.append((t, h, c, i, f, o, g, tc))
        h, c = np.where(m, o * tc, h), np.where(m, new, c)
        states[t] = h
    return states, saved


def back_side(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], side: str, saved: list, up: np.ndarray, grad: dict[str, np.ndarray]) -> np.ndarray:
    dh, dc = np.zeros_like(up[0]), np.zeros_like(up[0])
    dgates = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
    for t, h, c, i, f, o, g, tc in reversed(saved):
        m = mask[t][:, None]
        dh = dh + up[t]
        live, through = np.where(m, dh, 0), np.where(m, 0, dh)
        dnew = np.where(m, dc, 0) + live * o * (1 - tc * tc)
        dz = np.concatenate((dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tc * o * (1 - o), dnew * i * (1 - g * g)), axis=1)
        dgates[t] = dz
        grad[f"{side}_h"] += h.T @ dz
        dh, dc = dz @ w[f"{side}_h"].T + through, dnew * f + np.where(m, 0, dc)
    flat = dgates.reshape(-1, 4 * HIDDEN)
    grad[f"{side}_x"] += x.reshape(-1, INPUT).T @ flat
    grad[f"{side}_b"] += flat.sum(axis=0)
    return (flat @ w[f"{side}_x"].T).reshape(x.shape)


def arrange(w: dict[str, np.ndarray], pages: list[Described]) -> tuple:
    paths, words = [p for page in pages for p in page[0]], [p for page in pages for p in page[1]]
    p, *p_ids = mean_rows(w["path"], paths, PATH_DIVISOR)
    q, *q_ids = mean_rows(w["word"], words)
    rows = np.concatenate((p, q, np.concatenate([page[2] for page in pages])), axis=1).astype(np.float32)
    lengths = np.array([len(page[0]) for page in pages])
    t = np.concatenate([np.arange(n) for n in lengths])
    b = np.repeat(np.arange(len(pages)), lengths)
    x, mask = np.zeros((int(lengths.max()), len(pages), INPUT), dtype=np.float32), np.zeros((int(lengths.max()), len(pages)), dtype=bool)
    x[t, b], mask[t, b] = rows, True
    return x, mask, t, b, rows, p_ids, q_ids


def predict(model: Labeller, pages: list[Described]) -> list[np.ndarray]:
    """For each page, the chance of each of its blocks to be content. Every page has a block."""
    w = model.weights
    x, mask, t, b, rows, _, _ = arrange(w, pages)
    fw, bw = run_side(x, mask, w, "fw", False)[0], run_side(x, mask, w, "bw", False)[0]
    p = sigmoid(np.concatenate((fw[t, b], bw[t, b], rows), axis=1) @ w["out"] + w["out_b"])[:, 0]
    return np.split(p, np.cumsum([len(page[0]) for page in pages])[:-1])


def train(pages: list[Described], labels: list[np.ndarray], *, epochs: int = 6, batch: int = 32, rate: float = 5e-3, seed: int = 5) -> Labeller:
    rng = np.random.default_rng(seed)
    model = Labeller.new(rng)
    w = model.weights
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    order, step, steps = np.arange(len(pages)), 0, epochs * -(-len(pages) // batch)
    for _ in range(epochs):
        rng.shuffle(order)
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            x, mask, t, b, rows, p_ids, q_ids = arrange(w, [pages[i] for i in part])
            y = np.concatenate([labels[i] for i in part]).astype(np.float32)
            (fw, fw_saved), (bw, bw_saved) = run_side(x, mask, w, "fw", True), run_side(x, mask, w, "bw", True)
            top = np.concatenate((fw[t, b], bw[t, b], rows), axis=1)
            d = ((sigmoid(top @ w["out"] + w["out_b"])[:, 0] - y) / len(part))[:, None]
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"], grad["out_b"] = top.T @ d, d.sum(axis=0)
            dtop = d @ w["out"].T
            up_f, up_b = np.zeros_like(fw), np.zeros_like(bw)
            up_f[t, b], up_b[t, b] = dtop[:, :HIDDEN], dtop[:, HIDDEN : 2 * HIDDEN]
            dx = back_side(x, mask, w, "fw", fw_saved, up_f, grad) + back_side(x, mask, w, "bw", bw_saved, up_b, grad)
            drows = dx[t, b] + dtop[:, 2 * HIDDEN :]
            for name, at, (flat, sizes, by) in (("path", 0, p_ids), ("word", WIDTH, q_ids)):
                np.add.at(grad[name], flat, np.repeat(drows[:, at : at + WIDTH] / by[:, None], sizes, axis=0))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k, g in grad.items():
                g *= min(1.0, 5.0 / (norm + 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model
