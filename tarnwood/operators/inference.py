"""Batch inference of small networks with numpy weights, in Arrow batches. Weights are plain dictionaries of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Ids of one forward step.
_TOKENS = 50_000


def gelu(x):
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def layer_norm(x, g=1.0, b=0.0, eps=1e-8):
    return g * (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) + b


def key_mask(scores, keep, heads: int = 1):
    """Scores (heads * batch, q, k) where keep (batch, k) is 0 become a large negative number."""
    return np.where(np.tile(keep, (heads, 1))[:, None, :] > 0, scores, -(2.0**32) + 1)


def future_mask(scores):
    q, k = scores.shape[-2:]
    return np.where(np.tril(np.ones((q, k))) > 0, scores, -(2.0**32) + 1)


def attention(q, k, v, keep=None, causal=False):
    """Scaled dot-product attention over (batch, length, width)."""
    s = q @ k.transpose(0, 2, 1) / np.sqrt(k.shape[-1])
    s = key_mask(s, keep, len(s) // len(keep)) if keep is not None else s
    return softmax(future_mask(s) if causal else s) @ v


def multi_head(x, memory, w, heads, keep=None, causal=False):
    """Project, attend per head, join, add and normalise."""
    q, k, v = x @ w["q"], memory @ w["k"], memory @ w["v"]
    cut = lambda t: np.concatenate(np.split(t, heads, -1), 0)
    out = np.concatenate(np.split(attention(cut(q), cut(k), cut(v), keep, causal), heads, 0), -1)
    return layer_norm(x + out)


def encoder(ids, w, heads=2, keep=None):
    """One transformer encoder block over token ids (batch, length); w: embed, pos, q, k, v, ff1, ff2."""
    keep = (ids > 0) if keep is None else keep
    x = w["embed"][ids] * np.sqrt(w["embed"].shape[1]) + w["pos"][: ids.shape[1]]
    x = multi_head(x, x, w, heads, keep)
    return layer_norm(x + np.maximum(x @ w["ff1"], 0) @ w["ff2"])


def pooled(hidden, w):
    """tanh of a dense layer on the first position."""
    return np.tanh(hidden[:, 0] @ w["pool"])


def text_cnn(ids, w, sizes=(2, 3, 4, 5)):
    """Logits of a convolution over windows of several sizes with max over time; w: embed, conv{n}, out."""
    x = w["embed"][ids]
    maps = []
    for n in sizes:
        win = np.stack([x[:, i : i + x.shape[1] - n + 1] for i in range(n)], 2).reshape(len(x), -1, n * x.shape[2])
        maps.append(np.maximum(win @ w[f"conv{n}"], 0).max(1))
    return np.concatenate(maps, 1) @ w["out"]


def gru(x, w):
    """Last state of a GRU over (batch, length, width); w: z, r, h with inputs and state joined."""
    h = np.zeros((len(x), w["h"].shape[1]))
    sig = lambda t: 1 / (1 + np.exp(-t))
    for t in range(x.shape[1]):
        a = np.concatenate([x[:, t], h], 1)
        z, r = sig(a @ w["z"]), sig(a @ w["r"])
        h = (1 - z) * h + z * np.tanh(np.concatenate([x[:, t], r * h], 1) @ w["h"])
    return h


def random_weights(vocab: int, width: int, length: int, classes: int, sizes=(2, 3, 4, 5), maps: int = 8, seed: int = 0) -> dict:
    r = np.random.default_rng(seed)
    m = lambda *s: r.normal(0, 0.1, s)
    return {"embed": m(vocab, width), "pos": m(length, width), "q": m(width, width), "k": m(width, width), "v": m(width, width), "ff1": m(width, 2 * width), "ff2": m(2 * width, width), "pool": m(width, width), "out": m(maps * len(sizes), classes)} | {f"conv{n}": m(n * width, maps) for n in sizes}


def infer(df: DataFrame, forward, weights: dict, key: str, ids: str) -> DataFrame:
    """(key, label, score): forward(ids matrix, weights) gives logits. Rows of one length go
    together, at most _TOKENS ids at a time. Weights are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for pdf in batches:
            for n, same in pdf.groupby(pdf[ids].map(len)):
                step = max(_TOKENS // max(n, 1), 1)
                for i in range(0, len(same), step):
                    some = same.iloc[i : i + step]
                    p = softmax(forward(np.stack(some[ids].to_numpy()).astype(int), shared.value))
                    yield pd.DataFrame({key: some[key], "label": p.argmax(1).astype("int32"), "score": p.max(1)})

    return df.select(key, ids).mapInPandas(run, f"{key} long, label int, score double")
