"""Algorithms by name; an unknown name is a ValueError."""

from __future__ import annotations

from tarnwood.functions import arrays, scaling
from tarnwood.operators import association, learn, profile, quality, text, vectors
from tarnwood.sources import readers

REGISTRY = {
    "measure": {n: association.measure(n) for n in association.MEASURES},
    "scaler": {n: (lambda df, cols, n=n: scaling.scale(df, cols, n)) for n in ("norm", *scaling.PER_COLUMN, *scaling.GLOBAL)},
    "keywords": {"TFIDF": text.keywords, "TEXTRANK": text.textrank_words, "LDA": text.topics, "LSI": text.topic_strengths},
    "activation": dict(arrays.ACTIVATIONS),
    "bayes": {n: (lambda df, f, y, n=n: learn.naive_bayes(df, f, y, n)) for n in learn.BAYES},
    "outlier": {n: (lambda df, row, col, values=(), n=n: quality.outliers(df, row, col, n, values)) for n in quality.RULES},
    "reduction": {"PCA": vectors.principal_strengths, "SVD": vectors.singular_values, "FA": vectors.factor_loadings},
    "reader": readers.READERS,
    "test": {"normality": profile.normality},
}


def get(kind: str, name: str):
    try:
        return REGISTRY[kind][name]
    except KeyError:
        raise ValueError(f"unknown {kind} {name!r}") from None


def register(kind: str, name: str, f) -> None:
    """Add or replace an algorithm."""
    REGISTRY.setdefault(kind, {})[name] = f
