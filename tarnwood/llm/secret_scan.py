"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Base spans: `assign` (a credential word, a separator and a value of 8 or more characters), `access` and `hex`, each
leftmost and without overlap per kind; matches that fail their length test are dropped after they were consumed.

The method adds `markov` spans: maximal runs of token characters of 16 or more that hold a letter and a digit and that no
base span touches are scored by two character Markov models of order 2, one of random strings and one of identifiers; the
log-likelihood ratio per character decides. The samples are labelled: random strings come from a seeded generator over the
alphabets that keys use and from the values that base patterns mark in a bounded sample of documents (`train_docs` rows of
small hash, whole texts); identifiers are that sample's other words (at most `max_words`, evenly thinned) and joined words
as programs write them. A quarter of either label is not learned from: the margin is the least at which at most `most_false`
of its identifiers pass, and the scanner tells precision and recall on it.

Cases: null counts as empty; offsets are code points, end exclusive; repeated rows each give a row; with no documents to
train on, identifiers are modelled by the smoothing prior alone and the margin is `margin`; very long texts are scanned whole;
empty tables give no rows; further columns are ignored."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, map_arrow, smallest_by_hash

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# Greedy runs, so the length test may stand inside the pattern: a run that fails it holds no other match.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
#: Character classes are wide on purpose: a run is judged as a whole.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in output order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Markov:
    """Order-2 character model; counts of a context are joined with `weight` times the next shorter context's distribution."""

    def __init__(self, samples: list[str], weight: float = 2.0):
        n = len(_ALPHABET) + 1
        counts = np.zeros((n, n, n))
        for s in samples:
            c = encode(s)
            np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
        two, one, none = counts[:, :, 1:], counts.sum(0)[:, 1:], counts.sum((0, 1))[1:]
        p0 = (none + 0.5) / (none + 0.5).sum()
        p1 = (one + weight * p0) / (one.sum(1, keepdims=True) + weight)
        self.log = np.log((two + weight * p1) / (two.sum(2, keepdims=True) + weight))

    def score(self, c: np.ndarray) -> float:
        return float(self.log[c[:-2], c[1:-1], c[2:] - 1].sum())


_CODE = np.zeros(128, np.int64)
for _i, _c in enumerate(_ALPHABET, 1):
    _CODE[ord(_c)] = _i


def encode(s: str) -> np.ndarray:
    """Codes of the characters after two start marks (0)."""
    return np.concatenate([np.zeros(2, np.int64), _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]])


def random_strings(n: int = 6000, seed: int = 7) -> list[str]:
    rng = np.random.default_rng(seed)
    sets = ["0123456789abcdef", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:26] + "0123456789", _ALPHABET[26:62]]
    return ["".join(rng.choice(list(sets[i % len(sets)]), int(rng.integers(16, 65)))) for i in range(n)]


def _judged(s: str) -> bool:
    """Only strings with a letter and a digit are scored."""
    return len(s) >= 16 and bool(re.search("[0-9]", s) and re.search("[A-Za-z]", s))


class Scanner:
    def __init__(self, random: Markov, ordinary: Markov, margin: float = 0.5):
        self.random, self.ordinary, self.margin = random, ordinary, margin
        self.precision = self.recall = float("nan")  # on the labelled strings kept for the margin

    def ratio(self, s: str) -> float:
        """Log-likelihood ratio per character, in nats; positive speaks for a random string."""
        c = encode(s)
        return (self.random.score(c) - self.ordinary.score(c)) / len(s)

    def extra(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for m in RUN.finditer(text):
            s, (a, b) = m.group(), m.span()
            if any(x < b and a < y for x, _, y in base) or not _judged(s):
                continue
            if self.ratio(s) > self.margin:
                out.append((a, 3, b))
        return out

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        return base, sorted(base + self.extra(text, base))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def labelled(texts: list[str], max_words: int) -> tuple[list[str], list[str]]:
    """(random strings, identifiers) of the generator and of sample texts."""
    random, words = random_strings(), []
    for t in texts:
        base = base_spans(t)
        values = [max(RUN.findall(t[a:b]), key=len, default="") for a, _, b in base]
        random += [v for v in values if _judged(v)]
        words += [m.group() for m in re.finditer(r"[A-Za-z0-9_-]+", t) if not any(a < m.end() and m.start() < b for a, _, b in base) and not (len(m.group()) >= 16 and re.search("[0-9]", m.group()))]
    words = words[:: max(1, -(-len(words) // max_words))]
    rng, joined = np.random.default_rng(11), []
    for i in range(0, max(0, len(words) - 4), 3):  # identifiers: words joined as programs join them, some with numbers
        w = words[i : i + 3]
        joined += ["_".join(w), "-".join(w), "".join(x.capitalize() for x in w), f"{'_'.join(w)}_{int(rng.integers(0, 10000))}"]
    return random, words + joined


def train(docs: DataFrame, text_col: str = "text", train_docs: int = 300, max_words: int = 60_000, most_false: float = 0.001, margin: float = 0.5) -> Scanner:
    rows = docs.filter(F.col(text_col).isNotNull()).select("doc_id", F.lit(0).alias("all"), F.octet_length(text_col).alias("size"), F.xxhash64("doc_id").alias("h"), F.col(text_col).alias("text"))
    sample = smallest_by_hash(rows, "all", train_docs).select("doc_id", "text").collect()
    texts = [r.text for r in sorted(sample, key=lambda r: (r.doc_id is not None, r.doc_id, r.text))]
    random, ordinary = labelled(texts, max_words)
    learn = lambda x: [s for i, s in enumerate(x) if i % 4]
    out = Scanner(Markov(learn(random)), Markov(learn(ordinary)), margin)
    good, bad = ([out.ratio(s) for s in x[::4] if _judged(s) and RUN.fullmatch(s)] for x in (random, ordinary))
    if bad:
        out.margin = max(0.0, float(np.quantile(bad, 1 - most_false, method="higher")))
        hits, false = sum(x > out.margin for x in good), sum(x > out.margin for x in bad)
        out.recall, out.precision = hits / len(good), hits / max(hits + false, 1)
    return out


def scan_secrets(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end), n_markov."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches):
        s = shared.value
        for batch in batches_by_bytes(batches, "text", 1 << 18):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = s.scan(text or "")
                kinds = [k for _, k, _ in spans]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(told(base).encode()).hexdigest(), told(spans), kinds.count(3)))
            cols = list(zip(*rows))
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:5]), pa.array(cols[5], pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, SCHEMA)
