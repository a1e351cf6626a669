"""Token counts: batches of texts are encoded in an Arrow function that returns lengths only.

The vocabulary of byte_bpe_50k.json is also given as ranks (same stem, .tiktoken), which a faster library reads; both give the same
tokens (tests compare them over every code point class and the tables). Texts that hold a character on which the two
libraries' character classes could differ are counted by the .json library itself, so the figures are always its own.

Batches are balanced by bytes. A text of over `split_bytes` is cut before a space between two other visible characters:
the pattern always starts a new token there, so the sum over the parts is the count of the whole.

Cases: null counts as empty (0 bytes, 0 tokens); repeated rows each give a row; a text without a safe place is counted
whole; empty tables give no rows; further columns are ignored."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_by_bytes, lengths, map_arrow

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Every one of these characters was compared in both libraries (tests/llm); texts with others take the slower library.
_PLAIN = re.compile("[\x00-\u2fff]*")
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


def default_paths() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


class Counter:
    """Counts tokens of texts as the library of the .json file does, special strings as that library's default."""

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import public_tokenizers as P
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def count(self, texts: list[str]) -> list[int]:
        plain = [self.fast is not None and _PLAIN.fullmatch(t) is not None for t in texts]
        out = [0] * len(texts)
        for i, ok in enumerate(plain):
            if ok:
                out[i] = len(self.fast.encode_to_numpy(texts[i], allowed_special="all"))
        rest = [i for i, ok in enumerate(plain) if not ok]
        if rest:
            for i, e in zip(rest, self.slow.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = len(e.ids)
        return out


def split_text(text: str, size: int) -> list[str]:
    """Parts of about `size` characters; each cut stands before a single space between two visible characters."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return parts


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None, limit: int = 512, split_bytes: int = 65536, batch_bytes: int = 1 << 20) -> DataFrame:
    if json_path is None:
        json_path, ranks_path = default_paths()

    def run(batches):
        counter = None
        for batch in batches_by_bytes(batches, "text", batch_bytes):
            counter = counter or Counter(json_path, ranks_path)
            size = lengths(batch.column(1))
            parts, owner = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for part in split_text(text or "", split_bytes) if size[row] > split_bytes else [text or ""]:
                    parts.append(part)
                    owner.append(row)
            n = [0] * batch.num_rows
            for row, c in zip(owner, counter.count(parts)):
                n[row] += c
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, SCHEMA)
