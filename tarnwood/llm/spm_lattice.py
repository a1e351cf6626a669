"""SentencePiece encoding and decoding: Gumbel top-k sampling of segmentations without replacement.

The lattice of a text holds every way to cut it into pieces of the vocabulary. Given the pieces' log-probabilities, a
segmentation has its probability under the model, and the k segmentations of largest Gumbel-perturbed log-probability
are a sample of k different ones without replacement. They are found by A* search from the top: a node is a prefix of a
segmentation with some next pieces excluded; its bound is the largest perturbed value below it, drawn as a Gumbel value at
the node's total log-probability and truncated at its parent's. The node with the best bound is popped, its best
segmentation follows by drawing the pieces from the lattice's exact conditional probabilities, and the nodes beside the
new path enter the queue. k pops give k segmentations; the best bound then left is the threshold that gives each
segmentation its inclusion score, the probability of a perturbed value above that threshold.

No piece reaches across the start of a word (checked when the model is loaded), so conditional probabilities only depend
on the rest of the word and are computed once per different ending of a batch's words; all words, texts and nodes of a batch are worked on
together in numpy. Draws are hashes of (row key, seed, sample, place), so a row's result depends on nothing else.

A BPE model keeps merge ranks instead of log-probabilities; rank r then counts as -log(r + 2.7) (Zipf and Mandelbrot),
and ranks at the far end (joined spaces) as the last rank. Characters outside the vocabulary become their bytes.

Cases: null and empty texts have one empty segmentation of probability 1; texts with fewer than k segmentations give all
they have, each with inclusion 1; rows that repeat a key and text give equal results; a null key counts as key 0;
U+2581 in a text decodes to a space, as in the library; a very long text is a batch of its own, in memory that grows with its
length; empty tables give no rows; further columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_by_bytes, map_arrow, mix64

SPACE = ord("▁")
_ONE = np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)  # odd: powers have inverses modulo 2**64


def default_path() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Model:
    """The vocabulary of a SentencePiece file as a hash table from character strings to pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece reaches across the start of a word")
        score = np.array([sp.get_score(i) for i in ids])
        if (score <= 0).all() and (score == np.round(score)).all():  # merge ranks
            last = -score[score > -1e8].min()
            score = -np.log(np.minimum(-score, last) + 2.7)
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown = float(score.min()) - 10.0
        self.longest = max(map(len, pieces))
        if self.longest > 127:
            raise ValueError("a piece is too long")
        self.inverse = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), 1 << 16)
        self.power = _powers(_BASE, 1 << 16)
        which = {p: j for j, p in enumerate(pieces, 1)}
        self.mixed = mix64((np.arange(1 << 14, dtype=np.uint64) + np.uint64(1)) * _GOLD)  # of the common characters
        known = {p[:l] for p in pieces for l in range(1, len(p) + 1)}  # pieces and what they begin with, to stop a search early
        entries = sorted(known)
        value = np.array([which.get(p, -1) for p in entries], np.int32)
        size = np.array([len(p) for p in entries])
        self.single = np.array([which.get(chr(c), -(chr(c) in known)) for c in range(1 << 14)], np.int32)
        keys = self.hashes(self.prefixes(np.frombuffer("".join(entries).encode("utf-32-le"), np.uint32)), np.cumsum(size) - size, size)
        self.bits = np.uint64(18)
        self.key, self.at, self.probes = np.zeros((1 << 18) + 256, np.uint64), np.zeros((1 << 18) + 256, np.int32), 1
        for j, s in enumerate(self.slots(keys).tolist()):
            n = 1
            while self.at[s]:
                if self.key[s] == keys[j]:
                    raise ValueError("two strings share a hash")
                s, n = s + 1, n + 1
            self.key[s], self.at[s], self.probes = keys[j], value[j], max(self.probes, n)
        self.score, self.piece = np.concatenate([[-np.inf], score]), np.concatenate([[-1], ids]).astype(np.int32)

    def grow(self, n: int) -> None:
        if n > len(self.power):
            self.power, self.inverse = _powers(_BASE, 2 * n), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), 2 * n)

    def prefixes(self, chars: np.ndarray) -> np.ndarray:
        """n + 1 sums of mixed characters times powers of the base."""
        self.grow(len(chars) + 1)
        out = np.zeros(len(chars) + 1, np.uint64)
        mixed = self.mixed[np.minimum(chars, len(self.mixed) - 1)]
        rare = np.flatnonzero(chars >= len(self.mixed))
        mixed[rare] = mix64((chars[rare].astype(np.uint64) + np.uint64(1)) * _GOLD)
        mixed *= self.power[: len(chars)]
        np.cumsum(mixed, out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, first: np.ndarray, size) -> np.ndarray:
        return (prefix[first + size] - prefix[first]) * self.inverse[first]

    def find_characters(self, chars: np.ndarray) -> np.ndarray:
        """find() of strings of one character."""
        out = self.single[np.minimum(chars, len(self.single) - 1)]
        rare = np.flatnonzero(chars >= len(self.single))
        out[rare] = self.find(mix64((chars[rare].astype(np.uint64) + _ONE) * _GOLD))
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _GOLD) >> (np.uint64(64) - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each string among the pieces, from 1; -1 if pieces begin with it; 0 if none does."""
        slot = self.slots(keys)
        out = self.at[slot]
        more = np.flatnonzero((self.key[slot] != keys) & (out != 0))
        slot, keys = slot[more], keys[more]
        while len(more):
            slot = slot + 1
            out[more] = self.at[slot]
            on = np.flatnonzero((self.key[slot] != keys) & (self.at[slot] != 0))
            more, slot, keys = more[on], slot[on], keys[on]
        return out


class Words:
    """Lattices of the different words of a batch as lists of edges, those of one place together, the longest first. Places
    from which words go on alike share their edges.

    first[p], n_ways[p]: the edges of place p. Per edge: reach (characters), step (the same, 0 at the end of the word), piece (id, -1 for a character outside the
    vocabulary), share (its probability given that a piece starts at p), upto (sum of shares down the list)."""

    def __init__(self, m: Model, chars: np.ndarray, size: np.ndarray, alpha: float):
        n, L = len(chars), m.longest
        left = np.repeat(np.cumsum(size), size) - np.arange(n)  # characters to the end of the word
        prefix = m.prefixes(chars)
        here, node = self._nodes(m, prefix, left)
        count, left = len(here), left[here]
        small = left.astype(np.uint16) if n and left.max() < 1 << 16 else left
        order = np.argsort(small, kind="stable")  # nodes nearest to a word's end first
        rank = np.empty(count + 1, np.int64)
        rank[order] = np.arange(count)
        found, n_ways = [], np.zeros(count, np.int64)
        of, at, base, inverse = np.arange(count), here, prefix[here], m.inverse[here]  # nodes where longer pieces may still start
        for l in range(1, L + 1):
            if l > 1:
                on = np.flatnonzero(left[of] >= l)
                of, at, base, inverse = of[on], at[on], base[on], inverse[on]
            if not len(of):
                break
            hit = m.find((prefix[at + l] - base) * inverse) if l > 1 else m.find_characters(chars[at])
            is_edge = hit > 0 if l > 1 else np.ones(count, bool)
            found.append((of[is_edge], np.maximum(hit[is_edge], 0)))
            n_ways[found[-1][0]] += 1
            on = np.flatnonzero(hit)
            of, at, base, inverse = of[on], at[on], base[on], inverse[on]
        width = n_ways[order]
        stop = np.cumsum(width)
        head, edges = stop - width, int(stop[-1]) if n else 0
        free = stop[rank[:count]]  # one beyond the last free edge of each node
        first = head[rank[:count]]
        self.reach, self.step, which, target = (np.empty(edges, t) for t in (np.int8, np.int8, np.int32, np.int32))
        for l, (of, hit) in enumerate(found, 1):
            free[of] -= 1
            put = free[of]
            last = left[of] == l
            self.reach[put], self.step[put], which[put] = l, np.where(last, 0, l), hit
            after = here[of] + l
            after[last] = 0
            target[put] = np.where(last, count, rank[node[after]])  # node `count`: the end of a word
        del found, free
        log_piece = alpha * np.where(np.arange(len(m.score)) > 0, m.score, m.unknown)
        left = left[order]
        # Probabilities of all ways to go on: as they are where they cannot underflow, as logarithms further from a word's end.
        safe = int(600 / max(np.abs(log_piece).max(), 1.0))
        near = int(np.searchsorted(left, safe, "right"))
        upto = int(stop[near - 1]) if near else 0
        share = np.zeros(edges)
        share[:upto] = np.exp(log_piece)[which[:upto]]
        beta = np.ones(count + 1)
        groups = np.flatnonzero(np.diff(left, prepend=0))
        ends = [*groups[1:].tolist(), count]
        for p, q in zip(groups.tolist(), ends):
            if p >= near:
                break
            a, b = int(head[p]), int(stop[q - 1])
            v = share[a:b]
            v *= beta[target[a:b]]
            beta[p:q] = np.add.reduceat(v, head[p:q] - a)
        share[:upto] /= np.repeat(beta[:near], width[:near])
        if near < count:
            beta = np.log(beta)  # beta[count] is 0
            score = log_piece[which[upto:]]
            for p, q in zip(groups.tolist(), ends):
                if p < near:
                    continue
                a, b = int(head[p]), int(stop[q - 1])
                h, w = head[p:q] - a, width[p:q]
                v = score[a - upto : b - upto] + beta[target[a:b]]
                top = np.maximum.reduceat(v, h)
                e = np.exp(v - np.repeat(top, w))
                total = np.add.reduceat(e, h)
                beta[p:q] = top + np.log(total)
                share[a:b] = e / np.repeat(total, w)
        self.share, self.piece = share, m.piece[which]
        run = np.cumsum(share)
        run -= np.repeat(run[head] - share[head], width)
        run[stop - 1] = 2.0  # the last edge takes what rounding leaves
        self.upto, self.first, self.n_ways = run, first[node], n_ways[node]

    @staticmethod
    def _nodes(m: Model, prefix: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places that stand for all places from which words go on alike, and the number of each place's one among them.

        Places meet in a table; one that does not meet its like there, because another has its slot, stands for itself."""
        n = len(left)
        place = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        ways = (prefix[place + left] - prefix[:-1]) * m.inverse[:n] + left.astype(np.uint64) * _BASE
        bits = max(n.bit_length() + 1, 8)
        slot = ((ways * _GOLD) >> np.uint64(64 - bits)).view(np.int64)
        table = np.zeros(1 << bits, place.dtype)
        table[slot] = place
        like = table[slot]
        like = np.where(ways[like] == ways, like, place)
        here = np.flatnonzero(like == place)
        number = np.empty(n, np.int64)
        number[here] = np.arange(len(here))
        return here, number[like]


#: A perturbed value lies between these bounds from its log-probability, since uniform draws have 53 bits.
_MOST, _LEAST = 37.5, 45.0


def _salt(sample: int, stream: int) -> np.uint64:
    return np.uint64((4 * sample + stream + 1) * 0x632BE59BD9B4E019 % (1 << 64))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform draws of 53 bits; x is overwritten."""
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def _uniform(key: np.ndarray, sample: int, stream: int, place: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _unit(mix64(key ^ ((place.astype(np.uint64) + _ONE) * _GOLD + _salt(sample, stream))))


def sample_batch(m: Model, keys: np.ndarray, texts: list[str], k: int, alpha: float = 1.0, seed: int = 0):
    """Yields for each sample, best first: rows, n_ids per row, ids, log_prob, perturbed; ends with the thresholds per row."""
    if m.sp.normalize("a b") != "▁a▁b":
        raise ValueError("the model changes texts before it cuts them")
    norm = [("▁" + t.replace(" ", "▁")) if t else "" for t in texts]
    size = np.array([len(t) for t in norm], np.int64)
    chars = np.frombuffer("".join(norm).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, rows = len(chars), len(texts)
    row = np.repeat(np.arange(rows), size)
    row_start = np.cumsum(size) - size
    rkey = mix64(mix64(keys.astype(np.int64).view(np.uint64) + _GOLD) + np.uint64(seed))
    is_space = chars == SPACE
    begins = is_space.copy()
    begins[1:] &= ~is_space[:-1]
    begins[row_start[size > 0]] = True
    start = np.flatnonzero(begins)
    wsize = np.diff(np.append(start, n))
    whash = m.hashes(m.prefixes(chars), start, wsize) ^ mix64(wsize.astype(np.uint64))
    _, one, inv, often = np.unique(whash, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-often, kind="stable")  # frequent words stand together, for the processor's cache
    one, at_rank = one[common], np.empty(len(common), np.int64)
    at_rank[common] = np.arange(len(common))
    inv = at_rank[inv]
    usize = wsize[one]
    ufirst = np.cumsum(usize) - usize
    words = Words(m, chars[np.repeat(start[one] - ufirst, usize) + np.arange(usize.sum())], usize, alpha)
    shift = ufirst[inv] - start  # from a place in the batch to its place in the lattice of its word
    word = np.repeat(np.arange(len(start), dtype=np.int32), wsize)
    lattice = lambda at: at + shift[word[at]]
    word_end = start + wsize

    def walk(at: np.ndarray, edge: np.ndarray, s: int) -> None:
        """Draw an edge at each place in `at` and so on to the end of its word; edge[p]: 1 + the edge at p."""
        w = word[at]
        r = row[at]
        key, sh = rkey[r], shift[w]
        with np.errstate(over="ignore"):
            salt = _salt(s, 0) - row_start[r].astype(np.uint64) * _GOLD
        while len(at):
            e = words.first[at + sh]
            x = at.astype(np.uint64)
            x += _ONE
            x *= _GOLD
            x += salt
            x ^= key
            u = _unit(mix64(x))
            on = np.flatnonzero(words.upto[e] <= u)
            if len(on):
                f, v = e[on], u[on]
                while True:
                    f += 1
                    more = np.flatnonzero(words.upto[f] <= v)
                    if len(more) < len(f):
                        e[on] = f
                    if not len(more):
                        break
                    on, f, v = on[more], f[more], v[more]
            edge[at] = e + 1
            step = words.step[e]
            go = np.flatnonzero(step)
            at, key, salt, sh = at[go] + step[go], key[go], salt[go], sh[go]

    def bounds(at, loc, s, top):
        """Best perturbed values below nodes of log-probability loc, truncated at top."""
        z = loc - np.log(-np.log(_uniform(rkey[row[at]], s, 1, at - row_start[row[at]])))
        return -np.logaddexp(-top, -z)

    def best_of(x):
        b = np.full(rows, -np.inf)
        np.maximum.at(b, row[x["at"]], x["bound"])
        return b

    ways = np.arange(m.longest)
    samples: list[dict] = []
    value = -np.log(-np.log(_uniform(rkey, 0, 2, np.zeros(rows, np.int64))))  # Gumbel at log-probability 0: all segmentations
    live = np.arange(rows)
    for s in range(k + 1):
        edge = np.zeros(n, np.int32)
        fresh = row_start.copy()
        if s == 0:
            walk(start, edge, 0)
        else:  # pop the best node of each row
            best, who, where = np.full(rows, -np.inf), np.full(rows, -1), np.zeros(rows, np.int64)
            for j, x in enumerate(samples):
                b = best_of(x)
                hit = np.flatnonzero((x["bound"] == b[row[x["at"]]]) & np.isfinite(x["bound"]))
                r, pick = np.unique(row[x["at"][hit]], return_index=True)
                better = b[r] > best[r]
                r, pick = r[better], hit[pick[better]]
                best[r], who[r], where[r] = b[r], j, pick
            if s == k:
                yield best
                return
            live, value = np.flatnonzero(who >= 0), best
            at_r, mask_r, prior = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows)
            for j, x in enumerate(samples):
                r = live[who[live] == j]
                p = x["at"][where[r]]
                at_r[r], mask_r[r], prior[r] = p, x["mask"][where[r]], x["before"][where[r]]
                x["bound"][where[r]] = -np.inf
                span = p - row_start[r]
                copy = np.repeat(row_start[r] - (np.cumsum(span) - span), span) + np.arange(span.sum())
                edge[copy] = x["edge"][copy]
            at = at_r[live]
            f, count = words.first[lattice(at)], words.n_ways[lattice(at)]
            grid = np.minimum(f[:, None] + ways, (f + count - 1)[:, None])
            bit = np.uint64(1) << ways.astype(np.uint64)
            share = np.where((ways < count[:, None]) & ((mask_r[live][:, None] & bit) == 0), words.share[grid], 0.0)
            c = np.cumsum(share, 1)
            u = _uniform(rkey[live], s, 3, at - row_start[live]) * c[:, -1]
            pick = np.minimum((c <= u[:, None]).sum(1), m.longest - 1 - np.argmax(share[:, ::-1] > 0, 1))
            edge[at] = f + pick + 1
            share[np.arange(len(at)), pick] = 0
            node_rest = np.zeros(rows)
            node_rest[live] = share.sum(1)
            mask_r[live] |= np.uint64(1) << pick.astype(np.uint64)
            after = at + words.reach[f + pick]
            walk(after[after < word_end[word[at]]], edge, s)
            begin = np.full(rows, n, np.int64)
            begin[live] = word_end[word[at]]
            walk(start[start >= begin[row[start]]], edge, s)
            fresh = np.full(rows, n, np.int64)
            fresh[live] = at
        path = np.flatnonzero(edge)
        e, erow = edge[path] - 1, row[path]
        with np.errstate(divide="ignore"):
            logq = np.log(words.share[e])
        run = np.cumsum(logq)
        head = np.searchsorted(path, row_start)
        base = np.append(0.0, run)[head]
        total = np.zeros(rows)
        total += np.bincount(erow, logq, rows)
        before = run - logq - base[erow]
        # Nodes far down the path cannot be among the k + 1 best bounds if enough nearer ones are sure to be better.
        is_near = before > -_LEAST

        def nodes(i):
            """Of the places i of the path, those that have a new node beside the path."""
            i = i[path[i] >= fresh[erow[i]]]
            lat = lattice(path[i])
            some = (words.n_ways[lat] > 1) | (path[i] == fresh[erow[i]])
            return i[some], lat[some]

        def made(i, lat):
            at, mask, rest, bef = _node(words, path[i], e[i], lat, before[i])
            if s:
                own = at == fresh[row[at]]
                rest[own], mask[own] = node_rest[row[at[own]]], mask_r[row[at[own]]]
            some = rest > 0
            at, mask, rest, bef = at[some], mask[some], rest[some], bef[some]
            return {"at": at, "mask": mask, "before": bef, "bound": bounds(at, bef + np.log(rest), s, value[row[at]]), "edge": edge}

        x = made(*nodes(np.flatnonzero(is_near)))
        sure = np.bincount(row[x["at"]][x["bound"] > _MOST - _LEAST], minlength=rows) > k
        if not sure.all():
            far, lat = nodes(np.flatnonzero(~(is_near | sure[erow])))
            if len(far):
                y = made(far, lat)
                x = {c: np.concatenate([x[c], y[c]]) if c != "edge" else edge for c in x}
        samples.append(x)
        ids, count = words.piece[e], np.ones(len(path), np.int64)
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            coded = [chr(c).encode("utf-8", "replace") for c in chars[path[lone]].tolist()]
            count[lone] = [len(b) for b in coded]
            ids = np.repeat(ids, count)
            put, many = (np.cumsum(count) - count)[lone], count[lone]
            put = np.repeat(put - (np.cumsum(many) - many), many) + np.arange(many.sum())
            ids[put] = m.byte_id[np.frombuffer(b"".join(coded), np.uint8)]
        yield live, np.bincount(erow, count, rows).astype(np.int64), ids, total, value


def _node(words: Words, at, e, lat, before):
    """Nodes beside the chosen edges: excluded edges as bits, and the share of the others."""
    mask = np.uint64(1) << (e - words.first[lat]).astype(np.uint64)
    return at, mask, np.maximum(1 - words.share[e], 0.0), before.copy()


SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
DIGEST = "doc_id long, sample int, n_ids long, ids_sha256 string, log_prob double, perturbed double, inclusion double, decoded boolean"


def sample_encode(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, alpha: float = 1.0, seed: int = 0, digest: bool = False, batch_bytes: int = 1 << 18) -> DataFrame:
    """Up to k different segmentations per row, best first. digest: give counts and a hash of the ids instead of the ids,
    and for the best segmentation whether the library decodes it to the text."""
    path = model_path or default_path()
    schema = DIGEST if digest else SCHEMA
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        m = None
        for batch in batches_by_bytes(batches, "text", batch_bytes):
            m = m or Model(path)
            keys = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = list(sample_batch(m, keys, texts, k, alpha, seed))
            threshold = out.pop()
            for s, (live, n_ids, ids, total, value) in enumerate(out):
                if not len(live):
                    continue
                with np.errstate(over="ignore"):
                    inclusion = np.where(np.isfinite(threshold), -np.expm1(-np.exp(total - np.where(np.isfinite(threshold), threshold, 0))), 1.0)
                ends = np.cumsum(n_ids[live])
                cols = [batch.column(0).take(pa.array(live)), pa.array(np.full(len(live), s + 1, np.int32))]
                if digest:
                    parts = np.split(ids.astype("<i4"), ends[:-1])
                    cols += [pa.array(n_ids[live]), pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in parts], pa.string())]
                else:
                    cols += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))]
                cols += [pa.array(total[live]), pa.array(value[live]), pa.array(inclusion[live])]
                if digest:
                    cols += [pa.nulls(len(live), pa.bool_()) if s else pa.array([d == texts[r].replace("▁", " ") for d, r in zip(m.sp.decode([p.tolist() for p in parts]), live.tolist())], pa.bool_())]
                yield pa.record_batch(cols, names=names)

    return map_arrow(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """The library's own best segmentation: doc_id, ids; null as empty."""
    path = model_path or default_path()

    def run(batches):
        sp = None
        for batch in batches_by_bytes(batches, "text", 1 << 18):
            if sp is None:
                import sentencepiece

                sp = sentencepiece.SentencePieceProcessor(model_file=path)
            yield pa.record_batch([batch.column(0), pa.array(sp.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text); null ids give an empty text."""
    path = model_path or default_path()

    def run(batches):
        sp = None
        for batch in batches:
            if sp is None:
                import sentencepiece

                sp = sentencepiece.SentencePieceProcessor(model_file=path)
            yield pa.record_batch([batch.column(0), pa.array(sp.decode([x or [] for x in batch.column(1).to_pylist()]) if batch.num_rows else [], pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
