"""Plain Python versions of the operators, for small tables. Rows are (doc_id, text); a null id is the smallest."""

import hashlib
import re
from collections import Counter

SPACE = r"[\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def _lowest(i):
    return -(2**63) if i is None else i


def spans(units, ids, width):
    """Flags of covered units: in a window that also starts in a document of smaller id."""
    first = {}
    for i, u in sorted(zip(map(_lowest, ids), units), key=lambda x: x[0]):
        for j in range(len(u) - width + 1):
            first.setdefault(tuple(u[j : j + width]), i)
    out = []
    for i, u in zip(map(_lowest, ids), units):
        c = [False] * len(u)
        for j in range(len(u) - width + 1):
            if first[tuple(u[j : j + width])] < i:
                c[j : j + width] = [True] * width
        out.append(c)
    return out


def suffix_rows(rows, width=50):
    raw = [(t or "").encode() for _, t in rows]
    flags = spans(raw, [i for i, _ in rows], width)
    return [(i, len(b), sum(c), sum(x and not y for x, y in zip(c, [False] + c[:-1])), sha(bytes(x for x, y in zip(b, c) if not y))) for (i, _), b, c in zip(rows, raw, flags)]


def fm_rows(rows, width=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    flags = spans(words, [i for i, _ in rows], width)
    return [(i, len(w), sum(c), sha(" ".join(x for x, y in zip(w, c) if not y))) for (i, _), w, c in zip(rows, words, flags)]


def exact_rows(rows):
    norm = [re.sub(SPACE, " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    least = {n: min((i for i in g if i is not None), default=None) for n, g in groups.items()}
    return [(i, least[n], len(groups[n]), i == least[n], sha(n)) for (i, _), n in zip(rows, norm)]


def bag(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else Counter()


def near_rows(rows, threshold=0.8):
    """(doc_id, class_id, class_size)"""
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            both = sum((a & b).values())
            if a == b and (a or not b) or both and both >= threshold * (sum(a.values()) + sum(b.values()) - both):
                parent[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(rows[i][0])
    least = {c: min(g, key=_lowest) for c, g in classes.items()}
    return [(rows[i][0], least[find(i)], len(classes[find(i)])) for i in range(len(rows))]


def words7(text):
    up = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(up))


def leak_rows(rows, items, width=8, least=2):
    wins = {}
    for i, t in items:
        w = words7(t)
        if i is not None and w:
            for j in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[j : j + width]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words7(t), set(), set()
        for n in {len(x) for x in wins}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    found |= wins[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(found) >= least))
    return out


def rows_of(df, *cols):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))
