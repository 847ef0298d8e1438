"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# The base rules of the secret scan.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def redacted(text: str | None) -> str | None:
    if text is None:
        return None
    text = ASSIGN.sub(lambda m: "[SECRET]" if len(m[2]) >= 6 else m[0], text)
    text = ACCESS.sub(lambda m: "[SECRET]" if len(m[0]) >= 20 else m[0], text)
    return HEX.sub(lambda m: "[SECRET]" if len(m[0]) >= 24 else m[0], text)


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def contamination(docs: list, items: list, window: int = 10) -> list[tuple]:
    grams: dict[tuple, set] = {}
    for item, text in items:
        w = bench_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).update([] if item is None else [str(item)])
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                owners = grams.get(tuple(w[i:i + n]))
                if owners is not None:
                    hit.update(range(i, i + n))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingle_set(text: str | None, size: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def least_reachable(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_duplicates(docs: list, numerator: int = 85) -> list[tuple]:
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    sets = [shingle_set(t) for _, t in docs]
    links = []
    for i in range(len(docs)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and 100 * small >= numerator * large:
                both = len(sets[i] & sets[j])
                if 100 * both >= numerator * (small + large - both):
                    links.append((i, j))
    return [(d[0], len(s), docs[r][0], d[0] == docs[r][0]) for d, s, r in zip(docs, sets, least_reachable(len(docs), links))]


def failing(docs: list[tuple]) -> list[tuple]:
    """(doc_id, part, failed filters) of (doc_id, text, part) rows."""
    least: dict[str, int] = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    out = []
    for doc, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), doc is not None and doc > least[t]]
        out.append((doc, part or "", "".join(f for f, bad in zip("ABCDE", fails) if bad)))
    return out


def audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    good = {d for d, quality, _ in labels if quality == 1}
    toxic = {d for d, _, t in labels if t == 1}
    rows = failing(docs)
    out = []
    for part in {p for _, p, _ in rows}:
        mine = [(d, set(f)) for d, p, f in rows if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                shapley[f] += len(gone)
                steps.append(("".join(order), step, f, len(left), len(gone), sum(f in x for _, x in mine) - len(gone), sum(x == {f} for _, x in mine),
                              sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(part, o, s, *rest, shapley[f]) for o, s, f, *rest in steps]
    return out


def vector_codes(vectors: list[tuple], parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[list[tuple], list]:
    """(vec_id, codes, error) of (vec_id, vector, label) rows, and codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts if kept else 0
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            row = []
            for p in range(parts):
                x = v[p * width:(p + 1) * width]
                d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
                row.append((d.index(min(d)), min(d)))
            out.append(row)
        return out

    for _ in range(rounds):
        coded = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * width:(p + 1) * width] for (_, v, _), c in zip(kept, coded) if c[p][0] == k]
                if own:
                    books[p][k] = [sum(xs) // len(own) for xs in zip(*own)]
    return [(i, "".join(f"{c:02x}" for c, _ in row), sum(d for _, d in row)) for (i, _, _), row in zip(kept, assign())], books
