"""Plain single-process versions of the queries' results, written from their definitions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    rank = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], rank.index(s[0])))


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, n: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(ids: list, links: list[tuple]) -> dict:
    to = {i: i for i in ids}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        to[b] = a
    return {i: root(i) for i in ids}


def near_dups(docs: list[tuple], n: int, percent: int) -> dict:
    sets = {i: shingles(t, n) for i, t in docs}
    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    shared: Counter = Counter(p for ids in by.values() for p in combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), c in shared.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    at = components(list(sets), links)
    return {i: (len(sets[i]), at[i]) for i in sets}


def vector_links(rows: list[tuple], least: float) -> dict:
    good = [(i, np.array(v, dtype=np.float64), label) for i, v, label in rows if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.abs(v).max(), label) for i, v, label in good]
    links = [(a[0], b[0]) for a, b in combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt(a[1] @ a[1] * (b[1] @ b[1])) >= least]
    at = components([r[0] for r in rows], links)
    degree = Counter(x for p in links for x in p)
    return {r[0]: (degree[r[0]], at[r[0]]) for r in rows}


def cell(v: int) -> int:
    """A whole number's cell in a quantile sketch: itself below 128, else with its seven leading bits."""
    unit = 1 << max(v.bit_length() - 7, 0)
    return v - v % unit


def adaptive(docs: list[tuple]) -> dict:
    """Verdicts of the quality rules for (doc_id, text, lang, source), from all values of each group."""
    plan = {"symbols": (800, 3), "dup_lines": (990, 1), "repeats": (990, 1), "word_length": (800, 6)}
    rows = []
    for i, text, lang, source in docs:
        n, chars, symbols, dup, repeat, failed = quality(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        x = {"symbols": symbols * 1000 // max(n, 1), "dup_lines": dup * 1000 // max(lines, 1), "repeats": repeat * 1000 // max(n, 1), "word_length": chars * 100 // max(n, 1)}
        rows.append((i, lang, source, {k: cell(v) for k, v in x.items()}, failed))
    fine = [r for r in rows if not r[4]]

    limits: dict = {}
    for key in {r[1:3] for r in fine}:
        levels = [[r for r in fine if r[1:3] == key], [r for r in fine if r[1] == key[0]], fine]
        own = next((x for x in levels[:2] if len(x) >= 30), levels[2])
        for name, (level, reach) in plan.items():
            v = sorted(r[3][name] for r in own)
            low, middle, high = (v[-(-len(v) * k // 1000) - 1] for k in (1000 - level, 500, level))
            limits[key, name] = (low - reach * (middle - low) if name == "word_length" else -1, high + reach * (high - middle))
    return {i: not failed and all(limits[(lang, source), k][0] <= x[k] <= limits[(lang, source), k][1] for k in plan) for i, lang, source, x, failed in rows}


#: Spans of the kinds beyond the base, in the order of their rank.
MORE = {
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    "forge": (r"gh[pousr]_[A-Za-z0-9]+", 40),
    "chat_hook": (r"xox[abprs]-[A-Za-z0-9-]+", 20),
}


def all_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = secret_spans(text) + [(k, m.start(), m.end()) for k, (p, least) in MORE.items() for m in re.finditer(p, text or "") if len(m[0]) >= least]
    rank = ["assign", "access", "hex", *MORE]
    return sorted(out, key=lambda s: (s[1], rank.index(s[0])))


def planted(doc_id: int | None, text: str | None) -> list[str]:
    """The words of a document, a tenth of which get a stretch that repeats."""
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def word_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by trying each period at each place."""
    n, best = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, z - a, p) for (a, z), p in best.items())


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lexical(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """(item_id, rank, doc_id, score) from every document's score for each item."""
    counts = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    total, n_docs = sum(c.total() for _, c in counts), sum(c.total() > 0 for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            s = 0
            for t in set(TERM.findall(lower(text or ""))):
                if c[t]:
                    m = 100 - 90 + 90 * c.total() * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out
