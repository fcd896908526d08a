"""Plain versions of the operators, over lists, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")
SECRET = {
    "assign": re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def components(n: int, linked) -> list[int]:
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(i) for i in range(n)]


def similar(a: set, b: set, share: int) -> bool:
    return bool(a & b) and 100 * len(a & b) >= share * len(a | b)


def shingles(text: str | None, width: int = 5) -> set:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_duplicates(rows: list[tuple[int, str | None]], share: int = 75) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (n_shingles, component_id, kept)."""
    rows = sorted({(i, t) for i, t in rows if i is not None})
    sets = [shingles(t) for _, t in rows]
    top = components(len(rows), lambda a, b: similar(sets[a], sets[b], share))
    return {i: (len(sets[k]), rows[top[k]][0], rows[top[k]][0] == i) for k, (i, _) in enumerate(rows)}


def lines(text: str | None) -> list[tuple[int, str]]:
    trimmed = [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate((text or "").split("\n"))]
    return [(k, x) for k, x in trimmed if x]


def line_groups(rows: list[tuple[int, str | None]], share: int = 80, width: int = 5) -> dict[tuple[int, int], tuple[int, bool]]:
    """(doc_id, line) -> (number of its group, kept)."""
    every = sorted((i, k, x) for i, t in rows for k, x in lines(t))
    distinct = sorted({x for _, _, x in every})
    sets = [{x[i:i + width] for i in range(max(1, len(x) - width + 1))} for x in distinct]
    top = dict(zip(distinct, components(len(distinct), lambda a, b: similar(sets[a], sets[b], share)), strict=True))
    out, seen = {}, set()
    for i, k, x in every:
        out[i, k] = (top[x], top[x] not in seen)
        seen.add(top[x])
    return out


def without_repeats(rows: list[tuple[int, str]]) -> list[tuple[int, str]]:
    groups = line_groups(rows)
    out = []
    for i, t in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if groups.get((i, k), (0, True))[1]]
        if len(kept) == len(t.split("\n")) or any(WORD.search(x) for x in kept):
            out.append((i, "\n".join(kept)))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds."""
    t = text or ""
    found = [(m.start(), 0, m.end(), m[2]) for m in SECRET["assign"].finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in SECRET["access"].finditer(t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in SECRET["hex"].finditer(t) if len(m[0]) >= 32]
    return sorted(found)


def secrets(rows: list[tuple[int, str | None, str | None]], examples: int = 3) -> list[list[tuple]]:
    """For each row (id, text, owner): (start, kind, end, live), with the words of one owner as kind 3."""
    spans = []
    for _, t, _ in rows:
        base = base_spans(t)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9_-]+", t or "")
                if 20 <= len(m[0]) <= 128 and len(re.findall("[0-9]", m[0])) >= 3 and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 10
                and not any(a < m.end() and m.start() < b for a, _, b, _ in base)]
        spans.append(base + more)
    owners: dict[str, set] = {}
    for (_, _, owner), found in zip(rows, spans, strict=True):
        for *_, value in found:
            owners.setdefault(value, set()).add(owner or "")
    return [sorted((a, k, b, len(owners[v]) < examples) for a, k, b, v in found if k < 3 or len(owners[v]) == 1) for found in spans]


def base_digest(found: list[tuple]) -> str:
    names = ("assign", "access", "hex")
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b, *_ in found if k < 3).encode()).hexdigest()


def redacted(text: str, found: list[tuple]) -> str:
    out, at = "", 0
    for a, _, b, live in sorted(found):
        if live:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
    return out + text[at:]


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = WORD.findall(t)
    content = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(content) - len(set(content)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))
