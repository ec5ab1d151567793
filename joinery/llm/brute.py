"""Plain Python forms of the operators' contracts, to test against on small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(docs: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple]:
    """doc_id: n_words, n_removed, kept_sha256."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        own = SPACED.findall(text or "")
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc] = len(own), sum(gone), sha(" ".join(x for x, g in zip(own, gone, strict=True) if not g))
    return out


def leaks(docs, items, window: int = 10) -> dict[int, tuple]:
    """doc_id: n_words, n_hit, n_items, items_sha256, contaminated."""
    grams = defaultdict(set)
    for item, text in items:
        own = PLAIN.findall((text or "").translate(LOWER))
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            grams[tuple(own[i : i + n])].add(item)
    sizes, out = {len(g) for g in grams}, {}
    for doc, text in docs:
        own = PLAIN.findall((text or "").translate(LOWER))
        hit, found = [False] * len(own), set()
        for n in sizes:
            for i in range(len(own) - n + 1):
                if got := grams.get(tuple(own[i : i + n])):
                    hit[i : i + n] = [True] * n
                    found |= got
        out[doc] = len(own), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)
    return out


def shingles(text: str | None, n: int) -> frozenset:
    own = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)] if own else [])


def near(docs, n: int = 2, percent: int = 80) -> dict[int, tuple]:
    """doc_id: n_shingles, component_id, kept. All pairs that share a shingle."""
    sets = {d: shingles(t, n) for d, t in docs}
    of, up = defaultdict(list), {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for x in s:
            of[x].append(d)
    done = set()
    for own in of.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        up[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
