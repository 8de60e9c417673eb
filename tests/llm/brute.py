"""Brute-force versions of operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                hit[i : i + size] = 1
        mask = hit[: len(t)] > 0
        spans = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        out.append((len(t), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def classes(rows, least=0.8, weighted=True):
    """Class (least id) of each id by weighted Jaccard of five-word shingles, all pairs; texts without words are equal only to themselves."""
    bags = {}
    for i, t in rows:
        w = words(t)
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter([("", t or "")])
        if not weighted:
            bags[i] = Counter(set(bags[i]))
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in bags.items():
        for x in s:
            having[x].append(i)
    for i, s in bags.items():
        for j in {j for x in s for j in having[x] if j > i}:
            n = (s & bags[j]).total()
            if n >= least * (s.total() + bags[j].total() - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in bags}


def personal(text):
    from colloquy.llm.pii import digits_of, luhn

    def spans(pattern, good=lambda m: True):
        return [m.span() for m in re.finditer(pattern, text or "") if good(m.group())]

    return {
        "email": spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": spans(r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits_of(s)) <= 19 and luhn(s)),
        "phone": spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits_of(s)) <= 15),
    }
