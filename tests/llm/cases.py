"""Small tables with the awkward rows, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards boil a pot of stew near the river bank "
# extra columns named like results and internal columns
EXTRA = "doc_id long, text string, score string, kept string, _row string, n_bytes string, simhash string, id string"


def texts() -> list[str | None]:
    base = PROSE * 3
    return [
        None,
        "",
        " \t\n",
        "a",
        base,
        base,
        "start " + base + "end",
        "Ünïcødé 日本語 😀 " + PROSE,
        "x" * 3000,
        "one two three",
        "one two three",
        (PROSE + "\n") * 200,
    ]


def rows(spark, ids=True):
    data = [(k, t, "s", "k", "r", "n", "h", "i") for k, t in enumerate(texts())]
    data.append(data[4])  # a repeated row
    data.append((None, PROSE, "s", None, None, None, None, None))
    return spark.createDataFrame(data, EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(n: int, linked) -> list[int]:
    """Smallest member reachable from each of n members."""
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def passages(docs: list[tuple[int, str | None]], size: int = 50) -> dict[int, tuple[int, int, int, str]]:
    """{id: (bytes, removed, spans, sha256 of the rest)}; ids are distinct."""
    first: dict[bytes, int] = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            first.setdefault(b[p : p + size], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = True
        g = gone[:-1]
        spans = int((g & ~np.append(False, g[:-1])).sum()) if len(b) else 0
        rest = bytes(x for x, r in zip(b, g) if not r)
        out[i] = (len(b), int(g.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out
