"""Prefix dynamic programming for byte-pair vocabularies, batched in numpy.

A byte-pair encoding of a string is fixed by its last token: the encoding of
every prefix ends in exactly one token ``t`` such that the encoding of what is
before ``t`` ends in a token ``p`` and the pair ``(p, t)`` stays apart when it is
merged on its own. So one left-to-right pass that keeps, for every prefix, the
last token (the backpointer) and the number of tokens, gives the exact encoding
of every prefix. :class:`Lattice` runs that pass for many equal-length words at
once: substring hashes probe the sorted hashes of the pieces, and the maximum
over the admissible piece lengths is the backpointer.

Words are rows of symbol ids (bytes or characters), so one class serves byte
level and character level vocabularies.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
NONE = np.int64(1 << 40)  # rank of a pair that never merges
#: Longer words take the scalar pass.
LONG = 48
_SLOTS = 1 << 21
_PIECE_BITS, _PAIR_BITS = 17, 20


class Lattice:
    """``pieces``: symbol ids of each token id (None for ids that no text yields);
    ``rank``: merge order of each token id, negative for single symbols;
    ``merges``: {(left id, right id): merged id}; ``splits``: (left id, right id)
    of each token id, (-1, -1) for single symbols."""

    def __init__(
        self,
        pieces: Sequence[tuple[int, ...] | None],
        rank: np.ndarray,
        merges: dict[tuple[int, int], int],
        splits: np.ndarray,
    ):
        self.n = np.uint64(len(pieces) + 1)
        self.rank = rank.astype(np.int64)
        self.splits = splits.astype(np.int64)
        keys = np.fromiter((a * int(self.n) + b for a, b in merges), dtype=np.uint64, count=len(merges))
        ids = np.fromiter(merges.values(), dtype=np.int64, count=len(merges))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], ids[order]
        self.pair_seen = self._seen(self.pair_keys * BASE, _PAIR_BITS)
        self.by_symbols = {p: i for i, p in enumerate(pieces) if p}
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for p, i in self.by_symbols.items():
            by_length.setdefault(len(p), []).append((p, i))
        for size, rows in by_length.items():
            symbols = np.array([p for p, _ in rows], dtype=np.uint64)
            ids = np.array([i for _, i in rows], dtype=np.int64)
            h = self._hashes(symbols)[:, -1]
            order = np.argsort(h)
            self.lengths[size] = h[order], ids[order]
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces share a hash")
        self.longest = max(self.lengths)
        # most probes find nothing: a small table of hash beginnings turns them away
        self.seen = {m: self._seen(keys, _PIECE_BITS) for m, (keys, _) in self.lengths.items()}
        powers = [1]
        for _ in range(self.longest + 1):
            powers.append(powers[-1] * int(BASE) % (1 << 64))
        self.powers = np.array(powers, dtype=np.uint64)
        self.memo_key = np.full(_SLOTS, np.uint64(2**64 - 1), dtype=np.uint64)
        self.memo_ok = np.zeros(_SLOTS, dtype=bool)

    @staticmethod
    def _seen(hashes: np.ndarray, bits: int) -> np.ndarray:
        table = np.zeros(1 << bits, dtype=bool)
        table[hashes >> np.uint64(64 - bits)] = True
        return table

    @staticmethod
    def _hashes(symbols: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes of each row (modulo 2**64)."""
        out = np.zeros((symbols.shape[0], symbols.shape[1] + 1), dtype=np.uint64)
        for i in range(symbols.shape[1]):
            out[:, i + 1] = out[:, i] * BASE + symbols[:, i] + np.uint64(1)
        return out

    # ------------------------------------------------- which pairs stay apart
    def _merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) * self.n + b.astype(np.uint64)
        out = np.full(len(key), NONE)
        maybe = np.flatnonzero(self.pair_seen[(key * BASE) >> np.uint64(64 - _PAIR_BITS)])
        key = key[maybe]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        out[maybe] = np.where(self.pair_keys[at] == key, self.rank[self.pair_ids[at]], NONE)
        return out

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair: does no merge cross the border between the tokens?

        The merges that built both tokens are taken back, latest first, always
        looking at the two parts that touch the border; a pair of parts that
        would have merged before the part that is taken back was built means
        that the border is crossed. Of equal ranks the left merge came first."""
        a, b = left.astype(np.int64), right.astype(np.int64)
        ok = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), NONE, dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            crossing = self._merged_rank(a[live], b[live]) < limit[live]
            ok[live[crossing]] = False
            live = live[~crossing]
            ra, rb = self.rank[a[live]], self.rank[b[live]]
            more = (ra >= 0) | (rb >= 0)
            live, ra, rb = live[more], ra[more], rb[more]
            undo_left = ra > rb
            x, y = live[undo_left], live[~undo_left]
            limit[x] = ra[undo_left]
            a[x] = self.splits[a[x], 1]
            limit[y] = rb[~undo_left] + 1  # equal rank further left goes first
            b[y] = self.splits[b[y], 0]
        return ok

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`_apart` through a direct-mapped memo of fixed size."""
        key = left.astype(np.uint64) * self.n + right.astype(np.uint64)
        slot = ((key * BASE) >> np.uint64(43)).astype(np.int64)
        ok = self.memo_ok[slot]
        miss = np.nonzero(self.memo_key[slot] != key)[0]
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            got = self._apart((new // self.n).astype(np.int64), (new % self.n).astype(np.int64))
            ok[miss] = got[back]
            at = ((new * BASE) >> np.uint64(43)).astype(np.int64)
            self.memo_key[at], self.memo_ok[at] = new, got
        return ok

    # ------------------------------------------------------- the forward pass
    def forward(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last token id, number of tokens) at every prefix of equal-length words;
        both have one column more than ``symbols``, for the empty prefix."""
        n, size = symbols.shape
        last = np.full((n, size + 1), -1, dtype=np.int64)
        count = np.zeros((n, size + 1), dtype=np.int32)
        h = self._hashes(symbols.astype(np.uint64))
        for i in range(1, size + 1):
            open_rows = np.arange(n)
            for m in range(min(i, self.longest), 0, -1):
                if m not in self.lengths or not len(open_rows):
                    continue
                keys, ids = self.lengths[m]
                sub = h[open_rows, i] - h[open_rows, i - m] * self.powers[m]
                maybe = np.flatnonzero(self.seen[m][sub >> np.uint64(64 - _PIECE_BITS)])
                if not len(maybe):
                    continue
                sub = sub[maybe]
                at = np.searchsorted(keys, sub)
                at[at == len(keys)] = 0
                found = np.flatnonzero(keys[at] == sub)
                if not len(found):
                    continue
                hit = maybe[found]
                rows, token = open_rows[hit], ids[at[found]]
                if i > m:
                    fits = self.apart(last[rows, i - m], token)
                    hit, rows, token = hit[fits], rows[fits], token[fits]
                last[rows, i] = token
                count[rows, i] = count[rows, i - m] + 1
                left = np.ones(len(open_rows), dtype=bool)
                left[hit] = False
                open_rows = open_rows[left]
            if len(open_rows):
                raise ValueError("a prefix has no encoding: the vocabulary lacks a single symbol")
        return last, count

    def forward_long(self, symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The same pass for one long word."""
        last, count = [-1], [0]
        memo: dict[tuple[int, int], bool] = {}
        for i in range(1, len(symbols) + 1):
            for m in range(min(i, self.longest), 0, -1):
                token = self.by_symbols.get(symbols[i - m : i])
                if token is None:
                    continue
                if i > m:
                    pair = last[i - m], token
                    if pair not in memo:
                        memo[pair] = bool(self._apart(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if not memo[pair]:
                        continue
                last.append(token)
                count.append(count[i - m] + 1)
                break
            else:
                raise ValueError("a prefix has no encoding: the vocabulary lacks a single symbol")
        return np.array(last), np.array(count, dtype=np.int32)

    def solve(self, words: Sequence[tuple[int, ...] | bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(last token, number of tokens) at every prefix of each word; words of
        one length advance together."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for size, members in by_length.items():
            if size > LONG:
                for k in members:
                    out[k] = self.forward_long(tuple(words[k]))
            else:
                if isinstance(words[members[0]], bytes):
                    rows = np.frombuffer(b"".join([words[k] for k in members]), dtype=np.uint8)
                else:
                    rows = np.array([words[k] for k in members], dtype=np.uint64)
                rows = rows.reshape(len(members), size)
                last, count = self.forward(rows)
                for r, k in enumerate(members):
                    out[k] = last[r], count[r]
        return out

    def encode_rows(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of equal-length words, at the right end of each row, and the number of
        tokens of each: all rows go back along their backpointers together."""
        last, count = self.forward(symbols)
        n, size = symbols.shape
        out = np.zeros((n, size), dtype="<u4")
        rows, at = np.arange(n), np.full(n, size)
        column = size - 1
        while len(rows):
            token = last[rows, at]
            out[rows, column] = token
            at = at - sizes[token]
            more = at > 0
            rows, at = rows[more], at[more]
            column -= 1
        return out, count[:, size]

    def tokens(self, last: np.ndarray, sizes: np.ndarray) -> list[int]:
        """The token ids of a whole word, back along the backpointers."""
        at, found = len(last) - 1, []
        while at > 0:
            found.append(int(last[at]))
            at -= int(sizes[last[at]])
        return found[::-1]


def merge_word(symbols: Sequence[int], merges: dict[tuple[int, int], int], rank: np.ndarray) -> tuple[list[int], tuple]:
    """Plain byte-pair merging of one word (lowest rank first, then leftmost):
    the tokens, and the pair merged last. Used once per vocabulary piece."""
    parts, last = list(symbols), (-1, -1)
    while len(parts) > 1:
        found = [(rank[m], i, m) for i in range(len(parts) - 1) if (m := merges.get((parts[i], parts[i + 1]))) is not None]
        if not found:
            break
        _, i, m = min(found)
        last = parts[i], parts[i + 1]
        parts[i : i + 2] = [m]
    return parts, last


def build(pieces: Sequence[tuple[int, ...] | None], rank: np.ndarray, merges: dict[tuple[int, int], int]) -> Lattice:
    """The lattice of a vocabulary: drops the pieces that no text yields (their own
    symbols merge to something else) and finds how the others are put together."""
    single = {p[0]: i for i, p in enumerate(pieces) if p and len(p) == 1}
    splits = np.full((len(pieces), 2), -1, dtype=np.int64)
    kept: list[tuple[int, ...] | None] = []
    for i, p in enumerate(pieces):
        if p and len(p) > 1:
            if all(c in single for c in p):
                got, pair = merge_word([single[c] for c in p], merges, rank)
                p = p if got == [i] else None
                splits[i] = pair if p else (-1, -1)
            else:
                p = None
        kept.append(p)
    return Lattice(kept, rank, merges, splits)
