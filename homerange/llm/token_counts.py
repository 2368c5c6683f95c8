"""Token counts at every prefix of a text, without re-encoding.

For a byte-level vocabulary (``byte_bpe_50k.json``) the operator holds, for each
text, the exact number of tokens of each of its prefixes (by code points). One
forward pass per distinct word fills the counts of all its prefixes
(:mod:`merge_lattice`); a text's counts are its words' counts added up. From them
come the total, whether a limit is passed, and how much text fits a budget.

Counts are those of the library's own encoding without added tokens; the string
of a special token inside a text counts as that one token, as the library reads it.

Defined results. A null text counts as an empty text: 0 tokens, 0 bytes. Repeated
rows are counted one by one; an empty table gives an empty table. Columns other
than the text are passed on (one named like a result column is replaced).
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import Memo, append_columns, read, worker_object
from homerange.llm.merge_lattice import Lattice, build

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Distinct chunks that a Python worker remembers (see Memo).
MEMO = 250_000

# The byte-level vocabulary's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = regex.compile(PATTERN)
CHUNKS = regex.compile(r"\s*\S+|\s+")
TWO_LETTER = {"'re", "'ve", "'ll"}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The vocabulary file's character of each byte: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_lattice(path: str) -> tuple[Lattice, tuple[str, ...]]:
    """The lattice over bytes and the special tokens of a byte-level file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab, merges = data["model"]["vocab"], data["model"]["merges"]
    special = tuple(t["content"] for t in data["added_tokens"])
    of = byte_symbols()
    size = max(vocab.values()) + 1
    pieces: list = [None] * size
    for piece, i in vocab.items():
        if piece not in special:
            pieces[i] = tuple(of[c] for c in piece)
    rank = np.full(size, -1, dtype=np.int64)
    pairs = {}
    for r, m in enumerate(merges):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs[vocab[a], vocab[b]] = vocab[a + b]
        rank[vocab[a + b]] = r
    return build(pieces, rank, pairs), special


class PrefixCounter:
    """``counts(texts)``: for each text the numbers of tokens of its prefixes, one
    for each code point. Holds the counts of the chunks seen so far (at most
    :data:`MEMO`), where a chunk is white space followed by other characters: a
    word border lies before every run of white space, so chunks add up."""

    def __init__(self, path: str):
        self.lattice, self.special = byte_lattice(path)
        self.any_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.chunks = Memo(MEMO)
        self.words = Memo(MEMO)

    def _learn_words(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        for w, r, (_, count) in zip(words, raw, self.lattice.solve(raw), strict=True):
            if len(r) == len(w):
                self.words.now[w] = count[1:]
            else:  # the counts at the ends of code points
                starts = np.flatnonzero((np.frombuffer(r, dtype=np.uint8) & 0xC0) != 0x80)
                starts[:-1] = starts[1:]
                starts[-1] = len(r)
                self.words.now[w] = count[starts]

    def _chunk(self, chunk: str, words: list[str]) -> np.ndarray:
        """Counts at the prefixes of one chunk, from those of its words."""
        known = self.words.now
        if len(words) == 1:
            return known[words[0]]
        parts, total = [], 0
        for w in words:
            c = known[w]
            if w in TWO_LETTER:  # without its last letter it is a mark and a letter
                c = np.array([c[0], known["'"][0] + known[w[1]][0], c[2]], dtype=np.int32)
            parts.append(c + total if total else c)
            total += int(c[-1])
        counts = np.concatenate(parts)
        if chunk[0].isspace() and (chunk[0] != " " or chunk[1].isspace()):
            blank = chunk[: len(chunk) - len(chunk.lstrip())]
            counts[: len(blank)] = known[blank]  # a text that ends in white space has it as one word
        return counts

    def _learn(self, chunks: list[str]) -> None:
        split = list(map(WORDS.findall, chunks))
        need = set(chain.from_iterable(split)) | {"'", "r", "v", "l"}
        for c in chunks:
            if c[0].isspace() and (c[0] != " " or c[1:2].isspace()):
                need.add(c[: len(c) - len(c.lstrip())])
        new = self.words.missing(need)
        if new:
            self._learn_words(new)
        for c, ws in zip(chunks, split, strict=True):
            self.chunks.now[c] = self._chunk(c, ws)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Counts at the prefixes of texts without special tokens."""
        cut = list(map(CHUNKS.findall, texts))
        new = self.chunks.missing(set(chain.from_iterable(cut)))
        if new:
            self._learn(new)
        out = []
        for cs in cut:
            if not cs:
                out.append(np.zeros(0, dtype=np.int32))
                continue
            parts = list(map(self.chunks.now.__getitem__, cs))
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            flat = np.concatenate(parts)
            ends = np.cumsum(sizes)
            before = np.zeros(len(parts), dtype=np.int32)
            np.cumsum(flat[ends[:-1] - 1], out=before[1:])
            out.append(flat + np.repeat(before, sizes))
        return out

    def counts(self, texts: list[str | None]) -> list[np.ndarray]:
        pieces, plan = [], []
        for t in texts:
            t = t or ""
            found = list(self.any_special.finditer(t)) if self.any_special and any(s in t for s in self.special) else []
            at, parts = 0, []
            for m in found:  # up to its last character a special token is ordinary text
                parts.append((len(pieces), m.start() - at))
                pieces.append(t[at : m.end() - 1])
                at = m.end()
            parts.append((len(pieces), -1))
            pieces.append(t[at:])
            plan.append(parts)
        solved = self._plain(pieces)
        out = []
        for parts in plan:
            if len(parts) == 1:
                out.append(solved[parts[0][0]])
                continue
            whole, total = [], 0
            for k, own in parts:
                c = solved[k] + total
                whole.append(c)
                if own >= 0:  # the special token itself: one token after what is before it
                    total = (int(c[own - 1]) if own else total) + 1
                    whole.append(np.array([total], dtype=np.int32))
            out.append(np.concatenate(whole))
        return out


def prefix_counter(path: str) -> PrefixCounter:
    """One counter per Python worker, so that its memo serves all of its tasks."""
    return worker_object(("prefixes", path), lambda: PrefixCounter(path))


def fitting(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    ok = np.nonzero(counts <= budget)[0]
    return int(ok[-1]) + 1 if len(ok) else 0


def count_tokens(
    docs: DataFrame,
    text_col: str = "text",
    limit: int = LIMIT,
    vocabulary: str = VOCABULARY,
    store: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (its columns ``keep``, if given) with n_bytes, n_tokens, over_limit and fit_chars (code points of the
    longest prefix within ``limit`` tokens); with ``store`` also prefix_tokens, the
    number of tokens of every prefix, for later budget questions."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())]
    if store:
        fields.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))

    def make():
        counter = prefix_counter(vocabulary_path(vocabulary))

        def fn(texts):
            all_counts = counter.counts(texts)
            total = [int(c[-1]) if len(c) else 0 for c in all_counts]
            fit = [len(c) if n <= limit else fitting(c, limit) for c, n in zip(all_counts, total, strict=True)]
            return [total, fit, all_counts] if store else [total, fit]

        return fn

    text = F.col(f"`{text_col}`").cast("string")
    frame = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    kept = None if keep is None else [*(c for c in keep if c != "n_bytes"), "n_bytes"]
    out = append_columns(frame, text, make, T.StructType(fields), kept)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: bytes and tokens of every document, and whether it passes 1024."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(docs, keep=["doc_id"]).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")
