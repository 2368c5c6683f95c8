"""SentencePiece encoding and decoding with a batched forward pass in numpy.

The vocabulary (``piece_bpe_32k.model``) is a byte-pair model with byte fallback,
so the best path is not the one of highest total score: a step to a piece is
admissible only if the pair with the piece before it stays apart under the merge
order (:mod:`merge_lattice`). Words of one length advance together, substring
hashes probe the sorted piece hashes, the longest admissible piece at each end
position is kept as backpointer. The ids are those of the library.

The model keeps white space as it is: a space becomes U+2581 and one is put
before a non-empty text. No piece goes from another character to U+2581, so the
text falls into words that can be solved one by one, each distinct word once.
Characters outside the vocabulary become their UTF-8 bytes' pieces.

Defined results. A null text is an empty text: no ids, decoded as empty.
Repeated rows are encoded one by one; an empty table gives an empty table;
columns other than the text are passed on (one named like a result column is
replaced). A U+2581 in the text decodes to a space, as the library does.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import Memo, append_columns, read, worker_object
from homerange.llm.merge_lattice import LONG, Lattice, build
from homerange.llm.token_counts import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct words that a Python worker remembers (see Memo).
MEMO = 350_000
#: Words of one length that advance together at a time.
STEP_WORDS = 100_000


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for every byte that is part of no character."""
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("each byte", _each_byte)


@lru_cache(maxsize=2)
def piece_lattice(path: str) -> tuple[Lattice, dict[str, int], list[str], np.ndarray, int, np.ndarray]:
    """(lattice over characters, symbol of each character, pieces, byte of each byte
    piece or -1, id of the first byte piece, symbols in each token)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_of = np.full(n, -1, dtype=np.int64)
    normal = {}
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            byte_of[i] = int(p[3:5], 16)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            normal[p] = i
    symbol = {p: k for k, p in enumerate(sorted(p for p in normal if len(p) == 1))}
    unknown = len(symbol)  # the symbol, and with id n the token, of any other character
    symbols: list = [None] * (n + 1)
    symbols[n] = (unknown,)
    rank = np.full(n + 1, -1, dtype=np.int64)
    merges = {}
    for order, (p, i) in enumerate(sorted(normal.items(), key=lambda x: (-sp.get_score(x[1]), x[1]))):
        if all(c in symbol for c in p):
            symbols[i] = tuple(symbol[c] for c in p)
        if len(p) > 1:
            rank[i] = order
            for k in range(1, len(p)):
                if (a := normal.get(p[:k])) is not None and (b := normal.get(p[k:])) is not None:
                    merges[a, b] = i
    sizes = np.array([len(s) if s else 0 for s in symbols])
    first_byte = int(np.flatnonzero(byte_of == 0)[0])
    return build(symbols, rank, merges), symbol, pieces, byte_of, first_byte, sizes


class Codec:
    """``encode(texts)`` to id arrays and ``decode(ids)`` back."""

    def __init__(self, path: str):
        self.lattice, self.symbol, self.pieces, self.byte_of, self.first_byte, self.sizes = piece_lattice(path)
        self.unknown_id = len(self.pieces)
        self.table = np.empty(len(self.pieces), dtype=object)
        self.table[:] = [
            bytes([b]) if b >= 0 else p.replace(SPACE, " ").encode()
            for p, b in zip(self.pieces, self.byte_of.tolist(), strict=True)
        ]
        # symbol of every code point
        self.symbol_of = np.full(0x110000, len(self.symbol), dtype=np.int32)
        self.symbol_of[[ord(c) for c in self.symbol]] = list(self.symbol.values())
        self.words = Memo(MEMO)

    def _learn(self, words: list[str]) -> None:
        known = self.words.now
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for size, group in by_length.items():
            if size > LONG:
                for w in group:
                    symbols = tuple(self.symbol_of[np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")].tolist())
                    known[w] = self._spell(w, self.lattice.tokens(self.lattice.forward_long(symbols)[0], self.sizes))
                continue
            for a in range(0, len(group), STEP_WORDS):
                part = group[a : a + STEP_WORDS]
                code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")
                ids, count = self.lattice.encode_rows(self.symbol_of[code].reshape(len(part), size), self.sizes)
                raw, ends = ids.tobytes(), (4 * size * np.arange(1, len(part) + 1)).tolist()
                starts = (4 * (size * np.arange(1, len(part) + 1) - count)).tolist()
                known.update(zip(part, [raw[x:y] for x, y in zip(starts, ends, strict=True)], strict=True))
                for r in np.flatnonzero((ids == self.unknown_id).any(axis=1)).tolist():
                    known[part[r]] = self._spell(part[r], ids[r, size - count[r] :].tolist())

    def _spell(self, word: str, ids: list[int]) -> bytes:
        """Ids with the byte pieces of the characters that the vocabulary lacks."""
        full, at = [], 0
        for i in ids:
            if i == self.unknown_id:
                full += [self.first_byte + b for b in word[at].encode("utf-8", "replace")]
                at += 1
            else:
                full.append(i)
                at += int(self.sizes[i])
        return np.array(full, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = self.words.missing(set(chain.from_iterable(cut)))
        if new:
            self._learn(new)
        return [b"".join(map(self.words.now.__getitem__, ws)) for ws in cut]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids: all pieces in UTF-8, byte pieces as their byte, read
        at once (a broken run of bytes ends where the next piece begins, since no piece begins
        inside a character); the space put before the text is taken off."""
        a = np.frombuffer(ids, dtype="<u4")
        text = b"".join(self.table[a].tolist()).decode("utf-8", "each byte")
        if SPACE in text:
            text = text.replace(SPACE, " ")
        # a space that came as a byte piece belongs to the text
        return text[1:] if text.startswith(" ") and self.byte_of[a[0]] < 0 else text

    def decode_words(self, ids: list[bytes]) -> list[str]:
        """:meth:`decode` of many id sequences."""
        return [self.decode(b) for b in ids]


def worker_codec(path: str) -> Codec:
    """One codec per Python worker, so that its memo serves all of its tasks."""
    return worker_object(("pieces", path), lambda: Codec(path))


def encode(
    docs: DataFrame,
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    check: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (its columns ``keep``, if given) with n_pieces and piece_ids
    (little-endian unsigned 32-bit ids); with ``check`` also round_trip, whether
    decoding the ids gives the text back."""
    fields = [T.StructField("piece_ids", T.BinaryType())]
    if check:
        fields.append(T.StructField("round_trip", T.BooleanType()))
    schema = T.StructType(fields)

    def make():
        codec = worker_codec(vocabulary_path(vocabulary))

        def fn(texts):
            ids = codec.encode(texts)
            if not check:
                return [ids]
            return [ids, [a == (b or "") for a, b in zip(codec.decode_words(ids), texts, strict=True)]]

        return fn

    out = append_columns(docs, F.col(f"`{text_col}`").cast("string"), make, schema, keep)
    return out.withColumn("n_pieces", (F.octet_length("piece_ids") / 4).cast("long"))


def decode(pieces: DataFrame, ids_col: str = "piece_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``pieces`` with decoded, the text of the ids."""
    schema = T.StructType([T.StructField("decoded", T.StringType())])

    def make():
        codec = worker_codec(vocabulary_path(vocabulary))
        return lambda ids: [codec.decode_words([b or b"" for b in ids])]

    return append_columns(pieces, F.col(f"`{ids_col}`"), make, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: pieces of every document, their checksum, and whether decoding gives the
    text back."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = encode(docs, check=True, keep=["doc_id"])
    return out.select("doc_id", "n_pieces", F.crc32("piece_ids").alias("ids_crc32"), "round_trip")
