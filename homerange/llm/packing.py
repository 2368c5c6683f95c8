"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are the powers of two of its token
count's binary form (as many of ``max_tokens`` as fit, then one for each set bit of
the rest, long ones first). Pieces of one length form a bucket; each piece is a
sequence of its own, so no sequence crosses documents and none needs padding.

Defined results. A null text is an empty text, which still has the end token: one
piece of length 1. Repeated rows are packed one by one. An empty table gives an
empty table. Columns other than the id and the text are not read. sequence_id is
the partition number and row number of the piece: unique, and the same again if a
lost task is repeated, since the pieces are made straight from the scan.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import Memo, append_columns, read, worker_object
from homerange.llm.token_counts import vocabulary_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MAX_TOKENS = 4096
#: Distinct words that a Python worker remembers (see Memo).
MEMO = 400_000

# Text whose words can be found and encoded one by one with the same result as the whole
# text: no control characters that only one of the libraries takes for white space, and no
# character from U+0300 on except general punctuation, so that composition changes nothing.
PLAIN = regex.compile(r"[\x00-\x1b\x20-\x84\x86-˿‐-‧‰-⁞]*+")
# The vocabulary's word pattern (an ending, a run of letters, one digit, a run
# of anything else but white space), with letters, numbers and white space as far as PLAIN goes.
_LETTERS, _NUMBERS, _WHITE = "a-zA-Zªµºß-öø-ˁˆ-ˑˠ-ˤˬˮÀ-ÖØ-Þ", "0-9²³¹¼½¾", " \t\n\x0b\x0c\r\xa0"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+")
#: Words that the library gets in one string.
TOGETHER = 2000


class Encoder:
    """``encode(texts)``: little-endian 32-bit ids, as the library gives them. The
    vocabulary cuts a text into words by a pattern before anything else, so a text's ids
    are those of its words; each distinct word goes through the library once. Texts with
    other characters, or with what could be a special token, go through it whole."""

    def __init__(self, path: str):
        # one thread: Spark gives each task its own core, and the library's threads
        # would hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words = Memo(MEMO)

    def _ids(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words: many in one string, cut after the tokens that end a word."""
        out: list[bytes] = []
        groups = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
        for group, e in zip(
            groups,
            self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False),
            strict=True,
        ):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group):
                out += self._ids(group)
                continue
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        # the vocabulary ignores case, special tokens do not
        cut = [
            (WORDS.findall(t.lower()) if PLAIN.fullmatch(t) and "<|" not in t else None) if t else ()
            for t in texts
        ]
        new = self.words.missing(set(chain.from_iterable(c for c in cut if c)))
        if new:
            self.words.now.update(zip(new, self._word_ids(new), strict=True))
        odd = [k for k, cs in enumerate(cut) if cs is None]
        whole = dict(zip(odd, self._ids([texts[k] for k in odd]), strict=True)) if odd else {}
        get = self.words.now.__getitem__
        return [whole[k] if cs is None else b"".join(map(get, cs)) for k, cs in enumerate(cut)]


def worker_encoder(path: str) -> Encoder:
    """One encoder per Python worker, so that its memo serves all of its tasks."""
    return worker_object(("words", path), lambda: Encoder(path))


def binary_pieces(n: int, max_tokens: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens, powers of two, long ones first."""
    out = [(k * max_tokens, max_tokens) for k in range(n // max_tokens)]
    at, rest = n - n % max_tokens, n % max_tokens
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset and bucket (the length's power of two)."""
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    piece = T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    schema = T.StructType([T.StructField("doc_tokens", T.LongType()), T.StructField("pieces", T.ArrayType(piece))])

    def make():
        encoder = worker_encoder(vocabulary_path(vocabulary))
        end = END_ID.to_bytes(4, "little")

        def fn(texts):
            n_tokens, pieces = [], []
            for ids in encoder.encode(texts):
                ids += end
                n = len(ids) // 4
                n_tokens.append(n)
                pieces.append(
                    [
                        {"start": a, "length": size, "ids": ids[4 * a : 4 * (a + size)]}
                        for a, size in binary_pieces(n, max_tokens)
                    ]
                )
            return [n_tokens, pieces]

        return fn

    frame = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("_text"))
    out = append_columns(frame, F.col("_text"), make, schema, keep=[id_col])
    return (
        out.select(id_col, "doc_tokens", F.explode("pieces").alias("p"))
        .select(id_col, "p.start", "p.length", "p.ids", "doc_tokens")
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .withColumn("bucket", F.log2("length").cast("int"))
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """The pieces as Parquet, one folder per bucket of equal lengths; training reads
    one folder for a batch without padding."""
    packed.write.partitionBy("bucket").mode("overwrite").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the pieces of every document with their ids' checksum."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return digest(pack(docs))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )
