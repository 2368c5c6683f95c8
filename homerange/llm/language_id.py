"""Language identification by compression.

For each language a zstandard raw-content dictionary is made from training texts.
A text is encoded block by block with every dictionary; the language whose
dictionary gives the fewest bytes wins, and the decision is rejected (``accepted``
false) where the runner-up is close. Texts are compared as lower-case letters and
spaces only, so symbols, digits and capitals do not count.

The training sample is bounded: ``sample_docs`` texts of each language at most, of
which the first ``sample_chars`` letters go into the dictionary. It is drawn by a
hash of the text after counting each language, so no group is gathered.
Predictions read whole texts and nothing but the text.

Defined results. A text that is null or has no letter gets ``und`` with score 0
and is not accepted; so does every text when there is no training row. Of equally
small encodings the language first in the alphabet wins (score 0, not accepted).
Repeated rows are judged one by one; an empty table gives an empty table. Columns
other than the text are passed on (one named like a result column is replaced).
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homerange.llm.common import append_columns, fold, read, worker_object

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    """``block``: characters encoded at a time. Texts under
    ``short`` letters are encoded behind ``lead`` bytes of
    training text; ``aside`` sample texts of each language only calibrate that. ``min_margin``: by how much of the
    best size the second must be larger. ``scale``: margin at which the score is
    1 - 1/e."""

    sample_docs: int = 400
    sample_chars: int = 1500
    block: int = 4000
    level: int = 3
    short: int = 400
    lead: int = 2000
    aside: int = 60
    min_margin: float = 0.02
    scale: float = 0.05


def letters(text: str | None) -> str:
    """Lower-case words of letters, single spaces between."""
    return NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""


def learn(training: DataFrame, text_col: str, lang_col: str, s: Settings | None = None) -> dict[str, bytes]:
    """{language: dictionary content} from rows with a language and a text."""
    s = s or Settings()
    rows = training.select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # distinct texts, so that copies of one do not crowd the others out (the estimate's
    # error of some percent is far below the factor 2)
    distinct = F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(distinct).collect()}
    if not sizes:
        return {}
    # a share of each language that gives some more than the wanted texts, chosen by
    # a hash of the text
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, 2.0 * s.sample_docs / max(n, 1))
        wanted = wanted | ((F.col("lang") == lang) & (place <= int(share * (1 << 30))))
    drawn = rows.filter(wanted).select("lang", F.substring("text", 1, 2 * s.sample_chars).alias("text"))
    by_lang: dict[str, set[str]] = {lang: set() for lang in sizes}
    per_lang = drawn.groupBy("lang").agg(F.collect_set("text").alias("texts"))
    for r in per_lang.collect():
        by_lang[r["lang"]] |= {letters(t)[: s.sample_chars] for t in r["texts"]}
    return {
        lang: "\n".join(sorted(texts, key=lambda t: zlib.crc32(t.encode("utf-8", "replace")))[: s.sample_docs]).encode("utf-8", "replace")
        for lang, texts in sorted(by_lang.items())
        if any(texts)
    }


class Judge:
    """``decide(text) -> (language, score, accepted, margin)``."""

    def __init__(self, model: tuple[tuple[str, bytes], ...], s: Settings):
        self.s = s
        self.langs = [lang for lang, _ in model]
        # A text of a few words is encoded behind a lead, a piece of the language's own
        # training text that gives the coder its letter frequencies; the lead's size is
        # taken off again. What such a text of the language takes on average, measured on
        # lines kept out of the dictionary, makes the languages' sizes comparable.
        self.coders, self.lead, self.lead_sizes, self.usual = [], [], [], []
        for _, content in model:
            lines = content.split(b"\n")
            aside = lines[: s.aside] if len(lines) > 2 * s.aside else []
            coder = self._coder(b"\n".join(lines[len(aside) :]), s.level)
            lead = b" ".join(lines[-3:])[: s.lead]
            size = len(coder.compress(lead))
            self.coders.append(coder)
            self.lead.append(lead)
            self.lead_sizes.append(size)
            probes = [x[:n] for x in aside for n in (30, 100, 300) if len(x) >= n]
            took = sum(len(coder.compress(lead + b" " + x)) - size for x in probes)
            self.usual.append(took / sum(map(len, probes)) if took > 0 else 1.0)
        if 1.0 in self.usual:
            self.usual = [1.0] * len(self.usual)

    @staticmethod
    def _coder(content: bytes, level: int):
        import zstandard

        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(
            dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def decide(self, text: str | None) -> tuple[str, float, bool, float]:
        plain = letters(text)
        if not plain or not self.langs:
            return UNDETERMINED, 0.0, False, 0.0
        step = self.s.block
        blocks = [plain[i : i + step].encode("utf-8", "replace") for i in range(0, len(plain), step)]
        if len(plain) < self.s.short:
            own = b" " + blocks[0]
            parts = zip(self.coders, self.lead, self.lead_sizes, self.usual, strict=True)
            sizes = [max(len(c.compress(f + own)) - n, 1) / u for c, f, n, u in parts]
        else:
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        best = min(range(len(sizes)), key=lambda k: sizes[k])
        if len(sizes) == 1:
            return self.langs[0], 1.0, True, 1.0
        second = min(x for k, x in enumerate(sizes) if k != best)
        margin = (second - sizes[best]) / sizes[best]
        return self.langs[best], 1.0 - math.exp(-margin / self.s.scale), margin >= self.s.min_margin, margin


def worker_judge(model: tuple[tuple[str, bytes], ...], s: Settings) -> Judge:
    return worker_object((model, s), lambda: Judge(model, s))


def predict(
    docs: DataFrame,
    model: dict[str, bytes],
    text_col: str = "text",
    s: Settings | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (its columns ``keep``, if given) with lang_pred, score (0 to 1), accepted and margin."""
    s = s or Settings()
    frozen = tuple(sorted(model.items()))
    schema = T.StructType(
        [
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("accepted", T.BooleanType()),
            T.StructField("margin", T.DoubleType()),
        ]
    )

    def make():
        judge = worker_judge(frozen, s)
        return lambda texts: list(zip(*map(judge.decide, texts), strict=True))

    return append_columns(docs, F.col(f"`{text_col}`").cast("string"), make, schema, keep)


def training_rows(id_col: str | Column = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id modulo 4 is not 2."""
    return fold(id_col, 4) != 2


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of every document, learned from the other folds' labels."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learn(docs.filter(training_rows()), "text", "lang")
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (~training_rows()).alias("held_out"), "lang_pred", "score", "accepted", "margin")
