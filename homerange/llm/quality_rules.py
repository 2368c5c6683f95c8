"""Quality rules: line-first cleaning, all in built-in SQL functions.

Every line is judged by itself (closing punctuation, navigation, boilerplate,
symbols, capitals, repetition); failing lines are taken out, and a document that
loses too much of its text that way is rejected. Document-level base measures
(word count, repeated 8-word windows and so on) come with it.

Defined results. A null text is an empty text: no words, all counts 0,
``base_failed`` true, ``kept`` false, ``clean_text`` empty. Repeated rows are
judged one by one. An empty table gives an empty table. Columns other than the
text are passed on; one named like a result column is replaced by it. Nothing
depends on row order, so ties cannot arise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8

# Phrases that mark a line as boilerplate (lower case).
BOILERPLATE = (
    "all rights reserved",
    "copyright",
    "cookie",
    "cookies",
    "click here",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "read more",
    "sign in",
    "sign up",
    "subscribe",
    "terms of service",
    "terms of use",
)


def _phrases(n_words: int) -> str:
    """A pattern of the phrases of ``n_words`` words, not inside a longer word."""
    phrases = [p for p in BOILERPLATE if len(p.split()) == n_words]
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(phrases) + r")(?![\p{L}\p{N}])"


@dataclass(frozen=True)
class Rules:
    """Thresholds. A document fails the base with fewer than ``min_words`` words
    or more than ``max_repeat_pct`` percent of them in repeated 8-word windows;
    it is rejected when the kept lines hold under ``min_kept_share`` of the
    characters. A line of up to ``boilerplate_words`` words is boilerplate if phrases
    make up ``min_phrase_share`` of its words, so a sentence that holds one is not."""

    min_words: int = 20
    max_repeat_pct: int = 30
    min_kept_share: float = 0.5
    max_separators_per_word: float = 0.25
    max_symbol_share: float = 0.1
    min_capitals: int = 12
    min_distinct_share: float = 0.35
    menu_words: int = 3
    boilerplate_words: int = 30
    min_phrase_share: float = 0.25


def line_fails(line: Column, has_phrase: Column, r: Rules) -> Column:
    """True if one line breaks a rule; an empty line never does.

    Cheap tests come first in each rule, so that a plain prose line is never
    split into words. ``has_phrase``: whether the whole text holds one of the
    boilerplate phrases at all."""
    n = F.regexp_count(line, F.lit(WORD))
    separators = F.regexp_count(line, F.lit("[|»›•·>]"))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>{}\[\]=_~^\\]"))
    phrase = F.lit(0)
    for k in sorted({len(p.split()) for p in BOILERPLATE}):
        phrase = phrase + k * F.regexp_count(F.lower(line), F.lit(_phrases(k)))
    parts = F.split(line, " ", -1)
    capitals = (F.upper(line) == line) & (F.lower(line) != line)
    return (
        ((separators >= 2) & (separators >= r.max_separators_per_word * n))
        | ((symbols >= 3) & (symbols >= r.max_symbol_share * F.length(line)))
        | (capitals & (F.regexp_count(line, F.lit(r"\p{L}")) >= r.min_capitals))
        | ((F.size(parts) >= 10) & (F.size(F.array_distinct(parts)) < r.min_distinct_share * F.size(parts)))
        | (has_phrase & (n <= r.boilerplate_words) & (phrase > 0) & (phrase >= r.min_phrase_share * n))
        | (~line.rlike(r"[.!?…:;。！？][\"'”’»)\]*_\s]*$") & n.between(1, r.menu_words))
    )


def judge(df: DataFrame, text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, clean_text (the lines that pass) and kept."""
    r = rules or Rules()
    q, rows = "_q_", [F.col(f"`{c}`") for c in df.columns]
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = df.select(F.struct(*rows).alias("_row"), t.alias(q + "text"))

    # measures of the whole text
    words = F.regexp_extract_all(F.col(q + "text"), F.lit(f"({WORD})"), 1)
    low, phrase = F.lower(q + "text"), F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | low.contains(p)
    step1 = base.withColumns({q + "words": words, q + "lines": F.split(q + "text", "\n", -1), q + "phrase": phrase})
    n = F.size(q + "words")
    step2 = step1.withColumns(
        {
            q + "worded": F.filter(q + "lines", lambda x: x.rlike(WORD)),
            q + "h": F.transform(q + "words", lambda w: F.xxhash64(w)),
        }
    )
    # one hash per 8-word window, from the words' own hashes
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col(q + "h"), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    step3 = step2.withColumns({q + "win": windows, q + "n": n})
    repeats = F.size(F.array_distinct(q + "win")) < F.size(q + "win")
    # windows seen twice: sorted by hash, those equal to a neighbour
    ranked = F.when(
        repeats, F.sort_array(F.transform(q + "win", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    )
    step4 = step3.withColumn(q + "ranked", ranked)

    def same(x: Column, k: Column) -> Column:
        other = F.get(F.col(q + "ranked"), k)["g"]
        return F.coalesce(other == x["g"], F.lit(False))

    starts = F.sort_array(
        F.transform(F.filter(q + "ranked", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
    )
    step5 = step4.withColumn(q + "starts", starts)
    covered = F.aggregate(
        F.transform(
            q + "starts",
            lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(q + "starts"), k + 1) - p, F.lit(WINDOW))),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )

    good = F.filter(q + "lines", lambda x: ~line_fails(x, F.col(q + "phrase"), r))
    # The measures leave through a generator of one row: a later filter on the verdict
    # would otherwise be pushed below it, and all of this computed twice.
    measured = F.struct(
        F.col(q + "n").cast("long").alias("n_words"),
        F.length(F.array_join(q + "words", "")).cast("long").alias("word_chars"),
        F.regexp_count(q + "text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(q + "worded") - F.size(F.array_distinct(q + "worded"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length(q + "text").alias(q + "chars"),
        F.array_join(good, "\n").alias("clean_text"),
    )
    step6 = step5.select("_row", F.explode(F.array(measured)).alias("m")).select("_row", "m.*")
    failed = (F.col("n_words") < r.min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(r.max_repeat_pct) * F.col("n_words")
    )
    out = step6.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.length("clean_text") >= r.min_kept_share * F.col(q + "chars"))
    )
    results = [
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "clean_text",
        "kept",
    ]
    passed = [F.col("_row")[c].alias(c) for c in df.columns if c not in results]
    return out.select(*passed, *results)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the measures and the verdict of every document."""
    from homerange.llm.common import read

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def _sql(r: Rules) -> str:
    """The same measures and verdict in DuckDB. Its patterns know no look-around, so borders
    are doubled first and each phrase takes one on either side; its upper case keeps the
    sharp s, which has none of one letter."""
    word = "'[^\\x20\\x09-\\x0D]+'"

    def chars(text: str, which: str) -> str:
        return f"(length({text}) - length(translate({text}, '{which}', '')))"

    phrase = []
    for k in sorted({len(p.split()) for p in BOILERPLATE}):
        some = "|".join(p.replace(" ", "  ") for p in BOILERPLATE if len(p.split()) == k)
        phrase.append(f"{k} * len(regexp_extract_all(bordered, '(?:^|[^\\p{{L}}\\p{{N}}])(?:{some})(?:$|[^\\p{{L}}\\p{{N}}])'))")
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
worded AS (SELECT row, regexp_extract_all(text, {word}) AS words FROM docs),
places AS (SELECT row, words, unnest(range(len(words) - {WINDOW - 1})) AS i FROM worded WHERE len(words) >= {WINDOW}),
windows AS (SELECT row, i, list_slice(words, i + 1, i + {WINDOW}) AS w FROM places),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, w) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest(range({WINDOW})) AS k) GROUP BY row),
lines AS (
  SELECT row, j, line, lower(line) AS low,
    len(regexp_extract_all(line, {word})) AS n,
    {chars("line", "|»›•·>")} AS separators,
    {chars("line", "#*$%&|<>{}[]=_~^" + chr(92))} AS symbols,
    regexp_replace(lower(line), '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g') AS bordered,
    string_split(line, ' ') AS parts
  FROM (SELECT row, generate_subscripts(l, 1) AS j, unnest(l) AS line FROM (SELECT row, string_split(text, chr(10)) AS l FROM docs))),
judged AS (
  SELECT row, j, line, n,
    (separators >= 2 AND separators >= {r.max_separators_per_word} * n)
    OR (symbols >= 3 AND symbols >= {r.max_symbol_share} * length(line))
    OR (upper(line) = line AND low <> line AND NOT contains(line, 'ß')
        AND len(regexp_extract_all(line, '\\p{{L}}')) >= {r.min_capitals})
    OR (len(parts) >= 10 AND len(list_distinct(parts)) < {r.min_distinct_share} * len(parts))
    OR (n <= {r.boilerplate_words} AND phrases > 0 AND phrases >= {r.min_phrase_share} * n)
    OR (n BETWEEN 1 AND {r.menu_words}
        AND NOT regexp_matches(line, '[.!?…:;。！？]["''”’»)\\]*_ \\t\\n\\x0B\\f\\r]*$')) AS fails
  FROM (SELECT *, {" + ".join(phrase)} AS phrases FROM lines)),
cleaned AS (
  SELECT row, coalesce(sum(length(line)) FILTER (WHERE NOT fails) + count(*) FILTER (WHERE NOT fails) - 1, 0) AS chars,
    count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines
  FROM judged GROUP BY row),
measured AS (
  SELECT d.doc_id, len(w.words)::BIGINT AS n_words, length(array_to_string(w.words, ''))::BIGINT AS word_chars,
    {chars("d.text", "#*$%&|<>")}::BIGINT AS n_symbols, c.n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(v.n, 0)::BIGINT AS n_repeat_words, c.chars >= {r.min_kept_share} * length(d.text) AS enough
  FROM docs d JOIN worded w ON w.row = d.row JOIN cleaned c ON c.row = d.row LEFT JOIN covered v ON v.row = d.row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_pct} * n_words AS base_failed,
  NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_pct} * n_words) AND enough AS kept
FROM measured"""


ORACLE_SQL = _sql(Rules())
