"""LIKE against a table of patterns, by a q-gram index.

Matching every text with every pattern is a nested loop. Here the distinct texts are
posted under their grams of one to three characters. A pattern's literal parts (what
stands between its ``%`` and ``_``) must occur in any text it matches, so it needs to look
under one of their grams only: it takes the longest it has, and of these the one that the
fewest texts hold. Texts and patterns meet in one equi-join on that gram, and the pairs
that meet are verified once with LIKE itself. A pattern without a literal part ("%",
"__") looks under the empty gram, where every text is: it can match any.

Case is ignored. ``%`` is any run of characters, ``_`` one character, and a backslash takes
the next of ``% _ \\`` literally; before anything else it is a plain character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest gram of the index.
Q = 3
_ANY, _PERCENT, _LINE, _BACK = "\x01", "\x02", "\x03", "\x04"


def _protected(pattern: Column) -> Column:
    """Escaped characters as control characters, other backslashes as escaped ones."""
    for text, mark in (("\\\\", _BACK), ("\\%", _PERCENT), ("\\_", _LINE), ("\\", _BACK)):
        pattern = F.replace(pattern, F.lit(text), F.lit(mark))
    return pattern


def _grams(text: Column, q: int) -> Column:
    starts = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - (q - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(q)))


def _part_grams(q: int) -> Column:
    return F.flatten(F.transform("parts", lambda s: _grams(s, q)))


def literal(text: Column) -> Column:
    """``text`` as part of a pattern that matches it literally."""
    return F.regexp_replace(text, r"([%_\\])", r"\\$1")


def containing(text: Column) -> Column:
    """The pattern of the texts that contain ``text``."""
    return F.concat(F.lit("%"), literal(text), F.lit("%"))


def like_join(texts: DataFrame, patterns: DataFrame, text_col: str = "text", pattern_col: str = "pattern") -> DataFrame:
    """(text, pattern): the distinct texts that are LIKE the distinct patterns, ignoring case.
    NULL texts and patterns match nothing."""
    t = texts.select(F.col(f"`{text_col}`").alias("text")).filter("text is not null").distinct()
    t = t.withColumn("low", F.lower("text"))
    held = F.concat(F.array(F.lit("")), *[_grams(F.col("low"), q) for q in range(1, Q + 1)])
    posted = t.select("text", "low", F.explode(F.array_distinct(held)).alias("gram"))

    p = patterns.select(F.col(f"`{pattern_col}`").alias("pattern")).filter("pattern is not null").distinct()
    p = p.withColumn("shape", _protected(F.lower("pattern")))
    parts = F.split(F.translate("shape", "%_", _ANY * 2), _ANY)
    parts = F.transform(parts, lambda s: F.translate(s, _PERCENT + _LINE + _BACK, "%_\\"))
    p = p.withColumn("parts", parts).withColumn("q", F.least(F.lit(Q), F.array_max(F.transform("parts", F.length))))
    rule = F.col("shape")
    for mark, text in ((_BACK, "\\\\"), (_PERCENT, "\\%"), (_LINE, "\\_")):
        rule = F.replace(rule, F.lit(mark), F.lit(text))
    own = F.lit(None).cast("array<string>")
    for q in range(1, Q + 1):
        own = F.when(F.col("q") == q, _part_grams(q)).otherwise(own)
    own = F.coalesce(own, F.array(F.lit("")))
    looked = p.select("pattern", rule.alias("rule"), F.explode(F.array_distinct(own)).alias("gram"))
    # the rarest gram of each pattern; one that no text holds rules the pattern out
    common = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    weighed = looked.join(common, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chosen = weighed.groupBy("pattern", "rule").agg(F.min(F.struct("n", "gram")).alias("g"))
    chosen = chosen.filter("g.n > 0").select("pattern", "rule", F.col("g.gram").alias("gram"))
    met = posted.join(chosen, "gram")
    return met.filter(F.expr("low LIKE rule")).select("text", "pattern")
