"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a cheap test over counts of the text. A sample of rows gives every rule's rate of rejection and the elements it
touches; rules are then tried by rejection per cost, and a row that one rule rejects is not looked at by the later ones. The
order changes only the work, never the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Rows that the estimate of costs and rejections reads.
SAMPLE_ROWS = 512


@dataclass(frozen=True)
class Rule:
    """``rejects`` is evaluated lazily; ``touches`` counts the elements it looks at, ``unit`` is the cost of one of them."""

    name: str
    rejects: Column
    touches: Column
    unit: float = 1.0


def measured(docs: DataFrame, carried: Column, text_col: str = "text") -> DataFrame:
    """The carried column, ``_text, _words`` and the base counts of each row, all exact and over the whole text.

    n_words; word_chars, code points in words; n_symbols, characters of ``#*$%&|<>``; n_dup_lines, lines with a word that
    equal an earlier one; n_repeat_words, words inside three-word windows that occur twice or more. Null and empty texts
    have zero counts.
    """
    rows = docs.select(carried.alias("_carried"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    lines = F.expr(r"transform(filter(split(_text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]'), l -> xxhash64(l))")
    rows = rows.withColumn("_lines", lines)
    windows = F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(F.expr("transform(sequence(1, cast(n_words as int) - 2), i -> xxhash64(element_at(_words, i), element_at(_words, i + 1), element_at(_words, i + 2)))"))
    rows = rows.withColumn("_windows", windows)
    # Only texts with a repeated window sort theirs: equal windows are then neighbours, with their places in order.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(repeats, F.expr("sort_array(transform(_windows, (h, i) -> struct(h as h, i as i)))")))
    places = "sort_array(transform(filter(_sorted, (x, k) -> (k > 0 and _sorted[k - 1].h = x.h) or (k + 1 < size(_sorted) and _sorted[k + 1].h = x.h)), x -> x.i))"
    rows = rows.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.expr(places)))
    # The words covered by windows that begin at sorted places: three for each, less what overlaps the one before.
    covered = "aggregate(transform(_places, (p, k) -> if(k = 0, 3, least(3, p - _places[k - 1]))), 0L, (a, x) -> a + x)"
    return rows.select(
        "_carried",
        "_text",
        "_words",
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Fewer than 50 words, or over half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Limits that keep prose of any language with spaced words and reject shouting, markup, tables and boilerplate."""
    words, count = F.col("_words"), F.col("n_words")
    share = lambda condition: F.try_divide(F.size(F.filter(words, condition)), count)
    return [
        Rule("mean_word_length", ~F.try_divide(F.col("word_chars"), count).between(2, 14), F.lit(1)),
        Rule("symbols", F.col("n_symbols") > 0.1 * count, F.lit(1)),
        Rule("duplicate_lines", F.col("n_dup_lines") > 0.4 * F.col("_n_lines"), F.lit(1)),
        Rule("shouting", F.length(F.regexp_replace("_text", r"\P{Lu}+", "")) > 0.4 * F.col("word_chars"), F.length("_text"), 0.02),
        Rule("words_without_letters", share(lambda w: ~w.rlike(r"\p{L}")) > 0.3, count, 0.3),
    ]


def order_rules(measured_rows: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per cost over those of ``sample_rows`` rows that pass the base, as one small read.

    One after the other, the rule is next that rejects most per cost among the rows that those before it pass, so a rule that
    only repeats what another one finds comes late. The rows are filtered here: a filter in the plan would be pushed below the projections and copy their expressions.
    """
    tests = [c for k, r in enumerate(rules) for c in (F.coalesce(r.rejects, F.lit(False)).alias(f"r{k}"), (r.touches * r.unit).cast("double").alias(f"t{k}"))]
    found = [r for r in measured_rows.select(base_failed().alias("failed"), *tests).limit(sample_rows).collect() if not r["failed"]]
    if not found:
        return rules
    order, left = [], list(range(len(rules)))
    while left:
        score = {k: (sum(x[f"r{k}"] for x in found) + 0.5) / (sum(x[f"t{k}"] for x in found) + 1.0) for k in left}
        order.append(max(left, key=lambda k: (score[k], -k)))
        left.remove(order[-1])
        found = [x for x in found if not x[f"r{order[-1]}"]]
    return [rules[k] for k in order]


def verdict(rows: DataFrame, rules: list[Rule] | None, sample_rows: int) -> Column:
    """Whether a measured row passes the base and then every rule, each looked at only if the ones before it pass."""
    cascade = F.lit(True)
    for rule in reversed(order_rules(rows, rules or default_rules(), sample_rows)):
        cascade = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(False)).otherwise(cascade)
    return F.when(base_failed(), F.lit(False)).otherwise(cascade)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id_col``, the base counts, ``base_failed`` and ``kept`` for each row.

    A null or empty text fails the base. Repeated rows each give a row; a null id stays; other columns are not read; an
    empty table gives an empty result.
    """
    rows = measured(docs, F.col(id_col), text_col)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(F.col("_carried").alias(id_col), *counts, base_failed().alias("base_failed"), verdict(rows, rules, sample_rows).alias("kept"))


def keep_passing(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of the rows that pass; null and empty texts fail, repeated rows and ties are judged alike, an empty table stays empty.

    Rows go through a generator and not a filter, which would be pushed below the projections with copies of their expressions.
    """
    rows = measured(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text_col)
    return rows.select(F.inline(F.when(verdict(rows, rules, sample_rows), F.array("_carried"))))
