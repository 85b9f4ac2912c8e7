"""Measures of repetition and quality of each text, as one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrill.llm.words import hashes, words
from graphrill.session import let

RUN = 8
#: Frequent words of the languages of the corpus that put spaces between words (not Japanese); fixed values.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with",
    "der", "die", "und", "das", "ist", "nicht", "von", "mit",
    "le", "la", "les", "et", "des", "est", "dans", "que",
    "el", "los", "las", "y", "en", "por", "con", "para",
    "и", "в", "на", "не", "что", "с", "по", "это",
]


def repeated_words(tokens: Column, run: int = RUN) -> Column:
    """How many words lie in a run of ``run`` words that also begins at an earlier word.

    The starts of all runs are sorted by the hash of the run; all but the first of equal runs are repeated, and each covers
    ``run`` words less those the one before it covers. Sorting makes it n log n in the words of a text. Runs are compared by
    64-bit hashes of 64-bit hashes of words.
    """

    def starts_of(h: Column) -> Column:
        of_run = lambda i: F.struct(F.xxhash64(*[h[i + j] for j in range(run)]).alias("k"), i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - run), of_run))

    def repeated(s: Column) -> Column:
        later = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: s[j]["k"] == s[j - 1]["k"])
        return F.sort_array(F.transform(later, lambda j: s[j]["i"]))

    def covered(at: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(-run).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(run), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, first, step, lambda a: a["n"])

    some = lambda h: F.when(F.size(h) > run, let(starts_of(h), lambda s: let(repeated(s), covered))).otherwise(0)
    return let(hashes(tokens), some)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


#: Each measure of a text; ``t`` is the text, ``w`` its words.
MEASURES = {
    "chars": lambda t, w: F.length(F.coalesce(t, F.lit(""))),
    "words": lambda t, w: F.size(w),
    "word_length": lambda t, w: _ratio(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), F.size(w)),
    "repeated_words": lambda t, w: repeated_words(w),
    "repeated_share": lambda t, w: _ratio(repeated_words(w), F.size(w)),
    "symbol_share": lambda t, w: _ratio(_count(t, r"[^\p{L}\p{N}\s]"), F.length(F.coalesce(t, F.lit("")))),
    "stop_share": lambda t, w: _ratio(F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))), F.size(w)),
    "unspaced_share": lambda t, w: _ratio(_count(t, r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"), F.length(F.coalesce(t, F.lit("")))),
    "stop_words": lambda t, w: F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in STOP_WORDS]))),
    "lines": lambda t, w: F.size(_lines(t)),
    "repeated_lines": lambda t, w: let(_lines(t), lambda x: _ratio(F.size(x) - F.size(F.array_distinct(x)), F.size(x))),
    "bullet_lines": lambda t, w: let(_lines(t), lambda x: _ratio(F.size(F.filter(x, lambda s: F.ltrim(s).rlike(r"\A[-*•#]"))), F.size(x))),
    "ellipsis_lines": lambda t, w: let(_lines(t), lambda x: _ratio(F.size(F.filter(x, lambda s: F.rtrim(s).rlike(r"(?:\.\.\.|…)\z"))), F.size(x))),
}


@dataclass(frozen=True)
class Threshold:
    """A rule of the table: a text is named by it if the measure lies outside [low, high]; a bound of None is none."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    #: A text exactly at ``high`` is named too.
    closed: bool = False
    #: The rule is about words between spaces; texts with more than UNSPACED of Chinese or Japanese letters are not judged.
    spaced: bool = False

    def holds(self, value: Column) -> Column:
        below = F.lit(False) if self.low is None else value < F.lit(self.low)
        above = F.lit(False) if self.high is None else (value >= F.lit(self.high) if self.closed else value > F.lit(self.high))
        return below | above if not self.spaced else (below | above) & (F.col("unspaced_share") <= UNSPACED)


#: Texts with a greater share of letters that need no spaces are not judged by rules on words between spaces.
UNSPACED = 0.2

#: The table of thresholds.
THRESHOLDS = [
    Threshold("too_short", "words", low=50),
    Threshold("word_length", "word_length", low=3, high=10, spaced=True),
    Threshold("symbols", "symbol_share", high=0.1),
    Threshold("stop_words", "stop_share", low=0.05, spaced=True),
    Threshold("repeated_lines", "repeated_lines", high=0.3),
    Threshold("bullet_lines", "bullet_lines", high=0.9),
    Threshold("ellipsis_lines", "ellipsis_lines", high=0.3),
    Threshold("repetition", "repeated_share", high=0.3, closed=True),
]


def measured(docs: DataFrame, text: str, measures: list[str], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, measures) of each row, in one projection without a shuffle; null and empty texts have no words and share 0."""
    t = F.col("_text")
    row = lambda w: F.struct(*[MEASURES[m](t, w).alias(m) for m in measures])
    rows = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias("_text"))
    return rows.select(doc_id, let(words(t), row).alias("_m")).select(doc_id, *[F.col(f"_m.{m}").alias(m) for m in measures])


def flagged(docs: DataFrame, text: str, thresholds: list[Threshold] = THRESHOLDS, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, measures of the table, reasons): the names of the thresholds that hold for each row, in the table's order."""
    needed = [t.measure for t in thresholds] + ["unspaced_share"] * any(t.spaced for t in thresholds)
    rows = measured(docs, text, list(dict.fromkeys(needed)), doc_id)
    names = F.array(*[F.when(t.holds(F.col(t.measure)), F.lit(t.name)) for t in thresholds])
    return rows.withColumn("reasons", F.array_compact(names))


__all__ = ["MEASURES", "THRESHOLDS", "Threshold", "flagged", "measured", "repeated_words"]
