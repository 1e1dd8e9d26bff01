"""Quality rules with risk-controlled cutoffs: exact binomial bounds on labelled rows; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, stored, text_or_empty

#: Words in the window whose repeats count.
WINDOW = 8
#: Each rule rejects a document whose value exceeds the cutoff; the cutoffs of one place, from the strictest on, are certified together.
RULES = {
    "symbol_ratio": [0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "dup_line_ratio": [0.05, 0.1, 0.2, 0.3, 0.5, 0.8],
    "repeat_ratio": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
    "mean_word_chars": [8.0, 9.0, 10.0, 12.0, 16.0, 24.0],
}
#: Upper ends (exclusive, in words) of the strata; longer documents form the last stratum.
STRATA = (100, 300, 1000)
#: Largest share of good documents that the cutoffs of a stratum may reject together, and the chance that any bound fails.
FALSE_REJECTION, FAILURE = 0.04, 0.05


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.when(F.size(h) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))).otherwise(F.array().cast("array<long>"))

    def covered(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
        starts = F.array_sort(F.transform(let(ordered, twice), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
        summed = F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")))
        return summed["n"]

    repeats = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    return let(let(hashes, windows), repeats)


def features(docs: DataFrame) -> DataFrame:
    """Counts of each text, by the row alone: no shuffle. Null text: no words.

    Windows are compared by 64-bit hashes of their words' hashes, within one text.
    """
    text = text_or_empty()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    word_counts = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    out = docs.select(
        "doc_id",
        F.length(F.regexp_replace(text, f"{SPACE}++", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]++", ""))).cast("long").alias("n_symbols"),
        line_counts.alias("_lines"),
        word_counts.alias("_words"),
    )
    return out.select(
        "doc_id",
        F.col("_words.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("_lines.n") - F.col("_lines.d")).cast("long").alias("n_dup_lines"),
        F.col("_words.r").cast("long").alias("n_repeat_words"),
        F.col("_lines.n").cast("long").alias("n_lines"),
    )


def with_rules(counts: DataFrame) -> DataFrame:
    """Add base_failed, the stratum and the value of each rule."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    stratum = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        stratum = F.when(F.col("n_words") < STRATA[k], k).otherwise(stratum)
    return counts.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        stratum.alias("stratum"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
        (F.col("word_chars") / n).alias("mean_word_chars"),
    )


def _log_factorial(n: Column) -> Column:
    """Stirling's series from 16 on (error under 1e-12), exact below."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    exact = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)]), F.least(n, F.lit(15)).cast("int") + 1)
    return F.when(n < 16, exact).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), k < n*p: the point probability at k times a falling series.

    Only terms within 40 standard deviations below k are added; the rest are under e**-800 of the first.
    """
    point = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(40 * F.sqrt(n.cast("double"))) + 40)
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    # From j to j - 1 the probability falls by j (1 - p) / ((n - j + 1) p).
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps.cast("long")),
        zero,
        lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term")),
    )
    return F.exp(point) * tail["sum"]


def cutoffs(measured: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, failure: float = FAILURE) -> DataFrame:
    """One row for each stratum with certified cutoffs: stratum, level, n_good, n_rejected and the cutoff of each rule, by its name.

    Good rows: quality 1. The rules' cutoffs form one fixed path of levels, from the loosest to the
    strictest. At each level the share of good documents that any rule rejects is tested against
    false_rejection by an exact (Clopper-Pearson) binomial bound; the walk ends at the first level
    that fails, so its levels need no correction among themselves, and Bonferroni's correction
    (failure / strata) covers the strata: with probability 1 - failure no stratum loses more than
    false_rejection of its good documents. Labels that repeat an id count once, good if any says so.
    Without enough labels (about 108 good rows of a stratum) nothing is certified.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_q")).where("_q = 1").select("doc_id")
    held = measured.where("not base_failed").join(good, "doc_id", "left_semi")
    levels = list(range(len(next(iter(RULES.values())))))
    rejected = [F.count_if(F.greatest(*[(F.col(rule) > cutoffs[level]).cast("int") for rule, cutoffs in RULES.items()]) == 1).alias(f"k{level}") for level in levels]
    by_stratum = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *rejected)
    n, most = F.col("n_good"), failure / (len(STRATA) + 1)
    passed, best = F.lit(True), F.lit(None).cast("int")
    for level in reversed(levels):
        k = F.col(f"k{level}")
        passed = passed & F.when(k < n * false_rejection, binomial_tail(k, n, false_rejection) <= most).otherwise(F.lit(False))
        best = F.when(passed, F.lit(level)).otherwise(best)
    found = by_stratum.withColumn("level", best).where("level is not null")
    at = lambda values: F.element_at(F.array(*values), F.col("level") + 1)
    return found.select("stratum", "level", "n_good", at([F.col(f"k{x}") for x in levels]).alias("n_rejected"), *[at([F.lit(float(c)) for c in cutoffs]).alias(rule) for rule, cutoffs in RULES.items()])


def judged(docs: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, failure: float = FAILURE) -> DataFrame:
    """One row for each row of docs: doc_id, counts, base_failed, kept, rejected_by (array of rule names).

    kept: not base_failed and no certified cutoff of its stratum exceeded. Null or empty text: no
    words, so base_failed. Null ids are judged but never join labels. Empty labels: base rules alone.
    """
    measured = stored(with_rules(features(docs)), "rules")
    found = cutoffs(measured, labels, false_rejection, failure)
    limits = found.select("stratum", *[F.col(rule).alias(f"_max_{rule}") for rule in RULES])
    out = measured.join(limits, "stratum", "left")  # at most one row for each stratum
    broken = F.array_compact(F.array(*[F.when(F.col(rule) > F.col(f"_max_{rule}"), F.lit(rule)) for rule in RULES]))
    out = out.withColumn("rejected_by", broken)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by",
    )
