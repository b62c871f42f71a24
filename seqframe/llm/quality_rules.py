"""Quality rules with risk-controlled thresholds. [native]

Every step is a DataFrame operation. `statistics` counts, in each row on its own: words ([^\\x20\\x09-\\x0D]+), their code
points, symbols ([#*$%&|<>]), lines equal to an earlier line, and words in five-word windows that occur twice or more in the
text. Base rules reject texts of under 10 words or with over 20 % repeated words.

Method rules each compare one ratio with a cutoff of a stratum (a language). Cutoffs are not guessed. GRIDS makes a fixed
sequence of whole rule sets from the mildest to the strictest, each of which rejects all that the one before does. For each
stratum they are tested in that order on the labelled texts that pass the base rules (label 1: good), up to the first
failure, which needs no correction within a stratum. With n good texts of which k would be rejected, a set holds if the
exact binomial probability of k or fewer, were the true share of false rejections RISK, is at most the level: ALPHA divided by the
number of strata (Bonferroni). The strictest set before the first failure is used; with none, no rule is applied in
that stratum. So, with probability 1 - ALPHA at least, no stratum loses more than RISK of its good texts to all rules together.
With four strata, 86 good texts none of which is rejected are enough for a set to hold.

Counts of good texts by the first step that rejects them are combined before the shuffle; the tests run on the
table of strata x steps. Strata are joined by equality; Spark broadcasts them only if they are small.

Defined cases: a null or empty text has no words and fails the base rules. A null stratum is the stratum "". Without labels no
method rule applies. A label given twice for an id counts once, and an id with good and bad labels is no good one; a label
is of all rows with its id, which count as one text, the first by its counts. Repeated rows and null ids are returned as they are; a null id has no label.
Other columns are left out unless in `keep`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
RISK, ALPHA = 0.05, 0.05
SPACE = r"[\x20\x09-\x0D]+"
#: Rule name -> cutoffs, one for each step from the mildest to the strictest; a text with a ratio over a cutoff is rejected.
GRIDS = {
    "symbols": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02),  # symbols for a word
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.16, 0.13, 0.1, 0.07),  # lines equal to an earlier one, of lines with a word
    "repeats": (0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.1, 0.09, 0.07, 0.05, 0.03),  # repeated words, of words
    "long_words": (30.0, 25.0, 22.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5),  # code points a word
    "few_words": (1 / 11, 1 / 11, 1 / 12, 1 / 12, 1 / 13, 1 / 13, 1 / 14, 1 / 15, 1 / 17, 1 / 20, 1 / 24, 1 / 28, 1 / 33, 1 / 40),  # 1 for a word: short texts
}
TERMS = 2000  # of a binomial sum; a bound stands for the rest


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """How many words lie in five-word windows that occur twice or more."""

    def count(hashes: Column) -> Column:
        # Windows and their places, sorted: those equal to a neighbour are the repeated ones.
        def places(sorted_: Column) -> Column:
            n = F.size(sorted_)
            same = lambda i, j: F.get(sorted_, i)["h"] == F.get(sorted_, j)["h"]
            found = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | ((i < n - 1) & same(i, F.least(i + 1, n - 1))))
            return F.sort_array(F.transform(found, lambda i: F.get(sorted_, i)["i"]))

        def covered(at: Column) -> Column:
            step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step)["n"]

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, lambda s: _let(places(s), covered)))

    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    return F.when(n < WINDOW, F.lit(0)).otherwise(_let(windows, count))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def count(row: Column) -> Column:
        words = F.filter(F.split(row, SPACE), lambda w: w != "")
        lines = F.filter(F.split(row, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")

        def of_words(w: Column) -> Column:
            joined = F.array_join(w, "")
            return F.struct(
                F.size(w).cast("long").alias("n_words"), F.char_length(joined).cast("long").alias("word_chars"),
                (F.char_length(joined) - F.char_length(F.regexp_replace(joined, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"), _repeated(w).cast("long").alias("n_repeat_words"),
            )

        of_lines = lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines"))
        return F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"))

    found = docs.select(*keep, _let(text, count).alias("__s"))
    return found.select(*keep, "__s.w.n_words", "__s.w.word_chars", "__s.w.n_symbols", "__s.l.n_dup_lines", "__s.w.n_repeat_words", "__s.l.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratios() -> dict[str, Column]:
    per_word = lambda c: c / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": per_word(F.col("n_symbols")), "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": per_word(F.col("n_repeat_words")), "long_words": per_word(F.col("word_chars")), "few_words": per_word(F.lit(1.0)),
    }


def _log_factorial(n: Column) -> Column:
    """log(n!) for doubles from 0 on, by Stirling's series from n + 8 on."""
    x = n + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    steps = F.log(n + 1.0)
    for i in range(2, 9):
        steps += F.log(n + float(i))
    return series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p), from the term of k downward; 1 where k >= n p, where no test holds.

    After TERMS terms a geometric series, which is more than the rest, takes their place: the result is never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = lambda j: (k - j) * (1 - p) / ((n - k + j + 1) * p)

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * ratio(j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    terms = F.least(k, F.lit(float(TERMS))).cast("int")
    found = F.aggregate(F.sequence(F.lit(0), terms), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step)
    last = ratio(F.lit(float(TERMS)))
    rest = F.when(k > TERMS, found["term"] * last / (1 - last)).otherwise(F.lit(0.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(first * (found["sum"] + rest), F.lit(1.0)))


def first_step(grids: dict = GRIDS) -> Column:
    """The number (from 1) of the first rule set that rejects a text; one more than there are: none does. A ratio's cutoffs fall."""
    steps = len(next(iter(grids.values())))
    return F.least(*(F.lit(steps + 1) - sum((ratios()[name] > c).cast("int") for c in grid) for name, grid in grids.items()))


def thresholds(labelled: DataFrame, stratum: str = "stratum", risk: float = RISK, alpha: float = ALPHA, grids: dict = GRIDS) -> DataFrame:
    """stratum, step: the strictest rule set that holds; labelled: statistics of good texts and their stratum."""
    steps = len(next(iter(grids.values())))
    cells = labelled.groupBy(stratum, first_step(grids).alias("first")).agg(F.count("*").alias("n"))
    reject = cells.select(stratum, "n", "first", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i"))
    tests = reject.groupBy(stratum, "i").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first") <= F.col("i"), F.col("n")).otherwise(0)).alias("k"))
    level = alpha / max(1, labelled.select(stratum).distinct().count())
    tests = tests.withColumn("holds", binomial_tail(F.col("k"), F.col("n"), risk) <= level)
    failed = F.min(F.when(~F.col("holds"), F.col("i")))
    return tests.groupBy(stratum).agg((F.coalesce(failed, F.lit(steps + 1)) - 1).alias("step")).filter("step > 0")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", keep: tuple[str, ...] = (), risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """id_col, `keep`, the counts, base_failed, kept, reasons (of the method): a row for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("__id"), *keep, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("__text"))
    counted = scratch.table(statistics(source, "__text", ("__id", *keep, "stratum")).withColumn("base_failed", base_failed()))
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("least"), F.max(label_col).alias("most")).filter("least = 1 AND most = 1").select("__id")
    labelled = counted.filter(~F.col("base_failed")).join(good, "__id")
    counts_ = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    labelled = labelled.groupBy("__id").agg(F.min(F.struct(*counts_, "stratum")).alias("x")).select("x.*")
    found = scratch.table(thresholds(labelled, risk=risk, alpha=alpha))
    judged = counted.join(found, "stratum", "left")
    at = {name: F.element_at(F.array(*(F.lit(float(c)) for c in grid)), F.col("step")) for name, grid in GRIDS.items()}
    broken = F.filter(F.array(*(F.when(ratio > at[name], F.lit(name)) for name, ratio in ratios().items())), lambda x: x.isNotNull())
    return judged.select(F.col("__id").alias(id_col), *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), broken.alias("reasons"))
