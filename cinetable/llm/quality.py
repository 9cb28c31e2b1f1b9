"""Quality rules as a short-circuit cascade of projections in one stage.

Every rule is a rejection predicate over measures of a row. On a bounded sample the cost of each rule (from the
sample's characters and words and the measures that it needs beyond those already made) and its selectivity (rows
rejected of those that the rules before it leave over) are estimated; rules then run in descending order of rejection
per cost. A measure that no earlier rule has made stands behind the verdict so far, so a row pays only for the measures
of the rules up to its first rejection. The set of kept rows does not depend on the order, hence not on the sample.

Null and empty texts have no words. Texts of any length are measured whole. Rows are independent: ties and repeats
are judged one by one, an empty table gives an empty one, and extra columns do not matter.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, words

#: About so many rows, from at most so many files, are what cost and selectivity are estimated on.
SAMPLE_ROWS, SAMPLE_FILES = 1000, 4
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def word_chars(tokens: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(tokens, "")).cast("long")


def char_count(text: Column, chars: str) -> Column:
    """How many of `chars` the text holds: the length of what is left without the runs between them."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]+", "")).cast("long")


def filled_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)


def dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(tokens: Column, window: int = WINDOW) -> Column:
    """A 64-bit hash of each window of `window` tokens; no windows of fewer tokens than one more than that."""

    def windows(h: Column) -> Column:
        joint = lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, window)])
        return F.slice(F.transform(h, joint), 1, F.size(h) - (window - 1))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(tokens) > window, let(F.transform(tokens, lambda t: F.xxhash64(t)), windows)).otherwise(none)


def later_twins(in_order: Column) -> Column:
    """Of a sorted array the elements that equal the one before them."""
    return F.filter(in_order, lambda x, i: x == F.get(in_order, i - 1))


def repeat_words(hashes: Column, twins: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window which the same text holds at least twice, from the windows' hashes and the later of
    equal ones. Texts without any, the common case, cost nothing here; in the others windows are sorted by (hash,
    place), and the union of repeated windows is measured by its gaps."""

    def covered() -> Column:
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def lengths(p: Column) -> Column:
            gaps = F.transform(p, lambda at, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - at, F.lit(window))))
            return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

        return let(in_order, lambda s: let(starts(s), lengths))

    return F.when(F.size(twins) == 0, 0).otherwise(covered()).cast("long")


@dataclass(frozen=True)
class Measure:
    """A value of one row. `needs` are measures that it is made from. Costs are nanoseconds a character and a word of
    the text, as measured once on long prose; only their proportions matter."""

    value: Callable[[], Column]
    needs: tuple[str, ...] = ()
    per_char: float = 0.0
    per_word: float = 0.0


#: What rules are made from. Names with an underscore are intermediate.
MEASURES: dict[str, Measure] = {
    "_words": Measure(lambda: words(F.col("text")), (), 0, 800),
    "_lines": Measure(lambda: filled_lines(F.col("text")), (), 60, 0),
    "_windows": Measure(lambda: window_hashes(F.col("_words")), ("_words",), 0, 600),
    "_sorted": Measure(lambda: F.sort_array("_windows"), ("_windows",), 0, 100),
    "_twins": Measure(lambda: later_twins(F.col("_sorted")), ("_sorted",), 0, 100),
    "n_words": Measure(lambda: F.size("_words").cast("long"), ("_words",)),
    "word_chars": Measure(lambda: word_chars(F.col("_words")), ("_words",), 5, 0),
    "n_symbols": Measure(lambda: char_count(F.col("text"), SYMBOLS), (), 30, 0),
    "n_shouts": Measure(lambda: char_count(F.col("text"), "!"), (), 20, 0),
    # lengths of what runs leave behind: a count of matches would build an array of all letters
    "n_upper": Measure(lambda: F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\P{Lu}+", "")), (), 30, 0),
    "n_letters": Measure(lambda: F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\P{L}+", "")), (), 70, 0),
    "n_lines": Measure(lambda: F.size("_lines").cast("long"), ("_lines",)),
    "n_dup_lines": Measure(lambda: dup_lines(F.col("_lines")), ("_lines",), 5, 0),
    "n_repeat_words": Measure(lambda: repeat_words(F.col("_windows"), F.col("_twins")), ("_windows", "_twins"), 0, 400),
}


@dataclass(frozen=True)
class QualityRule:
    """`rejects` is a predicate over the column `text` and the measures in `needs`; its own cost is in nanoseconds a
    character, beyond that of its measures."""

    name: str
    rejects: Column
    needs: tuple[str, ...] = ()
    per_char: float = 0.0


def standard_rules() -> list[QualityRule]:
    """Cleaning rules on top of the base ones: symbol noise, shouting, repeated lines, too few letters."""
    return [
        QualityRule("symbols", F.col("n_symbols") * 10 > F.col("n_words"), ("n_symbols", "n_words")),
        QualityRule("dup_lines", (F.col("n_dup_lines") >= 2) & (F.col("n_dup_lines") * 100 > F.lit(35) * F.col("n_lines")), ("n_dup_lines", "n_lines")),
        QualityRule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")), ("word_chars", "n_words")),
        QualityRule("shouting", F.col("n_shouts") * 2 > F.col("n_words"), ("n_shouts", "n_words")),
        QualityRule("upper_case", F.col("n_upper") * 10 > F.col("n_letters") * 3, ("n_upper", "n_letters")),
        QualityRule("few_letters", F.col("n_letters") * 2 < F.col("word_chars"), ("n_letters", "word_chars")),
    ]


def base_rules() -> list[QualityRule]:
    return [
        QualityRule("too_short", F.col("n_words") < 10, ("n_words",)),
        QualityRule("repeats", F.col("n_repeat_words") * 100 > F.lit(20) * F.col("n_words"), ("n_repeat_words", "n_words")),
    ]


def made_of(names: Sequence[str], there: Sequence[str] = ()) -> list[str]:
    """The measures `names` and all that they are made of but for those already there, in an order to make them in."""
    out: list[str] = []

    def add(name: str) -> None:
        if name not in out and name not in there:
            for n in MEASURES[name].needs:
                add(n)
            out.append(name)

    for name in names:
        add(name)
    return out


def measured(df: DataFrame, names: Sequence[str], there: Sequence[str] = (), only: Column | None = None) -> DataFrame:
    """Adds measures of the column `text`, each in a projection of its own, and only of the rows where `only` holds."""
    for name in made_of(names, there):
        value = MEASURES[name].value()
        df = df.withColumn(name, value if only is None else F.when(only, value))
    return df


def fenced(rows: DataFrame, keep: Column) -> DataFrame:
    """The rows where `keep` holds. The optimizer can't move this filter below the projection it stands on, where it
    would write out every measure anew for each of its uses."""
    return rows.withColumn("_fence", F.spark_partition_id()).where(keep & (F.col("_fence") >= 0)).drop("_fence")


def bounded_sample(df: DataFrame) -> DataFrame:
    """About SAMPLE_ROWS rows of a few evenly spaced files; of all rows where `df` isn't read from files."""
    files = sorted({f.rpartition("/")[2] for f in df.inputFiles()})
    if len(files) > SAMPLE_FILES and "_metadata" not in df.columns:
        picked = files[:: -(-len(files) // SAMPLE_FILES)]
        with contextlib.suppress(AnalysisException):  # a join of files, say, has no file of its own
            df = df.where(F.col("_metadata.file_name").isin(picked))  # prunes the listing: other files aren't opened
    return df.sample(False, min(1.0, SAMPLE_ROWS / max(1, df.count())), 17)


@dataclass(frozen=True)
class Sampled:
    """What a sample tells: rows, their mean characters and words, and for each set of rules how many rows exactly
    these reject."""

    rows: int
    chars: float
    words: float
    rejected: dict[frozenset[str], int]


def sampled(sample: DataFrame, rules: Sequence[QualityRule]) -> Sampled:
    """One job over a sample's `text`. Sets of rules that occur are at most 2 to the number of rules."""
    verdicts = measured(sample.select("text"), sorted({n for r in rules for n in r.needs} | {"n_words"}))
    caught = F.array_compact(F.array(*[F.when(r.rejects, F.lit(r.name)) for r in rules]))
    found = verdicts.select(caught.alias("c"), "n_words", F.length("text").alias("n_chars")).groupBy("c").agg(F.count("*"), F.sum("n_chars"), F.sum("n_words")).collect()
    n = sum(r[1] for r in found)
    return Sampled(n, sum(r[2] or 0 for r in found) / max(1, n), sum(r[3] or 0 for r in found) / max(1, n), {frozenset(r[0]): r[1] for r in found})


def cost(rule: QualityRule, there: Sequence[str], of: Sampled) -> float:
    """Nanoseconds a row, with the measures `there` already made."""
    new = [MEASURES[n] for n in made_of(rule.needs, there)]
    return 1 + (sum(m.per_char for m in new) + rule.per_char) * of.chars + sum(m.per_word for m in new) * of.words


def ordered(rules: Sequence[QualityRule], of: Sampled, there: Sequence[str] = ()) -> list[QualityRule]:
    """By rejection per cost, the best first; ties by cost, then name. Each rule is weighed on the rows that those
    before it leave over, with the measures that these have made."""
    out: list[QualityRule] = []
    left, made, open_rules = dict(of.rejected), list(there), list(rules)
    while open_rules:
        costs = {r.name: cost(r, made, of) for r in open_rules}
        best = min(open_rules, key=lambda r: (-sum(n for names, n in left.items() if r.name in names) / costs[r.name], costs[r.name], r.name))
        out.append(best)
        open_rules.remove(best)
        made += made_of(best.needs, made)
        left = {names: n for names, n in left.items() if best.name not in names}
    return out


def _judged(docs: DataFrame, rules: Sequence[QualityRule] | None, text_col: str, keep: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows with _keep, the measures asked for, and rejected_by: the first rule that rejects a row, else null.

    Measures asked for are taken of every row. Any other is taken when the first rule that needs it is reached, and
    only of the rows that all rules before it pass.
    """
    rules = list(standard_rules() + base_rules() if rules is None else rules)
    rules = ordered(rules, sampled(bounded_sample(docs.select(F.col(text_col).alias("text"))), rules), made_of(measures))
    rows = measured(docs.select(F.struct(*keep).alias("_keep"), F.col(text_col).alias("text")), measures)
    made, verdict = made_of(measures), F.lit(None).cast("string")
    for rule in rules:
        if new := made_of(rule.needs, made):
            rows = measured(rows.withColumn("_verdict", verdict), rule.needs, made, F.col("_verdict").isNull())
            verdict, made = F.col("_verdict"), made + new
        verdict = F.coalesce(verdict, F.when(rule.rejects, F.lit(rule.name)))
    return rows.withColumn("rejected_by", verdict)


def judge_quality(docs: DataFrame, rules: Sequence[QualityRule] | None = None, text_col: str = "text", keep: Sequence[str] = ("doc_id",), measures: Sequence[str] = ()) -> DataFrame:
    """Columns `keep`, the measures asked for, and rejected_by (null for rows to keep)."""
    return _judged(docs, rules, text_col, keep, measures).select("_keep.*", *measures, "rejected_by")


def keep_good(docs: DataFrame, rules: Sequence[QualityRule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    return fenced(_judged(docs, rules, text_col, docs.columns, ()), F.col("rejected_by").isNull()).select("_keep.*")
