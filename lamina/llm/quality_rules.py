"""Quality rules as a learned decision list, in DataFrame operations only.

`measure` computes statistics of each whole text. `fit` learns an ordered list of threshold conjunctions from
labelled documents by sequential covering: a rule grows one condition at a time on two thirds of the rows, is
pruned from its end on the other third, and is kept only if it is precise enough there; what it covers is set
aside. Spark counts (feature, bin, label) histograms for each step, so the driver sees counts and never rows.
`DecisionList.reject` is one ordered CASE expression.

Results for unusual input: a null text has no words and fails the base rules; without labels of both kinds the
list is empty and only the base rules decide; repeated rows get equal results; very long texts are measured
whole; null identifiers and ties are judged by their text alone; an empty table gives an empty result. Other columns are
carried along, but ones named as those that are added (n_words, f_*, kept, rule) are replaced: pass the row as a struct.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import WORD_GAP, documents, text_of, written

WINDOW_WORDS = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Labelled rows that a fit looks at, at most; which ones is decided by a hash of the identifier.
FIT_ROWS = 200_000
MAX_RULES = 8
MAX_CONDITIONS = 3
BINS = 32
#: A rule needs this share of bad rows among those that it covers in the pruning part, and that many of them.
MIN_PRECISION = 0.97
MIN_COVER = 3

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the rules: ratios, so that they mean the same for texts of any length.
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "distinct_share": "n_distinct_words / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "words_per_line": "n_words / n_lines",
}


def _count_of(text: Column, characters: str) -> Column:
    """Number of characters of a class; dropping the long runs of all others is cheaper than looking at each."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _paired(values: Column, by: int) -> Column:
    """For each i the hash of values[i] and values[i + by]; shorter by `by`."""
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), _shifted(values, by), lambda a, b: F.xxhash64(a, b))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once for the row."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def sites(pairs: Column) -> Column:
        n = F.size(pairs) - 1
        twice = F.zip_with(
            F.slice(pairs, 1, n),
            F.slice(pairs, 2, n),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")),
        )
        return F.sort_array(F.array_distinct(F.flatten(twice)))

    def length(at: Column) -> Column:
        n = F.size(at) - 1
        gaps = F.zip_with(F.slice(at, 1, n), F.slice(at, 2, n), lambda a, b: F.least(b - a, F.lit(WINDOW_WORDS)))
        return F.aggregate(gaps, F.lit(WINDOW_WORDS).cast("long"), lambda s, g: s + g)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return _let(ordered, lambda pairs: _let(sites(pairs), length))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with STATISTICS and the further counts that FEATURES use."""
    text = text_of(text_col)
    step = docs.withColumns(
        {
            "__words": F.filter(F.split(text, WORD_GAP), lambda w: w != ""),
            "__lines": F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))),
        }
    )
    step = step.withColumns({"__hashes": F.transform("__words", lambda w: F.xxhash64(w))})
    # Windows of 2, 4 and 8 words, a projection each: every level refers to the one below several times, and one
    # expression would compute it as often.
    step = step.withColumn("__two", _paired(F.col("__hashes"), 1))
    step = step.withColumn("__four", _paired(F.col("__two"), 2))
    step = step.withColumn("__windows", _paired(F.col("__four"), 4))
    has_repeat = F.size(F.array_distinct("__windows")) < F.size("__windows")
    return step.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": _count_of(text, SYMBOLS),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(has_repeat, _covered(F.col("__windows"))).otherwise(F.lit(0)).cast("long"),
            "n_marks": _count_of(text, r"!?;:=_{}\[\]\\/~^"),
            "n_lines": F.size("__lines").cast("long"),
            "n_distinct_words": F.size(F.array_distinct("__hashes")).cast("long"),
            "n_upper": _count_of(text, r"\p{Lu}"),
            "n_digits": _count_of(text, "0-9"),
        }
    ).drop("__words", "__lines", "__hashes", "__two", "__four", "__windows")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def with_features(measured: DataFrame) -> DataFrame:
    def ratio(expression: str) -> Column:
        top, bottom = expression.split(" / ")
        return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), F.lit(0.0))

    return measured.withColumns({f"f_{k}": ratio(v) for k, v in FEATURES.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = F.col(f"f_{self.feature}")
        return f > F.lit(self.threshold) if self.above else f <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def rule_number(self) -> Column:
        """Of the first rule that holds, from 1; 0 if none does."""
        if not self.rules:
            return F.lit(0)
        out = F.when(self.rules[0].column(), 1)
        for n, rule in enumerate(self.rules[1:], 2):
            out = out.when(rule.column(), n)
        return out.otherwise(0)

    def reject(self) -> Column:
        return self.rule_number() > 0


def _best(counts: dict, thresholds: dict[str, list[float]], total_good: int, total_bad: int) -> tuple[float, Condition] | None:
    """The condition with the largest information gain for the bad class on the growing part (FOIL's measure)."""
    from math import log2

    base = log2(max(total_bad, 1e-9) / (total_good + total_bad))
    best = None
    for name, cuts in thresholds.items():
        good = [counts.get((name, b, 0), 0) for b in range(len(cuts) + 1)]
        bad = [counts.get((name, b, 1), 0) for b in range(len(cuts) + 1)]
        for i, cut in enumerate(cuts):
            g, b = sum(good[: i + 1]), sum(bad[: i + 1])
            for above, gg, bb in ((False, g, b), (True, total_good - g, total_bad - b)):
                if bb and (gain := bb * (log2(bb / (gg + bb)) - base)) > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Condition(name, above, cut))
    return best


def fit(rows: DataFrame, bad_col: str = "bad", id_col: str = "doc_id", max_rows: int = FIT_ROWS) -> DecisionList:
    """Learns from `rows`, which have the columns of `with_features` and `bad_col` (0 or 1)."""
    names = list(FEATURES)
    order = F.xxhash64(F.lit("fit"), F.col(id_col))
    cuts_sql = [F.percentile_approx(f"f_{n}", [i / BINS for i in range(1, BINS)], 10_000).alias(n) for n in names]
    table = written(
        rows.where(F.col(bad_col).isNotNull())
        .orderBy(order)
        .limit(max_rows)
        .select(*[f"f_{n}" for n in names], F.col(bad_col).cast("int").alias("bad"), F.pmod(F.xxhash64(F.lit("part"), F.col(id_col)), F.lit(3)).alias("part")),
        "labelled-statistics",
    )
    found = table.agg(*cuts_sql).first()
    thresholds = {n: sorted(set(found[n] or [])) for n in names}

    def binned(n: str) -> Column:
        cuts = thresholds[n]
        return F.aggregate(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), F.lit(0), lambda a, c: a + F.when(F.col(f"f_{n}") > c, 1).otherwise(0))

    long = written(
        table.withColumn("bins", F.array(*[F.struct(F.lit(n).alias("feature"), binned(n).alias("bin")) for n in names])),
        "labelled-bins",
    )

    def histogram(where: Column) -> dict:
        got = long.where(where).select("bad", F.explode("bins").alias("x")).groupBy("x.feature", "x.bin", "bad").count().collect()
        return {(r["feature"], r["bin"], r["bad"]): r["count"] for r in got}

    def totals(where: Column, rules: list[Column]) -> list[tuple[int, int]]:
        sums = [F.sum(F.when(c & (F.col("bad") == v), 1).otherwise(0)) for c in rules for v in (0, 1)]
        got = long.where(where).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        return [(got[2 * i] or 0, got[2 * i + 1] or 0) for i in range(len(rules))]

    def widened(c: Condition, where: Column) -> Condition:
        """The threshold moved half way to the bad rows that it covers, so that good rows just beyond those
        seen keep a margin."""
        f, sign = F.col(f"f_{c.feature}"), 1 if c.above else -1
        inside = c.column() & (F.col("bad") == 1)
        got = long.where(where).agg(
            F.percentile_approx(F.when(inside, sign * f), 0.1, 10_000).alias("bad"),
            F.max(F.when(~c.column() & (F.col("bad") == 0), sign * f)).alias("good"),
        ).first()
        if got["bad"] is None or got["good"] is None or got["bad"] <= got["good"]:
            return c
        return Condition(c.feature, c.above, sign * (got["bad"] + got["good"]) / 2)

    out = DecisionList()
    growing, pruning = F.col("part") > 0, F.col("part") == 0
    for _ in range(MAX_RULES):
        rest = ~out.reject()
        conditions: list[Condition] = []
        covered = F.lit(True)
        for _ in range(MAX_CONDITIONS):
            counts = histogram(growing & rest & covered)
            first = names[0]
            good, bad = (sum(v for (n, _, b), v in counts.items() if n == first and b == k) for k in (0, 1))
            if not good or not bad or (best := _best(counts, thresholds, good, bad)) is None:
                break
            condition = widened(best[1], growing & rest & covered)
            conditions.append(condition)
            covered = covered & condition.column()
        if not conditions:
            break
        stems = [Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)]
        scored = [(b / (g + b), -k, s) for k, (s, (g, b)) in enumerate(zip(stems, totals(pruning & rest, [s.column() for s in stems]), strict=True)) if b >= MIN_COVER]
        if not scored or max(scored, key=lambda x: x[:2])[0] < MIN_PRECISION:
            break
        out.rules.append(max(scored, key=lambda x: x[:2])[2])
    return out


def bad_labels(labels: DataFrame, id_col: str = "doc_id", max_rows: int = FIT_ROWS) -> DataFrame:
    """`id_col, bad` of at most `max_rows` labelled documents, chosen by a hash of the identifier; `bad` is 1 for low
    quality. The bound makes the table fit for a broadcast."""
    judged = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.min("quality") < 1).cast("int").alias("bad"))
    return written(judged.orderBy(F.xxhash64(F.lit("fit"), F.col(id_col))).limit(max_rows), "labels")


def measured(docs: DataFrame, name: str = "measured") -> DataFrame:
    """Identifier and statistics of `docs` (doc_id, text), written before any filter, which Spark would otherwise
    push below the statistics and compute them twice."""
    return written(with_features(measure(docs)).drop("text"), name)


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """`docs` with statistics, `base_failed`, `rule` (0: none) and `kept`. `kept` counts as not deterministic, so
    that a filter on it stays above the statistics instead of computing them a second time."""
    return decided(with_features(measure(docs)), rules)


def decided(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    out = statistics.withColumns({"base_failed": base_failed(), "rule": rules.rule_number()})
    here = F.monotonically_increasing_id() >= 0
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0) & here)


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DecisionList:
    """A decision list from the labelled ones of `docs`, which are the only ones that are measured for it."""
    bad = bad_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    some = measured(docs.select("doc_id", "text").join(F.broadcast(bad), "doc_id"), "labelled")
    return fit(some.where(~base_failed()))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = measured(documents(spark, sf_dir).select("doc_id", "text"))
    bad = bad_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rules = fit(statistics.join(F.broadcast(bad), "doc_id").where(~base_failed()))
    return decided(statistics, rules).select("doc_id", *STATISTICS, "base_failed", "kept", "rule")
