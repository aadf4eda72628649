"""Quality classifier: a sparse ensemble of rules (operator 10).

Trees over text statistics give conjunctions, one per path from the root to a node. A logistic regression
with lasso weighs the rules, and what keeps a weight is compiled into one column expression, so scoring
is a projection.

At most `SAMPLE` labelled rows, in hash order, are fitted; all documents are scored. Language, source
and ids are not among the statistics.

Defined cases: a null text has the statistics of an empty one and gets a score; null labels are left out;
an id with several labels counts with each; without both classes among the labels the score is the share
of good labels (0.5 without labels); rows that repeat get equal scores.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjelldoc.llm.common import written
from fjelldoc.llm.quality_rules import COMMON_WORDS, class_counts, unusual, words_of

#: Bound of the labelled rows that are fitted.
SAMPLE = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.0005
STATISTICS = ("n_words", "mean_word", "upper", "digit", "punct", "symbol", "distinct_words", "common_words", "line_words", "distinct_lines", "caps_words")


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, is it greater, bound)."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        tests = [(F.col(s) > bound) if above else (F.col(s) <= bound) for s, above, bound in self.parts]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        """Probability of label 1 from the columns of `statistics`."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def statistics(docs: DataFrame, text: str, *carry: str) -> DataFrame:
    """The columns `carry` and the statistics of each whole text."""
    common = sorted({w for words in COMMON_WORDS.values() for w in words})
    t = F.col("_t")
    staged = docs.select(*[F.col(c) for c in carry], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    staged = staged.withColumn("_words", words_of(t)).withColumn("_lines", F.split(t, "\n")).withColumn("_unusual", unusual(t))
    counts = class_counts(F.col("_unusual"))
    staged = staged.select(
        *carry,
        F.size("_words").alias("_n"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(common))).alias("_common"),
        F.length(F.array_join("_words", "")).alias("_chars"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_lines")).alias("_distinct_lines"),
        F.size(F.filter("_words", lambda w: w.rlike(r"^\p{Lu}\p{Lu}"))).alias("_caps"),
        *[c.alias(f"_{k}") for k, c in counts.items()],
    )
    n, chars = F.greatest(F.col("_n"), F.lit(1)), F.greatest(F.col("_chars"), F.lit(1))
    values = F.struct(
        F.col("_n").cast("double").alias("n_words"),
        (F.col("_chars") / n).alias("mean_word"),
        *[(F.col(f"_{k}") / chars).alias(k) for k in ("upper", "digit", "punct", "symbol")],
        (F.col("_distinct") / n).alias("distinct_words"),
        (F.col("_common") / n).alias("common_words"),
        (F.col("_n") / F.col("_n_lines")).alias("line_words"),
        (F.col("_distinct_lines") / F.col("_n_lines")).alias("distinct_lines"),
        (F.col("_caps") / n).alias("caps_words"),
    )
    # as a generator's output, the statistics are made once, however often rules and filters refer to them
    return staged.select(*carry, F.explode(F.array(values)).alias("_values")).select(*carry, "_values.*")


def tree_rules(printed: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The rules of every node below the roots in a printed forest."""
    rules, path = [], []
    for line in printed.splitlines():
        found = re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if re.match(r"\s*Tree \d+", line):
            path = []
        elif found:
            branch, feature, sign, bound = found.groups()
            depth = len(line) - len(line.lstrip())
            path = [p for p in path if p[0] < depth]
            path.append((depth, (names[int(feature)], sign == ">", float(bound))))
            rules.append(Rule(tuple(sorted({test for _, test in path}))))
    return list(dict.fromkeys(rules))


def labelled_sample(labels: DataFrame, key: str, held_out: Column, label: str, most: int = SAMPLE) -> DataFrame:
    """At most `most` labels outside the held-out fold, the same ones each time."""
    return labels.where(~held_out & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(key, F.col(label).cast("double").alias("_label")).orderBy(F.xxhash64(F.col(key).cast("string")), key, "_label").limit(most)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ensemble:
    """Learns from the labels outside the held-out fold."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = written(labelled_sample(labels, key, held_out(key), label))
    joined = docs.select(key, text).join(F.broadcast(sample), key)  # at most SAMPLE rows
    data = written(statistics(joined, text, "_label"))
    share = data.agg(F.avg("_label").alias("share")).first()["share"]
    if share is None or share in (0.0, 1.0):
        share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return Ensemble(math.log(share / (1 - share)), ())
    points = VectorAssembler(inputCols=list(STATISTICS), outputCol="_x").transform(data).select("_label", "_x").persist()
    forest = RandomForestClassifier(labelCol="_label", featuresCol="_x", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="0.6").fit(points)
    points.unpersist()
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return Ensemble(math.log(share / (1 - share)), ())
    flags = data.select("_label", *[r.column().cast("double").alias(f"_r{i}") for i, r in enumerate(rules)])
    design = VectorAssembler(inputCols=[f"_r{i}" for i in range(len(rules))], outputCol="_x").transform(flags).select("_label", "_x").persist()
    model = LogisticRegression(labelCol="_label", featuresCol="_x", regParam=LASSO, elasticNetParam=1.0, standardization=True, maxIter=60).fit(design)
    design.unpersist()
    weights = [(float(w), r) for w, r in zip(model.coefficients.toArray(), rules, strict=True) if w]
    return Ensemble(float(model.intercept), tuple(weights))


def score(docs: DataFrame, ensemble: Ensemble, *carry: str, text: str = "text") -> DataFrame:
    """`carry` and `score` for each row."""
    return statistics(docs, text, *carry).select(*carry, ensemble.score().alias("score"))


def keep_good(docs: DataFrame, ensemble: Ensemble, least: float = 0.3, text: str = "text") -> DataFrame:
    """The documents that score `least` or more, with their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    return score(rows, ensemble, "_row", text="_text").where(F.col("score") >= least).select("_row.*")
