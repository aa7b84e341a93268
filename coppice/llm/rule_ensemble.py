"""A quality classifier as a sparse ensemble of readable rules.

A small random forest over text statistics supplies rules: every path from a
root is a conjunction of thresholds.  An L1-penalised logistic regression over
the rules keeps few of them and weighs them, and the result is compiled into
one Spark expression over the statistics, which scores every document without
Python beyond the statistics themselves.

The forest and the regression see at most about SAMPLE labelled documents,
drawn by a hash of their id; documents whose crc32(id) mod 4 is 2 are held out.

Defined cases: a null text is empty and scored as such; labels other than 0 and
1 are ignored, and of repeated labels of one id the smaller counts; without
labels of both classes the score is the share of label 1 (with one more of
each); repeated rows score alike, and so do rows with equal statistics; a text of
any length is looked at whole; a score equal to THRESHOLD predicts 1; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import ratio, with_stats
from .shared import broadcast_if_small, cut

SAMPLE, TREES, DEPTH, PENALTY, SEED, THRESHOLD = 20_000, 16, 3, 0.002, 11, 0.7

#: A rule: per feature the bound it must exceed and the bound it may not exceed.
Rule = tuple[tuple[int, float, float], ...]


def features(s: Column) -> list[Column]:
    """What rules test: ratios that do not depend on a text's length, and its length."""
    words, chars, lines = s["n_words"], s["word_chars"], s["n_lines"]
    return [
        F.log1p(words), ratio(chars, words), ratio(s["n_symbols"], words), ratio(s["n_symbols"], chars), ratio(s["n_marks"], chars),
        ratio(s["n_upper"], s["n_letters"]), ratio(s["n_exclaim"], words), ratio(s["n_pipes"], words), ratio(s["n_dup_lines"], lines),
        ratio(s["n_repeat_words"], words), ratio(s["n_top_word"], words), ratio(s["n_distinct"], words), ratio(words, lines),
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_LINE = re.compile(r"^( *)(?:(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)|Predict)")


def rules_of(description: str) -> list[Rule]:
    """Every path of the trees in a forest's description, without repeats."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, int, str, float]] = []
    for line in description.splitlines():
        if not (m := _LINE.match(line)):
            path = []
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        if m[2] is not None:
            path.append((depth, int(m[2]), m[3], float(m[4])))
            bounds: dict[int, tuple[float, float]] = {}
            for _, feature, sign, value in path:
                low, high = bounds.get(feature, (float("-inf"), float("inf")))
                bounds[feature] = (max(low, value), high) if sign == ">" else (low, min(high, value))
            found[tuple((f, *b) for f, b in sorted(bounds.items()))] = None
    return list(found)


def compiled(rule: Rule, values: list[Column]) -> Column:
    tests = [values[f] > low for f, low, _ in rule if low != float("-inf")] + [values[f] <= high for f, _, high in rule if high != float("inf")]
    return reduce(lambda a, b: a & b, tests)


class RuleEnsemble:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float, weighted: list[tuple[float, Rule]]):
        self.intercept, self.weighted = intercept, weighted

    @classmethod
    def fit(cls, labelled: DataFrame) -> RuleEnsemble:
        """From ``labelled``: values array<double>, label double; a bounded table."""
        counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
        bad, good = counts.get(0.0, 0), counts.get(1.0, 0)
        if not bad or not good:
            return cls(log((good + 1) / (bad + 1)), [])
        values = F.col("values")
        data = labelled.select("label", "values", array_to_vector("values").alias("vector"))
        forest = RandomForestClassifier(featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.6, seed=SEED).fit(data)
        rules = rules_of(forest.toDebugString)
        columns = [values[i] for i in range(forest.numFeatures)]
        if not rules:
            return cls(log((good + 1) / (bad + 1)), [])
        met = cut(data.select("label", array_to_vector(F.array(*[compiled(r, columns).cast("double") for r in rules])).alias("met")))
        lasso = LogisticRegression(featuresCol="met", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(met)
        weights = lasso.coefficients.toArray().tolist()
        return cls(float(lasso.intercept), [(w, r) for w, r in zip(weights, rules, strict=True) if w])

    def score(self, values: list[Column]) -> Column:
        odds = F.lit(self.intercept)
        for weight, rule in self.weighted:
            odds = odds + F.when(compiled(rule, values), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = cut(with_stats(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"]))
    given = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    given = given.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, given.count()))
    drawn = given.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    values = features(F.col("stats"))
    # Only statistics of drawn documents move; of several texts of an id the smallest by a hash is taken.
    rows = stats.join(broadcast_if_small(cut(drawn)), "doc_id").select("doc_id", "quality", F.array(*[v.cast("double") for v in values]).alias("values"))
    own = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("values").alias("hash"), "values")).alias("own"))
    training = own.repartition(8, "doc_id").sortWithinPartitions("doc_id").select(F.col("own.values").alias("values"), F.col("quality").cast("double").alias("label"))
    ensemble = RuleEnsemble.fit(cut(training))
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ensemble.score(values).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
