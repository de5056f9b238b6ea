"""Quality by a sparse rule ensemble: tree paths as rules, lasso weights, compiled to Spark columns.

Statistics of a text are computed in Python, in one pass.  A small random forest over a bounded sample of labelled
rows gives the rules, a logistic regression with an L1 penalty keeps few of them, and what remains is one column
expression over the statistics.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from granary.llm.batches import map_rows
from granary.session import settle

# fixed values: characters counted as symbols and marks that end a sentence
SYMBOL = re.compile(r"[#*$%&|<>@{}\[\]=_~^\\]")
DIGIT = re.compile(r"[0-9]")
ENDS = ".!?…"

STATISTICS = (
    "words word_length long_words upper_words title_words distinct_words repeated_windows stutter symbols bars bangs "
    "digits letter_words commas stops lines line_words closed_lines repeated_lines short_lines top_word compression"
).split()

#: Labelled rows the model is fitted on: those with the smallest hash of their id.
SAMPLE_ROWS = 12_000
PARTITIONS = 8


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, shares where a count would grow with it; all 0 for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = sum(map(len, words))
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    windows = list(zip(lower, lower[1:], lower[2:]))
    lines = [line for line in text.split("\n") if line.strip()]
    raw = text.encode("utf-8")
    sizes = [line.count(" ") + 1 for line in lines]
    return [
        math.log1p(n),
        chars / n,
        sum(len(w) > 20 for w in words) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        len(counts) / n,
        1 - len(set(windows)) / len(windows) if windows else 0.0,
        sum(map(str.__eq__, lower, lower[1:])) / n,
        len(SYMBOL.findall(text)) / chars,
        text.count("|") / n,
        text.count("!") / n,
        len(DIGIT.findall(text)) / chars,
        sum(map(str.isalpha, words)) / n,
        text.count(",") / n,
        text.count(".") / n,
        math.log1p(len(lines)),
        math.log1p(sum(sizes) / len(lines)),
        sum(line.rstrip()[-1] in ENDS for line in lines) / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(size < 5 for size in sizes) / len(lines),
        counts.most_common(1)[0][1] / n,
        len(zlib.compress(raw, 1)) / len(raw),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, <statistics>)`` for every row; null texts count as empty."""
    schema = "doc_id long, " + ", ".join(f"{name} double" for name in STATISTICS)

    def make():
        def run(columns):
            rows = [statistics(t) for t in columns["text"]]
            return {"doc_id": columns["doc_id"]} | {name: [r[i] for r in rows] for i, name in enumerate(STATISTICS)}

        return run

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, make, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of comparisons of statistics with thresholds: (statistic, at most?, threshold)."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = None
        for name, at_most, threshold in self.parts:
            part = F.col(name) <= F.lit(threshold) if at_most else F.col(name) > F.lit(threshold)
            out = part if out is None else out & part
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if a else '>'} {t:.6g}" for n, a, t in self.parts)


@dataclass(frozen=True)
class Ensemble:
    """A bias and weighted rules; the score is the logistic function of the bias and the weights of rules that hold."""

    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def sample_of(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``rows`` labelled documents, those with the smallest hash of their id.

    Each id gives one row whatever the rows it stands in: the text of the smallest hash, and the largest of its labels.
    Ids without a text row give none; null ids and labels other than 0 and 1 are left out; empty tables give an empty
    sample; very long texts are taken whole; other columns are ignored.
    """
    chosen = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(target).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mine = texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows of two numbers
    # of many rows with one id every map task hands on one
    one = mine.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return one.select("doc_id", "least.text", "label")


SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-\dEe.+]+)\)$")


def tree_rules(described: str) -> set[Rule]:
    """Rules of all paths from a root, inner ends included, of a forest as Spark describes it."""
    rules, path = set(), []
    for line in described.split("\n"):
        found = SPLIT.match(line)
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, (STATISTICS[int(found[3])], found[4] == "<=", float(found[5]))))
            rules.add(Rule(tightest(p for _, p in path)))
    return rules


def tightest(parts) -> tuple:
    """Parts in order with one bound per statistic and direction."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, at_most, threshold in parts:
        old = bounds.get((name, at_most))
        bounds[name, at_most] = threshold if old is None else (min if at_most else max)(old, threshold)
    return tuple((name, at_most, threshold) for (name, at_most), threshold in sorted(bounds.items()))


@dataclass(frozen=True)
class Fit:
    trees: int = 12
    depth: int = 3
    #: Strength of the L1 penalty, and the most rules that enter the lasso, those that part the labels best.
    penalty: float = 0.002
    rules: int = 120
    seed: int = 5


def fit(sample: DataFrame, how: Fit = Fit()) -> Ensemble:
    """Rules and weights from ``sample`` (``text, label``).  Without rows, or with one label only, a bias alone."""
    known = settle(with_statistics_and_label(sample))
    count, positive = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not count or positive in (0, count):
        share = (positive + 1) / (count + 2)
        return Ensemble(math.log(share / (1 - share)), ())
    # a bounded sample: more partitions would only lengthen every step of the fit
    train = settle(known.coalesce(PARTITIONS).withColumn("weight", F.when(F.col("label") == 1, F.lit(count / (2 * positive))).otherwise(F.lit(count / (2 * (count - positive))))))
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(train)
    forest = RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=how.seed, weightCol="weight")
    grown = forest.fit(vectors)
    rules = sorted(tree_rules(grown.toDebugString), key=str)
    if not rules and grown.totalNumNodes > how.trees:
        raise RuntimeError("the forest has splits, but none could be read from its description")
    rules = telling(train, rules, how.rules)
    held = train.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    names = [f"r{i}" for i in range(len(rules))]
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=how.penalty, maxIter=60, standardization=False)
    model = lasso.fit(VectorAssembler(inputCols=names, outputCol="features").transform(held))
    weights = tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-6)
    return Ensemble(float(model.intercept), weights)


def with_statistics_and_label(sample: DataFrame) -> DataFrame:
    schema = "label double, " + ", ".join(f"{name} double" for name in STATISTICS)

    def make():
        def run(columns):
            rows = [statistics(t) for t in columns["text"]]
            return {"label": columns["label"]} | {name: [r[i] for r in rows] for i, name in enumerate(STATISTICS)}

        return run

    return map_rows(sample.select("label", "text"), make, schema)


def telling(train: DataFrame, rules: list[Rule], most: int) -> list[Rule]:
    """The rules whose share among positive rows differs most from that among negative ones, in order."""
    if not rules:
        return rules
    shares = []
    for i, rule in enumerate(rules):
        holds = F.when(rule.column(), 1.0).otherwise(0.0)
        shares.append(F.abs(F.avg(F.when(F.col("label") == 1, holds)) - F.avg(F.when(F.col("label") == 0, holds))).alias(f"d{i}"))
    gaps = train.agg(*shares).first()
    order = sorted(range(len(rules)), key=lambda i: (-gaps[i], i))
    return [rules[i] for i in sorted(order[:most])]


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``: the chance of label 1, empty and null texts included.

    Repeated rows and null ids keep a row each; an empty table gives an empty table; other columns are ignored.
    """
    return with_statistics(docs).select("doc_id", model.column().alias("score"))
