"""Toxicity by a linear classifier that is penalised where swapping identity terms would change its score."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granary.llm.batches import map_rows, pieces
from granary.llm.rule_ensemble import sample_of
from granary.session import settle

# fixed values: terms that name groups of people in English, German, French and Spanish; a group's terms stand in for one
# another, and its last is the neutral one
IDENTITY = (
    ("women", "men", "people"),
    ("woman", "man", "person"),
    ("girl", "boy", "child"),
    ("female", "male", "human"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "believers"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("mexican", "chinese", "american", "african", "european", "indian"),
    ("blind", "deaf", "disabled", "elderly", "young"),
    ("frauen", "männer", "menschen"),
    ("frau", "mann", "mensch"),
    ("mädchen", "junge", "kind"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten", "gläubige"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("ausländer", "flüchtlinge", "einwanderer", "einheimische", "bürger"),
    ("türken", "polen", "russen", "franzosen", "deutsche"),
    ("blinde", "gehörlose", "behinderte", "alte"),
    ("femmes", "hommes", "gens"),
    ("femme", "homme", "personne"),
    ("fille", "garçon", "enfant"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées", "croyants"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("étrangers", "réfugiés", "immigrés", "autochtones", "citoyens"),
    ("aveugles", "sourds", "handicapés", "vieux", "jeunes"),
    ("mujeres", "hombres", "personas"),
    ("mujer", "hombre", "persona"),
    ("niña", "niño", "criatura"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos", "creyentes"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("extranjeros", "refugiados", "inmigrantes", "nativos", "ciudadanos"),
    ("ciegos", "sordos", "discapacitados", "ancianos", "jóvenes"),
)
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)

#: Labelled rows the classifier is fitted on: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class Fit:
    #: Features that enter the model at most; the toxic rows a feature needs, how many standard errors its rate among
    #: them must lie above its rate among other rows, and how many times as high it must be.
    features: int = 400
    min_rows: int = 5
    min_z: float = 3.5
    min_ratio: float = 3.0
    #: Ridge penalty, and weight of the squared change of a sentence's logit under a swap.
    ridge: float = 1.0
    swap_penalty: float = 4.0
    steps: int = 30
    #: Groups of terms that stand in for one another.
    identity: tuple[tuple[str, ...], ...] = IDENTITY
    #: Groups found in the sample itself: the commonest words looked at, their letters and rows at least, by how many
    #: standard errors their rates may differ between the labels, the neighbours they are compared by, and how alike
    #: (cosine) these must be.
    mined: int = 200
    mined_letters: int = 4
    mined_rows: int = 20
    mined_z: float = 1.0
    neighbours: int = 400
    alike: float = 0.6


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]
    #: Groups found in the sample, labelled rows and those with a swapped form, and the mean squared change of their logit.
    groups: tuple[tuple[str, ...], ...] = ()
    rows: int = 0
    rows_swapped: int = 0
    swap_gap: float = 0.0

    def score(self, text: str | None) -> float:
        return self.of(features(text, self.weights))

    def of(self, present: set[str]) -> float:
        # summed in order of the names, so that a score does not depend on how a set is laid out
        total = self.bias + sum(self.weights[f] for f in sorted(present))
        return float(1 / (1 + np.exp(-total)))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def named(words: set[str]) -> set[str]:
    """Features of a set of words: the words, and their stems of 4 to 6 letters marked by a dash."""
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


def features(text: str | None, known) -> set[str]:
    """Those of the text's features that ``known`` holds; others are not made up on the way."""
    found, text = set(), (text or "").lower()
    for match in WORD.finditer(text):
        word = match.group()
        if word in known:
            found.add(word)
        for n in STEMS:
            if len(word) > n and (stem := word[:n] + "-") in known:
                found.add(stem)
    return found


def swap_table(groups: tuple[tuple[str, ...], ...]) -> dict[str, list[str]]:
    """For each term what it is swapped with: the next of its group and the group's last, the neutral one."""
    table = {}
    for group in groups:
        for i, term in enumerate(group):
            table[term] = [t for t in dict.fromkeys((group[(i + 1) % len(group)], group[-1])) if t != term]
    return table


def swapped(words: set[str], swaps: dict[str, list[str]]) -> list[set[str]]:
    """The words of a text after each of its terms was swapped, one set for each way to swap."""
    terms = words & swaps.keys()
    if not terms:
        return []
    ways = max(len(swaps[t]) for t in terms)
    return [(words - terms) | {swaps[t][min(i, len(swaps[t]) - 1)] for t in terms} for i in range(ways)]


def feature_rates(sample: DataFrame) -> DataFrame:
    """``(feature, rows, rate, other, z)``: share of toxic and of other rows with each feature, and their difference over its spread.

    Counted in Spark; without rows of both labels there are no features.
    """

    def make():
        def run(columns):
            out = {"feature": [], "toxic": []}
            for text, label in zip(columns["text"], columns["label"]):
                found = named(words_of(text))
                out["feature"] += found
                out["toxic"] += [int(label)] * len(found)
            return out

        return run

    size = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("p"), F.count("*").alias("n")).first()
    toxic, clean = float(size["p"]), float(size["n"] - size["p"])
    counts = (
        map_rows(sample.select("text", "label"), make, "feature string, toxic int")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("p"), F.count("*").alias("rows"))
        .where(F.lit(bool(toxic and clean)))
    )
    rate, other = F.col("p") / F.lit(toxic or 1.0), (F.col("rows") - F.col("p")) / F.lit(clean or 1.0)
    spread = F.sqrt(rate * (1 - rate) / (toxic or 1.0) + other * (1 - other) / (clean or 1.0) + 1e-9)
    return counts.select("feature", "rows", "p", rate.alias("rate"), other.alias("other"), ((rate - other) / spread).alias("z"))


def telling_features(rates: DataFrame, how: Fit) -> list[str]:
    """Features that stand clearly more often in toxic rows, at most ``how.features``."""
    clear = (F.col("p") >= how.min_rows) & (F.col("z") >= how.min_z) & (F.col("rate") >= how.min_ratio * F.col("other"))
    best = rates.where(clear).orderBy(F.col("z").desc(), "feature").limit(how.features)
    return [r["feature"] for r in best.select("feature").collect()]


def alike_words(sample: DataFrame, rates: DataFrame, how: Fit) -> tuple[tuple[str, ...], ...]:
    """Pairs of words without a label signal that stand among the same neighbours, each the other's most alike word.

    They are swapped as identity terms are, so that words that mean nothing for the label cannot move a score.
    Neighbours are counted in Spark; ``how.mined`` by ``how.neighbours`` numbers reach the driver at most.
    """
    known = {t for group in how.identity for t in group}
    plain = ~F.col("feature").endswith("-") & (F.length("feature") >= how.mined_letters) & ~F.col("feature").isin(*known)
    neutral = (F.abs("z") < how.mined_z) & (F.col("rows") >= how.mined_rows)
    common = rates.where(plain & neutral).orderBy(F.col("rows").desc(), "feature").limit(how.mined)
    words = sorted(r["feature"] for r in common.select("feature").collect())
    wanted = frozenset(words)

    def make():
        def run(columns):
            counts = Counter()
            for text in columns["text"]:
                found = WORD.findall((text or "").lower())
                for left, right in zip(found, found[1:]):
                    if left in wanted:
                        counts[left, ">" + right] += 1
                    if right in wanted:
                        counts[right, "<" + left] += 1
            return {"word": [w for w, _ in counts], "near": [n for _, n in counts], "times": list(counts.values())}

        return run

    met = map_rows(sample.select("text"), make, "word string, near string, times long")
    met = settle(met.groupBy("word", "near").agg(F.sum("times").alias("times")))
    top = met.groupBy("near").agg(F.sum("times").alias("all")).orderBy(F.col("all").desc(), "near").limit(how.neighbours)
    near = {r["near"]: i for i, r in enumerate(top.select("near").orderBy("near").collect())}
    if len(words) < 2 or not near:
        return ()
    table, at = np.zeros((len(words), len(near))), {w: i for i, w in enumerate(words)}
    for r in met.where(F.col("near").isin(*near)).collect():
        table[at[r["word"]], near[r["near"]]] = np.sqrt(r["times"])
    length = np.sqrt((table**2).sum(axis=1, keepdims=True))
    cosine = np.round(table @ table.T / np.maximum(length * length.T, 1e-12), 9)
    np.fill_diagonal(cosine, -1)
    best = cosine.argmax(axis=1)
    return tuple((words[i], words[j]) for i, j in enumerate(best) if i < j and best[j] == i and cosine[i, j] >= how.alike)


def matrices(
    sample: DataFrame, names: list[str], swaps: dict[str, list[str]]
) -> tuple[list[list[int]], np.ndarray, list[tuple[list[int], list[int]]], int]:
    """Feature positions and label of each sampled row, of rows with terms to swap also of their swapped forms, and the number of these rows."""
    at = {name: i for i, name in enumerate(names)}
    schema = "label double, present array<int>, swaps array<int>"

    def make():
        def run(columns):
            out = {"label": columns["label"], "present": [], "swaps": []}
            for text in columns["text"]:
                words = words_of(text)
                out["present"].append(sorted(at[f] for f in named(words) if f in at))
                flat = []
                for other in swapped(words, swaps):
                    flat += [*sorted(at[f] for f in named(other) if f in at), -1]
                out["swaps"].append(flat)
            return out

        return run

    present, labels, pairs, changed = [], [], [], 0
    for row in map_rows(sample.select("label", "text"), make, schema).collect():  # a bounded sample of short lists
        present.append(row["present"])
        labels.append(row["label"])
        changed += bool(row["swaps"])
        other: list[int] = []
        for i in row["swaps"]:
            if i < 0:
                pairs.append((row["present"], other))
                other = []
            else:
                other.append(i)
    return present, np.array(labels), pairs, changed


def fit(sample: DataFrame, how: Fit = Fit()) -> Model:
    """A logistic model of ``sample`` (``text, label``) by Newton steps.

    What is minimised: the log loss, a ridge penalty, and for every row with terms to swap the squared change of its
    logit when they are swapped: identity terms, and words found to be alike and neutral.  Both are always features, so
    that the penalty bears on them.  The sample is bounded, and so is what reaches the driver: positions of at most
    ``how.features`` features and the terms per row.  Without rows of both labels the model is a bias.
    """
    rates = settle(feature_rates(sample))
    telling = telling_features(rates, how)
    if not telling:
        row = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()
        share = min(max(row[0], 0.01), 0.99)
        return Model(float(np.log(share / (1 - share))), {})
    groups = alike_words(sample, rates, how) if how.mined else ()
    swaps = swap_table((*how.identity, *groups))
    names = sorted({*telling, *swaps})
    present, y, pairs, changed = matrices(sample, names, swaps)
    size = len(names) + 1
    order = sorted(range(len(y)), key=lambda i: (present[i], y[i]))  # sums do not depend on the order rows came in
    x = np.zeros((len(y), size), dtype=np.float32)
    x[:, -1] = 1
    for row, i in enumerate(order):
        x[row, present[i]] = 1
    y = y[order]
    change = np.zeros((len(pairs), size), dtype=np.float32)
    for row, (before, after) in enumerate(sorted(pairs)):
        change[row, before] += 1
        change[row, after] -= 1
    penalty = how.ridge * np.eye(size)
    penalty[-1, -1] = 1e-6
    penalty += how.swap_penalty * (change.T @ change).astype(np.float64)
    w = np.zeros(size)
    for _ in range(how.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        scale = (p * (1 - p)).astype(np.float32)
        step = np.linalg.solve((x.T @ (x * scale[:, None])).astype(np.float64) + penalty, gradient)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w = np.round(w, 9)
    gap = float(np.mean((change @ w) ** 2)) if len(pairs) else 0.0
    return Model(float(w[-1]), {n: float(v) for n, v in zip(names, w[:-1]) if v}, groups, len(y), changed, gap)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``; null and empty texts get the score of a text without features.

    Repeated rows and null ids keep a row each; an empty table gives an empty table; other columns are ignored.
    """

    def make():
        def run(columns):
            return {"doc_id": columns["doc_id"], "score": [model.score(t) for t in columns["text"]]}

        return run

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(narrow, make, "doc_id long, score double")


def keep_harmless(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns unchanged.

    Null and empty texts score as a text without features; very long texts are read whole; repeated rows are judged
    each; an empty table gives an empty table.
    """
    names = docs.columns

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column(names.index("text")).to_pylist()
                yield piece.filter(pa.array([model.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def trained(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows given; at most ``rows`` of them are used, one per id.  Without rows it is a bias."""
    return fit(settle(sample_of(docs, labels, "toxic", rows)), how)
