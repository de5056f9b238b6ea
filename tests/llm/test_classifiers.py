"""Quality rules, toxicity and line rules: held-out accuracy, what is penalised, odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from granary.llm import line_rules, rule_ensemble, toxicity
from granary.llm.queries import QUERIES, held_out

FOLDER = "/root/testdata/sf0.01"


def accuracy(spark, name, target):
    got = QUERIES[name](spark, FOLDER).cache()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id")
    row = held.agg(F.avg((F.col("predicted") == F.col(target)).cast("int")), F.count("*")).first()
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    return row


def test_quality_on_held_out_rows(spark):
    share, rows = accuracy(spark, "op2_rule_ensemble_quality", "quality")
    assert rows > 80 and share > 0.97


def test_toxicity_on_held_out_rows(spark):
    share, rows = accuracy(spark, "op10_counterfactual_toxicity", "toxic")
    assert rows > 80 and share > 0.93


def test_rules_compile_to_what_they_say(spark):
    described = """Forest
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 3 <= 0.25)
      Predict: 0.0
     Else (feature 3 > 0.25)
      Predict: 1.0
    Else (feature 0 > 1.5)
     If (feature 0 <= 2.5)
      Predict: 1.0
     Else (feature 0 > 2.5)
      Predict: 0.0
"""
    rules = {str(r) for r in rule_ensemble.tree_rules(described)}
    names = rule_ensemble.STATISTICS
    assert f"{names[3]} > 0.25 and {names[0]} <= 1.5" in rules or f"{names[0]} <= 1.5 and {names[3]} > 0.25" in rules
    assert f"{names[0]} > 1.5" in rules and len(rules) == 6
    model = rule_ensemble.Ensemble(-1.0, ((rule_ensemble.Rule(((names[0], False, 1.0),)), 3.0),))
    frame = rule_ensemble.with_statistics(spark.createDataFrame([(1, "one two three four five"), (2, "")], "doc_id long, text string"))
    got = {r["doc_id"]: r["s"] for r in frame.select("doc_id", model.column().alias("s")).collect()}
    assert math.isclose(got[1], 1 / (1 + math.exp(-2))) and math.isclose(got[2], 1 / (1 + math.exp(1)))


def sentences(rows, seed=2):
    """Insults mark toxic rows; in the sample women are spoken of mostly where someone is insulted."""
    random.seed(seed)
    words = [f"word{i}" for i in range(200)]
    out = []
    for d in range(rows):
        toxic = d % 3 == 0
        text = random.choices(words, k=20)
        if toxic:
            text[3] = random.choice(("idiot", "scum"))
        if random.random() < (0.7 if toxic else 0.1):
            text[5] = "women"
        elif random.random() < 0.2:
            text[5] = "people"
        out.append((d, " ".join(text), float(toxic)))
    return out


def test_swaps_are_penalised(spark):
    sample = spark.createDataFrame(sentences(900), "doc_id long, text string, label double")
    free = toxicity.fit(sample, toxicity.Fit(swap_penalty=0.0))
    bound = toxicity.fit(sample, toxicity.Fit(swap_penalty=4.0))
    neutral, other = "women met at the market", "people met at the market"
    gap = [abs(m.score(neutral) - m.score(other)) for m in (free, bound)]
    assert gap[0] > 3 * gap[1] and gap[1] < 0.05
    assert bound.score(neutral) < 0.3 and bound.score("you idiot") > 0.5 and bound.score("women are scum") > 0.5


def test_swaps():
    table = toxicity.swap_table(toxicity.IDENTITY)
    assert toxicity.swapped({"plain", "words"}, table) == []
    assert toxicity.swapped({"women", "x"}, table) == [{"men", "x"}, {"people", "x"}]
    assert all(t not in table[t] for t in table)
    assert len(table) == sum(map(len, toxicity.IDENTITY))  # no term stands in two groups


def test_alike_words_are_found_and_swapped(spark):
    """Two words of one context and no label signal form a group; a word that marks toxic rows does not."""
    rows = []
    for d in range(600):
        toxic = float(d % 3 == 0)
        place = f"we went {('northward', 'southward')[d // 3 % 2]} by train and saw the {('harbour', 'museum')[d // 6 % 2]} there"
        rows.append((place + (" you idiot" if toxic else " my friend"), toxic))
    sample = spark.createDataFrame(rows, "text string, label double")
    model = toxicity.fit(sample)
    assert {("northward", "southward"), ("harbour", "museum")} <= set(model.groups)
    assert not any("idiot" in g for g in model.groups) and model.rows_swapped == model.rows == 600
    assert model.score("you idiot") > 0.5 > model.score("saw the museum")


def test_swaps_bear_on_the_given_documents(spark):
    """Over the labelled rows the registered query learns from, most have a swapped form, and the penalty closes their gap."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.where(~held_out(4, 2))
    bound = toxicity.trained(docs, labels)
    free = toxicity.trained(docs, labels, toxicity.Fit(swap_penalty=0.0))
    assert bound.groups == free.groups and bound.groups
    assert bound.rows_swapped >= 0.5 * bound.rows
    assert 0 < bound.swap_gap < 0.2 * free.swap_gap


def plain_loss(rows, bias, weights, how, swaps):
    """What the fit minimises, text by text."""
    def logit(found):
        return bias + sum(w for f, w in weights.items() if f in found)

    total = how.ridge / 2 * sum(w * w for w in weights.values())
    for _, text, label in rows:
        words = toxicity.words_of(text)
        z = logit(toxicity.named(words))
        total += math.log1p(math.exp(-z if label else z))
        for other in toxicity.swapped(words, swaps):
            total += how.swap_penalty / 2 * (z - logit(toxicity.named(other))) ** 2
    return total


def test_fit_is_the_least_loss(spark):
    rows = sentences(300)
    how = toxicity.Fit(mined=40)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label double"), how)
    swaps = toxicity.swap_table((*how.identity, *model.groups))
    least = plain_loss(rows, model.bias, model.weights, how, swaps)
    for name in ("", *sorted(model.weights)[:25], "idiot", "women"):
        for step in (-0.02, 0.02):
            moved = model.weights if not name else {**model.weights, name: model.weights.get(name, 0.0) + step}
            assert plain_loss(rows, model.bias + (0 if name else step), moved, how, swaps) > least


def test_sample_is_bounded_in_rows(documents, spark):
    """A third of all rows under one id give one row, conflicting labels the larger one, whatever the order of rows."""
    docs = documents([(1, f"text {i}") for i in range(300)] + [(i, f"own {i}") for i in range(2, 300)] + [(None, "x"), (5, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 300)] + [(2, 1), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    got = rule_ensemble.sample_of(docs, labels, "toxic", 250).collect()
    assert len(got) == 250 == len({r["doc_id"] for r in got})
    every = {r["doc_id"]: r for r in rule_ensemble.sample_of(docs, labels, "toxic").collect()}
    assert len(every) == 299 and every[2]["label"] == 1.0 and every[3]["label"] == 1.0 and every[4]["label"] == 0.0
    again = {r["doc_id"]: r for r in rule_ensemble.sample_of(docs.orderBy(F.rand(3)), labels, "toxic").collect()}
    assert every == again
    for a, b in ((docs.limit(0), labels), (docs, labels.limit(0))):
        assert rule_ensemble.sample_of(a, b, "toxic").count() == 0


def test_ensemble_matches_rules_row_by_row(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = rule_ensemble.fit(rule_ensemble.sample_of(docs, labels.where(~held_out(3, 1)), "quality"))
    assert model.weights
    got = {r["doc_id"]: r["score"] for r in rule_ensemble.score(docs, model).collect()}
    rows = rule_ensemble.with_statistics(docs).collect()
    assert len(rows) == len(got)
    for r in rows:
        total = model.bias
        for rule, weight in model.weights:
            total += weight * all((r[n] <= t) if at_most else (r[n] > t) for n, at_most, t in rule.parts)
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_one_label_or_no_rows(spark):
    none = spark.createDataFrame([], "text string, label double")
    ones = spark.createDataFrame([("a b c", 1.0)] * 3, "text string, label double")
    assert toxicity.fit(none).score("x") < 0.3 and toxicity.fit(ones).score("x") > 0.9
    assert rule_ensemble.fit(none).weights == () and rule_ensemble.fit(ones).bias > 0


def test_odd_rows(odd, none):
    model = toxicity.Model(-2.0, {"one": 5.0})  # the word stands in documents 4 and 7
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert got[7] > 0.9 and np.isclose(got[1], got[2]) and len(got) == 11
    kept = toxicity.keep_harmless(odd, model)
    assert kept.schema == odd.schema
    assert sorted((repr(tuple(r)) for r in kept.collect())) == sorted(repr(tuple(r)) for r in odd.collect() if r["doc_id"] not in (4, 7))
    ensemble = rule_ensemble.Ensemble(0.5, ())
    scored = rule_ensemble.score(odd, ensemble).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(none, model).count() == toxicity.keep_harmless(none, model).count() == 0
    assert rule_ensemble.score(none, ensemble).count() == line_rules.clean_lines(none).count() == 0


def plain_counts(text):
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = text.split("\n")
    copies = sum(any(c not in " \t\n\x0b\x0c\r" for c in line) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(again)


def test_base_counts_match_plain_ones():
    random.seed(6)
    bits = ["a", "b", "é", "漢", " ", " ", "\n", "\t", "\x0b", "\x1f", "#", "|", " ", "a b c", "\r\n"]
    for _ in range(800):
        text = "".join(random.choices(bits, k=random.randint(0, 40)))
        assert line_rules.base_counts(text) == plain_counts(text), text


def test_lines_and_documents(documents, odd):
    random.seed(1)
    good = "\n".join(" ".join(f"word{random.randrange(3000)}" for _ in range(12)) + "." for _ in range(8))
    menu = "Home | About | Contact | Login | Help"
    docs = [(1, good), (2, f"{menu}\n{good}\nAll rights reserved."), (3, good.upper().replace(" ", "!! ")), (4, "too short")]
    rows = {r["doc_id"]: r for r in line_rules.clean_lines(documents(docs)).collect()}
    assert rows[1]["kept"] and rows[1]["clean_text"] == good
    assert rows[2]["kept"] and rows[2]["clean_text"] == good and rows[2]["rules"] == ["menu", "boilerplate"]
    assert not rows[3]["kept"] and rows[4]["base_failed"] and not rows[4]["kept"]
    many = line_rules.clean_lines(odd).collect()
    assert len(many) == odd.count()
    empty = [r for r in many if r["doc_id"] in (1, 2)]
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in empty)
