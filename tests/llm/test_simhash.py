"""SimHash near-duplicates against brute force, hot halves included."""

import random

import brute
from pyspark.sql import functions as F

from granary.llm import simhash
from granary.llm.components import connected


def groups(frame):
    return {r["doc_id"]: (r["bits"] & (1 << 64) - 1, r["component_id"]) for r in frame.collect()}


def near_copies(seed=3, families=12, size=8):
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    docs, doc = [], 0
    for _ in range(families):
        text = [random.choice(words) for _ in range(random.choice((5, 60, 300)))]
        for copy in range(size):
            edited = list(text)
            for _ in range(copy // 2):
                edited[random.randrange(len(edited))] = random.choice(words)
            docs.append((doc, " ".join(edited).replace(" ", "\n", 1)))
            doc += 1
    return docs


def test_components_match_brute_force(spark, documents):
    docs = near_copies() + [(500, "Only TWO"), (501, "only two"), (502, ""), (503, None), (504, "ÄÖ x y")]
    got = groups(simhash.near_duplicates(documents(docs)))
    prints = {d: brute.simhash(t) for d, t in docs}
    assert {d: p for d, (p, _) in got.items()} == prints
    assert {d: c for d, (_, c) in got.items()} == brute.components(prints)
    assert got[502][1] == got[503][1] == 502 and got[501][1] == 500


def test_hot_halves_lose_no_link(spark):
    random.seed(5)
    base = random.getrandbits(64)
    prints = {base}
    for _ in range(60):  # one half is the same in most of them, so many meet at one key
        p = base
        for bit in random.sample(range(9), random.randint(0, 5)):
            p ^= 1 << bit
        for bit in random.sample(range(32, 64), random.choice((0, 0, 0, 1))):
            p ^= 1 << bit
        prints.add(p)
    prints |= {random.getrandbits(64) for _ in range(30)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "bits long")
    assert simhash.hot_keys(frame, 6).count() > 0
    want = brute.components({s[0]: s[0] & (1 << 64) - 1 for s in signed})
    for limit in (6, 512):
        roots = {r["node"]: r["root"] for r in connected(simhash.links(frame, 3, limit)).collect()}
        got = {s[0]: roots.get(s[0], s[0]) for s in signed}
        assert got == want, limit


def test_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for i in (1, 2, 3, 10) for r in by_id[i]] == [1, 1, 1, 1]
    assert len(by_id[4]) == 2 and by_id[None][0]["component_id"] is None
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i or 0 for i in ids) == [0, 1, 4, 5, 6, 7, 8, 9]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one_per_group(none).count() == 0


def unlike(seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10_000)}" for _ in range(80))


def test_every_group_keeps_one_row(documents):
    a, b, c, d, e, f = map(unlike, range(6))
    rows = [
        (None, a), (None, a), (None, b), (None, None),  # groups without ids
        (1, c), (1, d), (1, d), (2, c),  # one id, two texts
        (5, e), (5, f), (3, f), (None, e),  # in the group of f the smallest id is another one
    ]
    assert len(set(brute.components({i: brute.simhash(t) for i, (_, t) in enumerate(rows)}).values())) == 7
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one_per_group(documents(rows)).collect()), key=repr)
    assert got == sorted([(None, a), (None, b), (None, None), (1, c), (1, d), (5, e), (3, f)], key=repr)


def test_chain_is_one_component(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = connected(links.unionByName(links).unionByName(links.select(F.col("a"), F.col("a").alias("b"))))
    assert {r["root"] for r in got.collect()} == {0} and got.count() == 200


def test_pairs_are_not_sent_whole(spark):
    """Each fingerprint gives 66 rows, which Spark does not count when it judges what is small enough to send."""
    rows = simhash.variants(simhash.settle(spark.range(100).select(F.col("id").alias("bits"))))
    plan = simhash.pairs(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_kept_keys_are_not_sent_whole(spark, documents):
    """Every group has a key, so their number grows with the documents; the driver must not hold them for a broadcast."""
    kept = simhash.keep_one_per_group(documents([(i, unlike(i)) for i in range(20)]))
    assert kept.count() == 20
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
