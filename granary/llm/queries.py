"""Registered queries of the subpackage: a thin query per operator, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.llm import (
    centroids,
    line_dedup,
    line_rules,
    merkle,
    mixing,
    neighbours,
    packing,
    pii,
    rule_ensemble,
    simhash,
    spans,
    toxicity,
    winnowing,
)
from granary.llm.batches import crc_fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql:
            ORACLE[name] = sql
        return plan

    return register


def vocabulary() -> str:
    """Place of the public vocabulary the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_simhash_near_dedup")
def op3(spark, folder):
    marked = simhash.near_duplicates(read(spark, folder, "documents"))
    return marked.select("doc_id", simhash.as_hex("bits").alias("fingerprint"), "component_id")


@query("op4_line_dedup", line_dedup.SQL)
def op4(spark, folder):
    return line_dedup.remove_repeated(read(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op7_concatenate_and_cut")
def op7(spark, folder):
    packed = packing.pack(read(spark, folder, "documents"), vocabulary())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op8_temperature_mixing", mixing.SQL)
def op8(spark, folder):
    mixed = mixing.mix(read(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "epoch", "block")


@query("op9_multiprobe_neighbours")
def op9(spark, folder):
    return neighbours.search(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op6_line_first_rules")
def op6(spark, folder):
    return line_rules.clean_lines(read(spark, folder, "documents")).drop("rules", "clean_text")


@query("op1_disclosure_sanitiser")
def op1(spark, folder):
    found = pii.find(read(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    told = found.withColumns(
        {f"n_{kind}": pii.count_of(kind) for kind in pii.KINDS}
        | {"base_sha256": F.sha2(pii.digest(base), 256), "every": pii.digest(F.col("spans"))}
    )
    counts = [f"n_{kind}" for kind in pii.KINDS]
    clean = pii.sanitise(told, keep=", ".join([f"{c} long" for c in counts] + ["base_sha256 string", "every string"]))
    return clean.select("doc_id", *counts, "base_sha256", F.col("every").alias("spans"), F.col("text_sha256").alias("sanitised_sha256"))


def held_out(parts: int, part: int):
    """Whether a document's id falls in the fold labels are not learned from; rows without an id do not."""
    return F.coalesce(crc_fold("doc_id", parts) == part, F.lit(False))


@query("op2_rule_ensemble_quality")
def op2(spark, folder):
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    sample = rule_ensemble.sample_of(docs, labels.where(~held_out(3, 1)), "quality")
    model = rule_ensemble.fit(sample)
    return rule_ensemble.score(docs, model).select(
        "doc_id",
        held_out(3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op10_counterfactual_toxicity")
def op10(spark, folder):
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = toxicity.trained(docs, labels.where(~held_out(4, 2)))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op5_offset_attribution")
def op5(spark, folder):
    return spans.attributed_fields(read(spark, folder, "documents"), vocabulary(), ["lang", "source", "text"])


@query("op11_scalar_table_clustering", centroids.SQL)
def op11(spark, folder):
    return centroids.with_inertia(*centroids.cluster(read(spark, folder, "embeddings")))


@query("op12_merkle_manifest", merkle.SQL)
def op12(spark, folder):
    return merkle.audited(read(spark, folder, "documents"), merkle.tampered())


@query("op13_winnowed_decontamination", winnowing.SQL)
def op13(spark, folder):
    return winnowing.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
