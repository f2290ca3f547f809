"""Queries of the corpus operators and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, bpe_split, chunk_dedup, exact_dedup, html_text, language_id, line_crf, mix_sources, prefix_tokens, prob_minhash, toxicity, turn_repair, variants
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op8_exact_dedup", r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)""")
def op8(spark, path):
    return exact_dedup.exact_duplicates(table(spark, path, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op4_prefix_tokens")
def op4(spark, path):
    return prefix_tokens.token_counts(table(spark, path, "documents"))


@query("op9_bpe_split")
def op9(spark, path):
    return bpe_split.round_trip(table(spark, path, "documents"))


@query("op2_toxicity_neighbours")
def op2(spark, path):
    return toxicity.toxicity_scores(table(spark, path, "documents"), table(spark, path, "labels"))


@query("op6_language_profiles")
def op6(spark, path):
    return language_id.language_profiles(table(spark, path, "documents"))


@query("op1_line_crf")
def op1(spark, path):
    return line_crf.line_quality(table(spark, path, "documents"), table(spark, path, "labels"))


@query("op10_html_boosted")
def op10(spark, path):
    return html_text.extract(table(spark, path, "pages"))


@query("op7_pareto_mix")
def op7(spark, path):
    return mix_sources.mix(table(spark, path, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query("op3_prob_minhash")
def op3(spark, path):
    return prob_minhash.near_duplicates(table(spark, path, "documents")).select("doc_id", "class_id", "class_size", "n_links", "kept")


@query("op5_gear_chunks")
def op5(spark, path):
    return chunk_dedup.passages(table(spark, path, "documents"))


@query("op11_best_fit")
def op11(spark, path):
    return best_fit.pack(table(spark, path, "documents")).sequences


@query("op12_variants")
def op12(spark, path):
    return variants.variants(table(spark, path, "documents"))


@query("op13_turn_repair")
def op13(spark, path):
    return turn_repair.repaired(table(spark, path, "conversations"))


@query("pipeline")
def pipeline(spark, path):
    import corpus_pipeline  # the stages import this package's operators, so the module comes last

    return corpus_pipeline.run(spark, path)
