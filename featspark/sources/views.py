"""Deterministic biological views over the driver tables.

The driver tables hold no protein data, so activations, residues, coordinates and alignments are
derived from them row by row. Each view is one Spark expression plus the same rule in ANSI SQL
(``SQL_VIEWS``); every row of the base table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import ALIGN, AMINO, SS8
from ..session import spread

LAYERS, WIDTH, TOKENS = 4, 64, 25


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _tokens(spark, path) -> DataFrame:
    e = spread(table(spark, path, "embeddings").select("vec_id", "embedding", "label"))
    return e.withColumn("protein_id", F.expr(f"vec_id div {TOKENS}")).withColumn("pos", F.col("vec_id") % TOKENS)


def drift_vector():
    """Vector of one layer from the embedding: a known drift that makes every transition type occur."""

    def cell(f):
        shifted = f + F.when(f % 7 == 6, F.col("layer")).otherwise(0)
        base = F.element_at("embedding", (shifted % WIDTH + 1).cast("int")).cast("double")
        return base * (1 + F.col("layer") * ((f % 5) - 2) / F.lit(4.0))

    return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), cell)


def activations_vec(spark, path) -> DataFrame:
    """protein_id, pos, layer, vec."""
    t = _tokens(spark, path).select("protein_id", "pos", "embedding", F.explode(F.sequence(F.lit(0), F.lit(LAYERS - 1))).alias("layer"))
    return t.select("protein_id", "pos", "layer", drift_vector().alias("vec"))


def to_long(vec: DataFrame) -> DataFrame:
    """Long activations: one row per (protein, pos, layer, feature)."""
    return vec.select("protein_id", "pos", "layer", F.posexplode("vec").alias("feature", "value"))


def activations(spark, path) -> DataFrame:
    return to_long(activations_vec(spark, path))


def _code(dim: int, scale: int, shift: int, top: int):
    x = F.floor(F.element_at("embedding", dim).cast("double") * scale + shift)
    return F.greatest(F.lit(0), F.least(F.lit(top), x)).cast("int")


def token_residues(spark, path) -> DataFrame:
    """protein_id, pos, aa, ss, conservation for every activation token."""
    return _tokens(spark, path).select(
        "protein_id", "pos",
        F.substring(F.lit(AMINO), _code(5, 40, 10, 19) + 1, F.lit(1)).alias("aa"),
        F.substring(F.lit(SS8), _code(6, 16, 4, 7) + 1, F.lit(1)).alias("ss"),
        F.least(F.lit(1.0), F.abs(F.element_at("embedding", 7).cast("double")) * 4).alias("conservation"),
        "label",
    )


def coords(spark, path) -> DataFrame:
    t = _tokens(spark, path)
    at = lambda i: (F.lit(40.0) * F.element_at("embedding", i).cast("double"))
    return t.select("protein_id", "pos", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


def atoms(spark, path) -> DataFrame:
    """Four atoms per residue, from four coordinate triples of the embedding."""
    t = _tokens(spark, path).select("protein_id", "pos", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("atom"))
    at = lambda i: (F.lit(40.0) * F.element_at("embedding", (F.col("atom") * 3 + i).cast("int")).cast("double"))
    return t.select("protein_id", "pos", "atom", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


def proteins(spark, path) -> DataFrame:
    """Whole document texts reduced to the 20 residue letters, empty ones dropped."""
    d = spread(table(spark, path, "documents").select("doc_id", "text", "lang", "source"))
    seq = F.upper(F.regexp_replace("text", f"[^{AMINO}{AMINO.lower()}]", ""))
    return (d.select(F.col("doc_id").alias("protein_id"), seq.alias("sequence"), "lang", "source")
            .filter(F.length("sequence") > 0))


def residues(spark, path) -> DataFrame:
    """protein_id, pos, aa, ss over every letter of every protein."""
    p = proteins(spark, path)
    r = p.select("protein_id", F.posexplode(F.split("sequence", "")).alias("pos", "aa"))
    return r.select("protein_id", "pos", "aa", F.substring(F.lit(SS8), F.ascii("aa") % 8 + 1, F.lit(1)).alias("ss"))


def states(spark, path) -> DataFrame:
    """Proteins with the structure letters of :func:`residues` as one string."""
    return proteins(spark, path).withColumn("states", F.translate("sequence", AMINO, "".join(SS8[ord(a) % 8] for a in AMINO)))


def domains(spark, path) -> DataFrame:
    p = proteins(spark, path)
    n = F.length("sequence")
    return p.select("protein_id", F.expr("length(sequence) div 4").cast("int").alias("start"),
                    F.expr("length(sequence) div 2").cast("int").alias("end"),
                    F.col("source").alias("domain_id"), n.alias("length"))


def token_domains(spark, path) -> DataFrame:
    """Three fixed-length regions per activation protein."""
    ids = _tokens(spark, path).select("protein_id").distinct()
    return ids.select("protein_id", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(i).alias("domain_id"))
                                                        for a, b, i in ((0, 8, "d0"), (8, 16, "d1"), (16, 25, "d2"))])).alias("d")) \
        .select("protein_id", "d.*")


def msa_cells(spark, path) -> DataFrame:
    """family = label, sequence = vector, column = dimension, letter = quantised value."""
    e = spread(table(spark, path, "embeddings"))
    cells = e.select(F.col("label").cast("long").alias("family_id"), F.col("vec_id").alias("seq_idx"),
                     F.posexplode("embedding").alias("col", "v"))
    code = F.greatest(F.lit(0), F.least(F.lit(20), F.floor(F.col("v").cast("double") * 40 + 10))).cast("int")
    return cells.select("family_id", "seq_idx", "col", F.substring(F.lit(ALIGN), code + 1, F.lit(1)).alias("aa"))


def metric_log(spark, path) -> DataFrame:
    e = table(spark, path, "events")
    return e.select(F.col("user_id").alias("epoch"), F.col("event_type").alias("metric"), "value", "ts")


SQL_VIEWS = {
    "act": """select vec_id // 25 as protein_id, vec_id % 25 as pos, l.layer, g.f as feature,
  embedding[(g.f + case when g.f % 7 = 6 then l.layer else 0 end) % 64 + 1]::double
    * (1 + l.layer * ((g.f % 5) - 2) / 4.0::double) as value
from embeddings, range(4) l(layer), range(64) g(f)""",
    "tok": """select vec_id // 25 as protein_id, vec_id % 25 as pos,
  substr('ACDEFGHIKLMNPQRSTVWY', 1 + greatest(0, least(19, floor(embedding[5]::double * 40 + 10)))::int, 1) as aa,
  substr('HBEGITS-', 1 + greatest(0, least(7, floor(embedding[6]::double * 16 + 4)))::int, 1) as ss,
  least(1.0::double, abs(embedding[7]::double) * 4) as conservation, label
from embeddings""",
    "tprot": "select protein_id, string_agg(aa, '' order by pos) as sequence from tok group by protein_id",
    "coords": """select vec_id // 25 as protein_id, vec_id % 25 as pos, 40.0::double * embedding[1]::double as x,
  40.0::double * embedding[2]::double as y, 40.0::double * embedding[3]::double as z from embeddings""",
    "atoms": """select vec_id // 25 as protein_id, vec_id % 25 as pos, a.atom, 40.0::double * embedding[a.atom * 3 + 1]::double as x,
  40.0::double * embedding[a.atom * 3 + 2]::double as y, 40.0::double * embedding[a.atom * 3 + 3]::double as z
from embeddings, range(4) a(atom)""",
    "prot": """select doc_id as protein_id, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) as sequence,
  lang, source from documents
where length(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) > 0""",
    "res0": "select protein_id, unnest(range(length(sequence))) as pos, unnest(string_split(sequence, '')) as aa from prot",
    "res": "select protein_id, pos, aa, substr('HBEGITS-', (ascii(aa) % 8 + 1)::int, 1) as ss from res0",
    "domains": """select protein_id, length(sequence) // 4 as "start", length(sequence) // 2 as "end", source as domain_id,
  length(sequence) as length from prot""",
    "tdom": """select p.protein_id, d."start", d."end", d.domain_id from (select distinct vec_id // 25 as protein_id from embeddings) p,
  (values (0, 8, 'd0'), (8, 16, 'd1'), (16, 25, 'd2')) d("start", "end", domain_id)""",
    "cells": """select label::bigint as family_id, vec_id as seq_idx, g.c as col,
  substr('ACDEFGHIKLMNPQRSTVWY-', 1 + greatest(0, least(20, floor(embedding[g.c + 1]::double * 40 + 10)))::int, 1) as aa
from embeddings, range(64) g(c)""",
    "log": "select user_id as epoch, event_type as metric, value, ts from events",
}
SQL_NEEDS = {"tprot": ["tok"], "res0": ["prot"], "res": ["prot", "res0"], "domains": ["prot"]}


def with_views(names: str, body: str, extra: str = "") -> str:
    """Prefix ``body`` with the CTEs it reads; ``extra`` holds further CTEs of the query."""
    order: list[str] = []
    for n in names.split():
        for d in SQL_NEEDS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    parts = [f"{n} as materialized ({SQL_VIEWS[n]})" for n in order]
    if extra.strip():
        parts.append(extra.strip().rstrip(","))
    return "with recursive " + ",\n".join(parts) + "\n" + body if parts else body


def token_proteins(spark, path) -> DataFrame:
    """Sequences of the activation proteins, put together from their tokens (at most TOKENS letters)."""
    t = token_residues(spark, path)
    s = t.groupBy("protein_id").agg(F.array_sort(F.collect_list(F.struct("pos", "aa"))).alias("s"))
    return s.select("protein_id", F.array_join(F.transform("s", lambda e: e.aa), "").alias("sequence"))
