"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the corpus by weight; a target stops at ``most`` times the words its source has
and the excess goes to the others by weight. A source whose target is c times its words first gives floor(c)
certain whole copies of every document. The rest is a fixed-size sample with unequal probabilities: document
i has the inclusion probability p_i, proportional to min(1, giant / size_i), so that one giant seldom decides
a source; its rank is the random odds u / (1 - u) divided by the inclusion odds p_i / (1 - p_i), and the
smallest ranks are taken until the source has its words.

No source is ever sorted as a whole. Ranks fall into 2**24 cells, counted in two levels of 4096, which finds
the cell where the words run out. The documents of that cell and at most ``tail`` cells' worth of the next
ones in rank order (a bounded number) are then filled in by rank, each where it still fits, so that the taken
words come within one small document of the target.

``u`` is a hash of the identifier and the seed, so reruns agree. Defined results: null text has no words and
is never needed (0 words taken; certain copies still apply); null sources are one source, the last; documents
that repeat with the same identifier, source and size are decided together by rank and separately when they
fill the last gap; null identifiers share one random number; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_text, numbered, pick, stash

CELLS = 4096


def measured(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, row_id (column ``row``, else numbered here), size (words of the whole text)."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    number = (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id")
    return ids_and_text(docs, F.col("source").cast("string").alias("source"), number).select("doc_id", "source", "row_id", words.alias("size"))


def targets(sizes: DataFrame, most: float) -> DataFrame:
    """source, source_size, target: shares by weight 1, 2, 3, 1, ... in code point order, null last, with caps.

    The capped shares are min(most * size, weight * level) for one level; it follows from the sources in the
    order of their caps per weight. Works on one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = by_source.withColumn("weight", ((F.row_number().over(named) - 1) % 3 + 1).cast("double")).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("open", F.col("cap") / F.col("weight") >= F.col("level"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("l")))).over(everyone)["l"])
    return s.select("source", "source_size", "n_docs", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def _rank(size, giant, scale, seed):
    """Pareto order: random odds over inclusion odds, mapped into (0, 1)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), scale * F.least(F.lit(1.0), giant / F.greatest(size, F.lit(1)))))
    rank = u / (1 - u) / (p / (1 - p))
    return rank / (1 + rank)  # monotone, inside (0, 1)


def _placed(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    d = _with_plan(sizes, plan).withColumn("at", _rank(F.col("size"), F.col("giant"), F.col("scale"), seed))
    return d.withColumn("cell", F.least(F.lit(CELLS * CELLS - 1), F.floor(F.col("at") * (CELLS * CELLS))).cast("long"))


def mix(docs: DataFrame, most: float = 3.0, seed: int = 7, giant: float = 4.0, tail: int = 2000, row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, row_id, source, size, source_size, target, copies, taken."""
    sizes = stash(measured(docs, row))
    plan = stash(targets(sizes, most).coalesce(1))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size"), 6))
    plan = plan.withColumn("giant", F.greatest(F.lit(1.0), giant * F.col("source_size") / F.col("n_docs")))
    d = _with_plan(sizes, plan)
    # scale of the inclusion probabilities: sum of p_i * size_i is the rest
    damped = F.least(F.col("size").cast("double"), F.col("giant"))
    scale = d.groupBy("source").agg(F.sum(damped).alias("damped"))
    plan = stash(_with_plan(plan, scale).withColumn("scale", F.when(F.col("damped") > 0, F.col("rest") / F.col("damped")).otherwise(0.0)).drop("damped").coalesce(1))
    d = _placed(sizes, plan, seed).filter("rest > 0 and size > 0")
    high = stash(_crossing(d, plan, F.col("cell") / CELLS, F.lit(0.0), "high", "words_high").coalesce(1))
    inner = _with_plan(d, high.select("source", "high", "words_high")).filter(F.floor(F.col("cell") / CELLS) == F.col("high"))
    cut = _crossing(inner, _with_plan(plan, high.select("source", "high", "words_high")), F.col("cell") % CELLS, F.coalesce(F.col("words_high"), F.lit(0.0)), "low", "words_low")
    cut = stash(_with_plan(high, cut.select("source", "low", "words_low")).select("source", "rest", (F.col("high") * CELLS + F.coalesce("low", F.lit(CELLS))).alias("cut"), F.coalesce("words_low", "words_high").alias("words"),
                                                                                  F.greatest(F.lit(1), F.ceil(F.lit(float(CELLS) * CELLS * tail) / F.col("n_docs"))).cast("long").alias("reach")).coalesce(1))
    # the bounded region where the words run out: filled by rank, document by document
    edge = _with_plan(d.select("source", "doc_id", "row_id", "size", "at", "cell"), cut).filter((F.col("cell") >= F.col("cut")) & (F.col("cell") <= F.col("cut") + F.col("reach")))
    filled = edge.groupBy("source").applyInPandas(_fill, "row_id long, extra int")
    out = _with_plan(_placed(sizes, plan, seed), cut.select("source", "cut")).join(filled, "row_id", "left")
    by_rank = F.coalesce((F.col("cell") < F.col("cut")) & (F.col("rest") > 0) & (F.col("size") > 0), F.lit(False)).cast("int")
    copies = (F.col("whole") + F.greatest(by_rank, F.coalesce("extra", F.lit(0)))).cast("long")
    return out.select("doc_id", "row_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _with_plan(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join per-source values to rows; a null source is a source. One row per source stands on the right."""
    right = per_source.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("__s"), *[c for c in per_source.columns if c not in rows.columns])
    return rows.withColumn("__s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).join(right, "__s", "left").drop("__s")


def _crossing(d: DataFrame, plan: DataFrame, cell, base, name: str, words: str) -> DataFrame:
    """Per source: the first of 4096 cells in which the running words exceed the rest, and the words before it."""
    counts = d.groupBy("source", F.floor(cell).cast("long").alias(name)).agg(F.sum("size").alias("w"))
    w = Window.partitionBy("source").orderBy(name)
    run = counts.withColumn("before", F.sum("w").over(w) - F.col("w"))
    run = _with_plan(run, plan).withColumn("before", F.col("before") + base)
    first = run.filter(F.col("before") + F.col("w") > F.col("rest")).groupBy("source").agg(F.min(F.struct(F.col(name), F.col("before").cast("double").alias("b"))).alias("f"))
    return _with_plan(plan, first.select("source", F.col("f")[name].alias(name), F.col("f")["b"].alias(words)))


def _fill(pdf):
    """Take the documents of the region in rank order where they fit; the last gap goes to the closest whole document."""
    pdf = pdf.sort_values(["at", "doc_id", "row_id"])
    gap, chosen = float(pdf["rest"].iloc[0] - pdf["words"].iloc[0]), []
    left = []
    for row, size in zip(pdf["row_id"], pdf["size"]):
        if size <= gap:
            chosen.append(row)
            gap -= size
        else:
            left.append((size, row))
    over = [(size, row) for size, row in left if size - gap < gap]
    if over:
        chosen.append(min(over, key=lambda x: x[0])[1])  # the first in rank order among the smallest
    return pdf[pdf["row_id"].isin(chosen)][["row_id"]].assign(extra=1).astype({"extra": "int32"})


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all columns of ``docs``, each as often as the mix takes it."""
    base, row = numbered(docs)
    n = row + "n"
    copies = mix(base, row=row, **options).filter("copies > 0").select(F.col("row_id").alias(row), F.col("copies").cast("int").alias(n))
    return pick(base, copies, row, "inner").withColumn(row, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(row, n)
