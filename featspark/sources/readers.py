"""Sources: sequence, alignment, annotation and structure files; activation and knowledge tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as K


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence): records split at ``>``; the id is the first header token, wrapped lines are joined."""
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).filter(F.trim("v") != "")
    head = F.substring_index("v", "\n", 1)
    body = F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)")
    return r.select(F.element_at(F.split(F.trim(head), r"\s+"), 1).alias("id"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """CSV with ``id`` and ``sequence`` columns, or FASTA; anything else is an error."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".fasta", ".fa", ".faa"):
        return read_fasta(spark, path)
    if ext != ".csv":
        raise ValueError(f"unsupported sequence file {path!r}")
    df = spark.read.option("header", True).csv(path)
    missing = {"id", "sequence"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return df.select("id", "sequence")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line number, text). A file is one alignment of one family, read as one row and unfolded."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("ln", "line"))


def read_msa(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(family_id, seq_idx, seq_id, aligned) from FASTA, Stockholm or Clustal; without ``fmt`` the first that parses wins, per file.

    Blocks of interleaved formats are joined in line order.
    """
    lines = _numbered_lines(spark, path)
    first = lines.filter(F.trim("line") != "").groupBy("file").agg(F.min_by("line", "ln").alias("top"))
    kind = F.when(F.col("top").startswith(">"), "fasta").when(F.col("top").startswith("# STOCKHOLM"), "stockholm").when(F.upper("top").startswith("CLUSTAL"), "clustal")
    src = lines.join(first.select("file", (F.lit(fmt) if fmt else kind).alias("fmt")), "file")
    bad = F.when(F.col("fmt").isNull(), F.raise_error(F.concat(F.lit("no alignment format fits "), F.col("file")))).otherwise(F.col("fmt"))
    src = src.withColumn("fmt", bad.cast("string"))
    w = Window.partitionBy("file").orderBy("ln")
    fa = src.filter("fmt = 'fasta'").withColumn("rec", F.sum(F.when(F.col("line").startswith(">"), 1).otherwise(0)).over(w)).filter("rec > 0")
    fa = fa.withColumn("id", F.max(F.when(F.col("line").startswith(">"), F.element_at(F.split(F.expr("substring(line, 2)"), r"\s+"), 1))).over(Window.partitionBy("file", "rec")))
    fa = fa.filter(~F.col("line").startswith(">")).select("file", F.lit(0).cast("long").alias("no"), F.concat_ws("#", "rec", "id").alias("key"), "id", "ln", F.regexp_replace("line", r"\s", "").alias("part"))
    # a Stockholm file may hold several families, each closed by a line of slashes
    il = src.filter("fmt <> 'fasta'").withColumn("no", F.coalesce(F.sum(F.when(F.col("line").startswith("//"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    il = il.filter(F.col("line").rlike(r"^[^\s#/*.:][^\s]*\s+[A-Za-z.\-*]+(\s+\d+)?\s*$") & ~F.upper("line").startswith("CLUSTAL"))
    il = il.select("file", "no", F.element_at(F.split("line", r"\s+"), 1).alias("key"), F.element_at(F.split("line", r"\s+"), 1).alias("id"), "ln", F.element_at(F.split("line", r"\s+"), 2).alias("part"))
    g = fa.unionByName(il).groupBy("file", "no", "key", "id").agg(F.min("ln").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "part"))), lambda s: s.part), "").alias("aligned"))
    fam = F.regexp_extract("file", r"([^/]+?)(\.[^./]+)?$", 1)
    family = F.when(F.col("no") == 0, fam).otherwise(F.concat_ws("_", fam, F.col("no") + 1))
    return g.select(family.alias("family_id"), (F.row_number().over(Window.partitionBy("file", "no").orderBy("at")) - 1).alias("seq_idx"), F.col("id").alias("seq_id"), F.upper(F.translate("aligned", ".", "-")).alias("aligned"))


def read_flatfile(spark: SparkSession, path: str, max_len: int = 1022):
    """(proteins, rejected) from annotated flat files (``ID``/``AC``/``OS``/``GN``/``DR``/``FT``/``SQ`` lines, records end with ``//``)."""
    r = spark.read.option("lineSep", "//\n").text(path).filter(F.trim("value") != "").withColumnRenamed("value", "v")
    every = lambda p, k=1: F.regexp_extract_all("v", F.lit(p), k)
    one = lambda p: F.nullif(F.regexp_extract("v", p, 1), F.lit(""))
    seq = F.regexp_replace(F.regexp_extract("v", r"(?s)\nSQ [^\n]*\n(.*)$", 1), r"[\s/]", "")
    starts, ends, names = every(r"(?m)^FT\s+DOMAIN\s+(\d+)\.\.(\d+)"), every(r"(?m)^FT\s+DOMAIN\s+(\d+)\.\.(\d+)", 2), every(r"(?m)^FT\s+/note=\"([^\"]*)\"")
    dom = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e"), names.alias("n")), lambda d: F.struct((d.s.cast("int") - 1).alias("start"), d.e.cast("int").alias("end"), d.n.alias("domain_id")))
    p = r.select(one(r"(?m)^AC\s+(\w+)").alias("protein_id"), seq.alias("sequence"), one(r"(?m)^OS\s+([^\n.]+)").alias("organism"), one(r"(?m)^GN\s+Name=([^;{\s]+)").alias("gene_name"),
                 F.filter(F.split(F.regexp_replace(F.array_join(every(r"(?m)^KW\s+([^\n]+)"), " "), r"\.$", ""), r";\s*"), lambda x: x != "").alias("keywords"), every(r"(GO:\d{7})").alias("go_terms"),
                 one(r"EC=([\d.\-]+)").alias("ec_number"), dom.alias("domains"), "v")
    good = F.col("protein_id").isNotNull() & (F.length("sequence") > 0) & F.upper("sequence").rlike("^[A-Z]+$")
    ok = p.filter(good & (F.length("sequence") <= max_len)).drop("v").withColumn("length", F.length("sequence"))
    reason = F.when(~F.coalesce(good, F.lit(False)), "malformed").when(F.length("sequence") > max_len, "too long")
    return ok, p.withColumn("reason", reason).filter("reason is not null").select("v", "reason")


def read_pdb_ca(spark: SparkSession, path: str, chain: str | None = None) -> DataFrame:
    """(protein_id, chain, pos, resname, x, y, z): CA per residue, else the atom centroid; default the file's first chain."""
    ln = _numbered_lines(spark, path).filter(F.substring("line", 1, 6) == "ATOM  ")
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    a = ln.select("file", "ln", cut(13, 4).alias("atom"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"), cut(23, 5).alias("resseq"), cut(31, 8).cast("double").alias("x"), cut(39, 8).cast("double").alias("y"), cut(47, 8).cast("double").alias("z"))
    if chain is None:
        a = a.join(a.groupBy("file").agg(F.min_by("chain", "ln").alias("chain")), ["file", "chain"])
    else:
        a = a.filter(F.col("chain") == chain)
    ca = F.col("atom") == "CA"
    g = a.groupBy("file", "chain", "resseq", "resname").agg(F.min("ln").alias("at"), *[F.coalesce(F.max(F.when(ca, F.col(k))), F.avg(k)).alias(k) for k in "xyz"])
    pos = F.row_number().over(Window.partitionBy("file", "chain").orderBy("at")) - 1
    return g.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]+)?$", 1).alias("protein_id"), "chain", pos.alias("pos"), "resname", "x", "y", "z")


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """Metadata table; a missing path is an error raised by the reader."""
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def read_activations(spark: SparkSession, path: str, layers: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Layer-partitioned activations; the layer list prunes partitions, the column list prunes columns."""
    df = spark.read.parquet(path)
    if layers is not None:
        df = df.filter(F.col("layer").isin(layers))
    return df.select(*columns) if columns else df


def structures_for(proteins: DataFrame, coords: DataFrame) -> DataFrame:
    """Coordinates on every residue of every protein, cut to its length; missing ones become zeros with a flag."""
    grid = proteins.filter("length(sequence) > 0").select("protein_id", F.explode(F.expr("sequence(0, length(sequence) - 1)")).alias("pos"))
    j = grid.join(coords, ["protein_id", "pos"], "left").withColumn("has_structure", F.col("x").isNotNull())
    return j.fillna(0.0, ["x", "y", "z"])


DEFAULTS = {
    "motif_library": (lambda: [(n, p, f, s, lo, hi, {q: True}) for n, p, f, s, lo, hi, q in K.MOTIF_LIBRARY],
                      "name string, pattern array<struct<src:int,dst:int>>, biological_function string, conservation_score double, min_size int, max_size int, required_properties map<string,boolean>"),
    "go": (lambda: K.GO_TERMS, "aspect string, name string, term string"),
    "pfam": (lambda: K.PFAM, "domain_id string, name string, function string"),
    "variants": (lambda: K.VARIANTS, "pos int, wt string, mut string, disease string, class string"),
    "known_motifs": (lambda: [(k, m) for k, v in K.KNOWN_MOTIFS.items() for m in v], "name string, pattern string"),
    "conservation": (lambda: [], "protein_id string, pos int, conservation double"),
    "literature": (lambda: [], "feature int"),
}


def read_kb(spark: SparkSession, kind: str, path: str | None = None) -> DataFrame:
    """Knowledge table from JSON lines with the table's schema, or the built-in default."""
    if kind not in DEFAULTS:
        raise ValueError(f"unknown knowledge table {kind!r}")
    rows, schema = DEFAULTS[kind]
    return spark.read.schema(schema).json(path) if path else spark.createDataFrame(rows(), schema)
