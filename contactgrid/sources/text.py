"""Text sources: read pairs, chromosome sizes, sites, features, intervals, motifs, genes, tracks and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of loop columns in headers and what they stand for.
ALIASES = {
    "o": "observed", "e_bl": "expectedBL", "e_donut": "expectedDonut", "e_h": "expectedH", "e_v": "expectedV", "fdr_bl": "fdrBL", "fdr_donut": "fdrDonut",
    "fdr_h": "fdrH", "fdr_v": "fdrV", "num_collapsed": "numCollapsed",
}
#: Layouts of read-pair lines by number of tokens.
LAYOUTS = {4: "super_short", 5: "super_short_score", 8: "short", 9: "short_score", 11: "medium", 16: "long"}


def layout_of(line: str) -> str:
    """The layout that a file's first line shows."""
    if line.startswith("#"):
        return "dcic"
    n = len(line.split())
    if n not in LAYOUTS:
        raise ValueError(f"no layout of read pairs has {n} columns")
    return LAYOUTS[n]


def dcic_columns(header: list[str]) -> dict[str, int]:
    """Where the optional columns are, from a #columns line."""
    for line in header:
        if line.startswith("#columns"):
            names = line.split()[1:]
            return {c: names.index(c) for c in ("frag1", "frag2", "mapq1", "mapq2") if c in names}
    return {}


def parse_pairs(lines: DataFrame, layout: str, optional: dict[str, int] | None = None) -> DataFrame:
    """Lines (value) to pairs. Absent columns: forward, reverse, fragments 0 and 1, quality 1000, score 1."""
    t = F.split(F.trim("value"), r"\s+")
    forward = lambda k: t[k] == "0"
    number = lambda k: t[k].cast("int")
    p: dict[str, Column] = {"strand1": F.lit(True), "frag1": F.lit(0), "mapq1": F.lit(1000), "strand2": F.lit(False), "frag2": F.lit(1), "mapq2": F.lit(1000), "score": F.lit(1.0), "seq1": F.lit(None), "seq2": F.lit(None)}

    def ends(k: int) -> None:
        """strand, chromosome, position and fragment of both ends, from column k."""
        for e, at in (("1", k), ("2", k + 4)):
            p.update({f"strand{e}": forward(at), f"chr{e}": t[at + 1], f"pos{e}": number(at + 2), f"frag{e}": number(at + 3)})

    if layout.startswith("super_short"):
        p |= {"chr1": t[0], "pos1": number(1), "chr2": t[2], "pos2": number(3)}
        p |= {"score": t[4].cast("double")} if layout.endswith("score") else {}
    elif layout.startswith("short"):
        ends(0)
        p |= {"score": t[8].cast("double")} if layout.endswith("score") else {}
    elif layout == "medium":
        ends(1)
        p |= {"mapq1": number(9), "mapq2": number(10)}
    elif layout == "long":
        ends(0)
        p |= {"mapq1": number(8), "seq1": t[10], "mapq2": number(11), "seq2": t[13]}
    elif layout == "dcic":
        lines = lines.where(~F.col("value").startswith("#"))
        p |= {"chr1": t[1], "pos1": number(2), "chr2": t[3], "pos2": number(4), "strand1": t[5] == "+", "strand2": t[6] == "+"}
        p |= {c: number(k) for c, k in (optional or {}).items()}
    else:
        raise ValueError(f"unknown layout {layout!r}")
    order = ["strand1", "chr1", "pos1", "frag1", "mapq1", "strand2", "chr2", "pos2", "frag2", "mapq2", "score", "seq1", "seq2"]
    return lines.select(*(p[c].cast("string" if c.startswith(("chr", "seq")) else "float" if c == "score" else "int" if not c.startswith("strand") else "boolean").alias(c) for c in order))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of pairs in text, plain or compressed; the layout comes from the first lines."""
    lines = spark.read.text(path)
    head = [r["value"] for r in lines.limit(200).collect()]
    layout = layout_of(head[0]) if head else "short"
    return parse_pairs(lines, layout, dcic_columns(head) if layout == "dcic" else None)


def with_ordinals(pairs: DataFrame, chrom_sizes: DataFrame, clean: bool = False) -> DataFrame:
    """Chromosomes by number; pairs with an unknown one go. chrom_sizes: chr, name, length.

    A join by shuffle would leave all pairs of a chromosome to one task; so the list is counted, and broadcast if it is short.
    """
    from contactgrid.functions.scalars import clean_chromosome
    from contactgrid.tables import counted

    chrom_sizes = counted(chrom_sizes)
    for e in ("1", "2"):
        dim = chrom_sizes.select(F.col("name").alias(f"_name{e}"), F.col("chr").alias(f"_chr{e}"))
        key = clean_chromosome(F.col(f"chr{e}")) if clean else F.col(f"chr{e}")
        pairs = pairs.join(dim, key == F.col(f"_name{e}")).withColumn(f"chr{e}", F.col(f"_chr{e}")).drop(f"_name{e}", f"_chr{e}")
    return pairs


def read_any_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of any format, by the path's ending: .bin or .bn records, or else text."""
    from contactgrid.sources import binary

    return binary.read_binary_pairs(spark, path) if path.rstrip("*/").endswith((".bin", ".bn")) else read_pairs(spark, path)


def parse_chrom_sizes(lines: DataFrame, line: str | None = None) -> DataFrame:
    """Name and length of each line of two tokens; chr numbers them, from 1, in the order of the file.

    ``line`` names a column with the lines' numbers; without it, lines are in the order that a file of one partition is read in.
    """
    t = F.split(F.trim("value"), r"\s+")
    at = F.col(line) if line else F.monotonically_increasing_id()
    rows = lines.withColumn("_at", at).where(F.size(t) == 2).select("_at", t[0].alias("name"), t[1].cast("long").alias("length"))
    return rows.withColumn("chr", F.row_number().over(Window.orderBy("_at"))).drop("_at")


def parse_sites(lines: DataFrame) -> DataFrame:
    """Chr, idx, pos of each cut site; a line is a chromosome and its sites.

    A line is split before its sites become rows: a split beside them would be made anew for each site.
    """
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("t"))
    named = parts.select(F.col("t")[0].alias("chr"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("sites"))
    return named.select("chr", F.posexplode("sites").alias("idx", "site")).select("chr", "idx", F.col("site").cast("int").alias("pos"))


def _attributes(names: list[str], first: int) -> Column:
    """The columns from ``first`` on by their names; a line's missing ones are left out."""
    t = F.split("value", "\t", -1)
    if len(names) <= first:
        return F.create_map().cast("map<string,string>")
    n = F.least(F.size(t), F.lit(len(names))) - first
    return F.when(n > 0, F.map_from_arrays(F.slice(F.array(*map(F.lit, names[first:])), F.lit(1), n), F.slice(t, F.lit(first + 1), n))).otherwise(F.create_map().cast("map<string,string>"))


def parse_bedpe(lines: DataFrame, header: str) -> DataFrame:
    """Features with their attributes by the header's names, common abbreviations in full.

    The colour is in the column that the header calls so: the eleventh of the current layout, the seventh of the older one.
    """
    names = [ALIASES.get(x.strip().lower(), x.strip()) for x in header.lstrip("#").split("\t")]
    at = next((k for k, x in enumerate(names) if x.lower() in ("color", "colour")), 10)
    t = F.split("value", "\t", -1)
    rows = lines.where(~F.col("value").startswith("#") & ~F.lower("value").startswith("chr1\tx1"))
    long_ = lambda k: t[k].cast("long")
    return rows.select(
        t[0].alias("chr1"), long_(1).alias("start1"), long_(2).alias("end1"), t[3].alias("chr2"), long_(4).alias("start2"), long_(5).alias("end2"), F.get(t, F.lit(at)).alias("color"),
        _attributes(names, at + 1).alias("attrs"),
    )


def parse_domains(lines: DataFrame, header: str) -> DataFrame:
    """Domains of one interval a line, as features whose two ends are that interval."""
    names = [ALIASES.get(x.strip().lower(), x.strip()) for x in header.lstrip("#").split("\t")]
    t = F.split("value", "\t", -1)
    rows = lines.where(~F.col("value").startswith("#") & ~F.lower("value").startswith("chr\tx1"))
    start, end = t[1].cast("long"), t[2].cast("long")
    return rows.select(t[0].alias("chr1"), start.alias("start1"), end.alias("end1"), t[0].alias("chr2"), start.alias("start2"), end.alias("end2"), _attributes(names, 3).alias("attrs"))


def parse_bed(lines: DataFrame) -> DataFrame:
    """Distinct intervals of lines that start with chr and have three columns or more."""
    t = F.split("value", r"\s+")
    return lines.where(F.col("value").startswith("chr") & (F.size(t) >= 3)).select(t[0].alias("chr"), t[1].cast("long").alias("x1"), t[2].cast("long").alias("x2")).distinct()


def parse_fimo(lines: DataFrame) -> DataFrame:
    """Motifs from lines of nine columns."""
    t = F.split("value", "\t", -1)
    return lines.where((F.size(t) == 9) & ~F.col("value").startswith("#")).select(
        t[1].alias("chr"), t[2].cast("long").alias("x1"), t[3].cast("long").alias("x2"), (t[4] == "+").alias("forward"), t[5].cast("double").alias("score"),
        t[6].cast("double").alias("p_value"), t[7].cast("double").alias("q_value"), t[8].alias("sequence"),
    )


def parse_genes(lines: DataFrame) -> DataFrame:
    """Genes from refGene lines of 16 columns, or of four (name, chr, start, end)."""
    t = F.split(F.trim("value"), r"\s+")
    many = F.size(t) >= 13
    pick = lambda a, b: F.when(many, F.get(t, F.lit(a))).otherwise(F.get(t, F.lit(b)))
    rows = lines.where((F.size(t) == 4) | many)
    return rows.select(pick(12, 0).alias("name"), pick(2, 1).alias("chr"), pick(4, 2).cast("long").alias("x1"), pick(5, 3).cast("long").alias("x2"))


def parse_bedgraph(lines: DataFrame) -> DataFrame:
    """Chr, x1, x2, score."""
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.size(t) == 4) & ~F.col("value").rlike("^(track|browser|#)"))
    return rows.select(t[0].alias("chr"), t[1].cast("long").alias("x1"), t[2].cast("long").alias("x2"), t[3].cast("double").alias("score"))


#: Lines that a stretch of a file holds, where they are numbered through.
STRETCH_LINES = 1 << 20


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as Spark splits them: file, stretch (the byte at which the split begins), line (rising within it), value."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("stretch"))
    return lines.select("file", "stretch", F.monotonically_increasing_id().alias("line"), "value")


def under_heads(lines: DataFrame, is_head: Column, is_data: Column) -> DataFrame:
    """The data lines, each with the last head line before it in its file (head) and its place under it, from 0. Lines before the first head go.

    A file is worked on in stretches: those of numbered_lines(), or else of STRETCH_LINES lines. Each stretch tells its last head and how many data lines it has, one row, and gets
    from those before it what it begins with; so neither a file nor a section is one task's.
    """
    if "stretch" not in lines.columns:
        lines = lines.withColumn("stretch", F.floor(F.col("line") / STRETCH_LINES))
    rows = lines.select("file", "stretch", "line", "value", is_head.alias("is_head"), is_data.alias("is_data")).where("is_head or is_data")
    inside = Window.partitionBy("file", "stretch").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.col("is_data").cast("long")).over(inside)
    rows = rows.withColumn("seen", seen).withColumn("own", F.last(F.when(F.col("is_head"), F.struct(F.col("value").alias("head"), "seen")), True).over(inside))
    told = rows.groupBy("file", "stretch").agg(F.max_by("own", "line").alias("last"), F.sum(F.col("is_data").cast("long")).alias("n"))
    before = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("n").over(before), F.lit(0))
    told = told.withColumn("at", at).withColumn("last", F.when(F.col("last").isNotNull(), F.struct(F.col("last.head").alias("head"), (F.col("at") + F.col("last.seen")).alias("seen"))))
    carried = told.select("file", "stretch", "at", F.last("last", True).over(before).alias("carried"))
    found = rows.where("is_data").join(carried, ["file", "stretch"])
    mine = F.col("own").isNotNull()
    head = F.when(mine, F.col("own.head")).otherwise(F.col("carried.head"))
    place = F.col("at") + F.col("seen") - 1 - F.when(mine, F.col("at") + F.col("own.seen")).otherwise(F.col("carried.seen"))
    return found.select("file", head.alias("head"), place.alias("place"), "value").where("head is not null")


def parse_wig(lines: DataFrame) -> DataFrame:
    """Chr, x1, x2 (from 0, the end not included), score of fixed and variable steps. lines: file, line (its number), value, or numbered_lines().

    A line belongs to the last declaration before it in its file. Values in fixed steps follow each other; nan is null.
    """
    declares = F.col("value").rlike("^(fixed|variable)Step")
    rows = under_heads(lines, declares, ~declares & ~F.col("value").rlike("^(track|browser|#)") & (F.trim("value") != ""))
    named = lambda key, default: F.coalesce(F.regexp_extract("head", rf"\b{key}=(\S+)", 1).try_cast("long"), F.lit(default))
    fixed = F.col("head").startswith("fixedStep")
    t = F.split(F.trim("value"), r"\s+")
    start = F.when(fixed, named("start", 1) - 1 + F.col("place") * named("step", 1)).otherwise(F.get(t, F.lit(0)).try_cast("long") - 1)
    score = F.when(fixed, F.get(t, F.lit(0))).otherwise(F.get(t, F.lit(1))).try_cast("double")
    return rows.select(F.regexp_extract("head", r"\bchrom=(\S+)", 1).alias("chr"), start.alias("x1"), (start + named("span", 1)).alias("x2"), F.when(~F.isnan(score), score).alias("score"))


def parse_norm_vectors(lines: DataFrame) -> DataFrame:
    """Norm, chr, bin_size, unit, bin and value from sections under 'vector TYPE CHR RES UNIT' lines.

    lines: file, line (its number), value, or numbered_lines(). nan and . are null. A section is the lines to the next header of its file.
    """
    head = F.col("value").startswith("vector")
    rows = under_heads(lines, head, ~head)
    t = F.split("head", r"\s+")
    value = F.when(~F.lower(F.trim("value")).isin("nan", "."), F.trim("value").try_cast("double"))
    return rows.select(t[1].alias("norm"), t[2].alias("chr"), t[3].cast("int").alias("bin_size"), t[4].alias("unit"), F.col("place").cast("int").alias("bin"), value.alias("value"))
