"""Assembly layouts: edits of the order of scaffolds, and their places."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Layout = list[list[int]]


def parse_assembly(lines: list[str]) -> tuple[list[tuple[str, int, int]], Layout]:
    """Scaffolds (name, id, length) of '>name id length' lines and the layout, a list of lists of signed ids, of the others."""
    scaffolds, layout = [], []
    for line in lines:
        t = line.split()
        if not t:
            continue
        if t[0].startswith(">"):
            scaffolds.append((t[0][1:], int(t[1]), int(t[2])))
        else:
            layout.append([int(x) for x in t])
    return scaffolds, layout


def format_assembly(scaffolds: list[tuple[str, int, int]], layout: Layout) -> list[str]:
    """K13."""
    return [f">{n} {i} {size}" for n, i, size in scaffolds] + [" ".join(map(str, row)) for row in layout]


def _cut(layout: Layout, first: int, last: int) -> tuple[int, int, int]:
    """Where a span of one superscaffold is, by the ids at its ends."""
    for k, row in enumerate(layout):
        ids = [abs(x) for x in row]
        if first in ids and last in ids:
            a, b = sorted((ids.index(first), ids.index(last)))
            return k, a, b
    raise ValueError(f"{first} and {last} aren't in one superscaffold")


def invert(layout: Layout, first: int, last: int) -> Layout:
    """The span in reverse, each scaffold turned."""
    k, a, b = _cut(layout, first, last)
    row = layout[k]
    turned = row[:a] + [-x for x in reversed(row[a : b + 1])] + row[b + 1 :]
    return [turned if n == k else list(r) for n, r in enumerate(layout)]


def move(layout: Layout, first: int, last: int, after: int) -> Layout:
    """The span cut out and put behind a scaffold."""
    k, a, b = _cut(layout, first, last)
    span = layout[k][a : b + 1]
    if after in {abs(x) for x in span}:
        raise ValueError("a span can't be moved into itself")
    rest = [r[:a] + r[b + 1 :] if n == k else list(r) for n, r in enumerate(layout)]
    out = []
    for r in rest:
        at = next((i for i, x in enumerate(r) if abs(x) == after), None)
        r = r if at is None else r[: at + 1] + span + r[at + 1 :]
        if r:
            out.append(r)
    return out


def split(layout: Layout, behind: int) -> Layout:
    """A superscaffold cut behind a scaffold."""
    out = []
    for r in layout:
        at = next((i for i, x in enumerate(r) if abs(x) == behind), None)
        out += [r] if at is None or at == len(r) - 1 else [r[: at + 1], r[at + 1 :]]
    return out


def merge(layout: Layout, first: int, second: int) -> Layout:
    """The superscaffolds from that of one scaffold to that of another as one."""
    where = lambda s: next(k for k, r in enumerate(layout) if s in map(abs, r))
    a, b = sorted((where(first), where(second)))
    return [*layout[:a], [x for r in layout[a : b + 1] for x in r], *layout[b + 1 :]]


def scatter(layout: Layout, first: int, last: int) -> Layout:
    """Each scaffold of the span a superscaffold of its own."""
    k, a, b = _cut(layout, first, last)
    r = layout[k]
    parts = [r[:a], *([x] for x in r[a : b + 1]), r[b + 1 :]]
    return [*layout[:k], *(p for p in parts if p), *layout[k + 1 :]]


@dataclass
class History:
    """Edits that can be undone and done again."""

    states: list[Layout]
    at: int = 0
    edits: list[str] = field(default_factory=list)

    def apply(self, edit, *args: int) -> Layout:
        self.states = [*self.states[: self.at + 1], edit(self.states[self.at], *args)]
        self.at += 1
        return self.states[self.at]

    def undo(self) -> Layout:
        self.at = max(0, self.at - 1)
        return self.states[self.at]

    def redo(self) -> Layout:
        self.at = min(len(self.states) - 1, self.at + 1)
        return self.states[self.at]


def resolve(scaffolds: DataFrame, layout: DataFrame) -> DataFrame:
    """Each scaffold's new start and whether it is turned. scaffolds: id, length; layout: super_id, pos, signed_id.

    Starts are sums within superscaffolds on top of sums over these, so only the latter are ordered in one task.
    """
    placed = layout.withColumn("id", F.abs("signed_id")).join(scaffolds, "id")
    inside = Window.partitionBy("super_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inner", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    supers = placed.groupBy("super_id").agg(F.sum("length").alias("size"))
    supers = supers.select("super_id", F.coalesce(F.sum("size").over(Window.orderBy("super_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    out = placed.join(supers, "super_id")
    return out.select("id", "super_id", "pos", (F.col("inner") + F.col("outer")).alias("new_start"), (F.col("signed_id") < 0).alias("inverted"), "length")


def aggregates(resolved: DataFrame) -> DataFrame:
    """Runs of neighbours that lie as they did before, (id follows id on both, in one direction), as single pieces."""
    by = Window.partitionBy("super_id").orderBy("pos")
    step = F.when(F.col("inverted"), -1).otherwise(1)
    same = (F.lag("inverted").over(by) == F.col("inverted")) & (F.col("id") - F.lag("id").over(by) == step)
    run = F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return resolved.withColumn("run", run).groupBy("super_id", "run").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("new_start").alias("new_start"), F.sum("length").alias("length"), F.first("inverted").alias("inverted"))


def assembly_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A file's lines (line, value) as rows: scaffolds (id, name, length), and the layout (super_id, the line's number; pos from 0; signed_id)."""
    t, head = F.split(F.trim("value"), r"\s+"), F.col("value").startswith(">")
    scaffolds = lines.where(head).select(t[1].cast("int").alias("id"), F.substring(t[0], 2, 1 << 30).alias("name"), t[2].cast("long").alias("length"))
    layout = lines.where(~head & (F.trim("value") != "")).select(F.col("line").alias("super_id"), F.posexplode(t).alias("pos", "signed_id"))
    return scaffolds, layout.withColumn("signed_id", F.col("signed_id").cast("int"))


def _chains(layout: DataFrame) -> DataFrame:
    """Signed ids of each superscaffold as a line."""
    row = F.transform(F.sort_array(F.collect_list(F.struct("pos", "signed_id"))), lambda x: x["signed_id"].cast("string"))
    return layout.groupBy("super_id").agg(F.array_join(row, " ").alias("value")).select(F.lit(1).alias("part"), F.col("super_id").cast("long").alias("line"), "value")


def assembly_lines(scaffolds: DataFrame, layout: DataFrame) -> DataFrame:
    """The lines again: part (scaffolds, then superscaffolds) and line are their order."""
    heads = scaffolds.select(F.lit(0).alias("part"), F.col("id").cast("long").alias("line"), F.concat(F.lit(">"), F.concat_ws(" ", "name", "id", "length")).alias("value"))
    return heads.unionByName(_chains(layout))


def phasing_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants (id, chr, pos, ref, alt) of '>chr pos ref alt id' lines, and chains of signed ids (super_id, pos, signed_id), where a negative one has its alternative on the first copy."""
    t, head = F.split(F.trim("value"), r"\s+"), F.col("value").startswith(">")
    variants = lines.where(head).select(t[4].cast("int").alias("id"), F.substring(t[0], 2, 1 << 30).alias("chr"), t[1].cast("long").alias("pos"), t[2].alias("ref"), t[3].alias("alt"))
    return variants, assembly_rows(lines)[1]


def phasing_scaffolds(variants: DataFrame, chains: DataFrame, length: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """The two forms of each variant as scaffolds of their own (2 id - 1 the reference's, 2 id the alternative), and of each chain its two copies as superscaffolds."""
    forms = F.inline(F.array(*(F.struct((2 * F.col("id") - 1 + k).alias("form"), F.col(c).alias("variant")) for k, c in enumerate(("ref", "alt")))))
    scaffolds = variants.select("chr", "pos", "id", "ref", "alt", forms).select(F.col("form").alias("id"), F.concat_ws(":", "chr", "pos", "variant").alias("name"), F.lit(length).cast("long").alias("length"))
    size, turned = F.abs("signed_id"), (F.col("signed_id") < 0).cast("int")
    copies = F.inline(F.array(*(F.struct((2 * F.col("super_id") + k).alias("copy"), (2 * size - F.when(turned == k, 1).otherwise(0)).alias("form")) for k in (0, 1))))
    layout = chains.select("super_id", "pos", "signed_id", copies).select(F.col("copy").alias("super_id"), "pos", F.col("form").alias("signed_id"))
    return scaffolds, layout


def phasing_lines(scaffolds: DataFrame, layout: DataFrame) -> DataFrame:
    """The phasing file of scaffolds and superscaffolds as phasing_scaffolds() makes them: part, line, value. The first copy of each chain tells it."""
    t = F.split("name", ":")
    of = lambda rest, c: scaffolds.where(F.col("id") % 2 == rest).select(F.ceil(F.col("id") / 2).alias("variant"), t[0].alias("chr"), t[1].alias("at"), t[2].alias(c))
    both = of(1, "ref").join(of(0, "alt").select("variant", "alt"), "variant")
    heads = both.select(F.lit(0).alias("part"), F.col("variant").cast("long").alias("line"), F.concat(F.lit(">"), F.concat_ws(" ", "chr", "at", "ref", "alt", "variant")).alias("value"))
    signed = F.when(F.col("signed_id") % 2 == 0, -F.col("signed_id") / 2).otherwise((F.col("signed_id") + 1) / 2).cast("int")
    first = layout.where(F.col("super_id") % 2 == 0).select(F.floor(F.col("super_id") / 2).alias("super_id"), "pos", signed.alias("signed_id"))
    return heads.unionByName(_chains(first))
