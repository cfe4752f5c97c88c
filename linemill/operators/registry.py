"""Template mining: the mode of each block, its registry of templates, and why a block stays unparsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linemill.functions import tokens as t

#: Lines sampled for the mode, share of distinct templates above which it is aggressive, and the share of
#: the lines that may be templates, by mode, with the least number that the gate minds.
SAMPLE_LINES, AGGRESSIVE_ABOVE = 1000, 0.10
GATE_SHARE, GATE_FLOOR = {"aggressive": 0.40, "strict": 0.25}, 100


def mode_choice(lines: DataFrame) -> DataFrame:
    """(block_id, n_sampled, n_distinct, mode) from each block's first lines."""
    sample = lines.where(F.col("line_no") < SAMPLE_LINES).select("block_id", t.skeleton(t.for_analysis(F.col("line"))).alias("s"))
    counted = sample.groupBy("block_id").agg(F.count("*").alias("n_sampled"), F.count_distinct("s").alias("n_distinct"))
    share = F.try_divide(F.col("n_distinct"), F.col("n_sampled"))
    return counted.withColumn("mode", F.when(share > AGGRESSIVE_ABOVE, "aggressive").otherwise("strict"))


def parsed(lines: DataFrame, mode: str | None = None) -> DataFrame:
    """lines with mode, skeleton and vars; without a given mode, each block's own."""
    if mode:
        return lines.select("*", F.lit(mode).alias("mode"), t.skeleton(F.col("line"), mode).alias("skeleton"), t.variables(F.col("line"), mode).alias("vars"))
    moded = lines.join(mode_choice(lines).select("block_id", "mode"), "block_id")
    return moded.select("*", t.by_mode(F.col("line"), F.col("mode"), t.skeleton).alias("skeleton"), t.by_mode(F.col("line"), F.col("mode"), t.variables).alias("vars"))


def templates(parsed_lines: DataFrame) -> DataFrame:
    """The registry: (block_id, template_id, freq_id, skeleton, n_vars, n_rows, first_line).

    Lines are counted before they are shuffled; ids are ranks over the templates alone, by first appearance and by
    frequency (ties by first appearance).
    """
    counted = parsed_lines.groupBy("block_id", "skeleton").agg(F.count("*").alias("n_rows"), F.min("line_no").alias("first_line"))
    by_first = Window.partitionBy("block_id").orderBy("first_line")
    by_count = Window.partitionBy("block_id").orderBy(F.desc("n_rows"), "first_line")
    return counted.select(
        "block_id", (F.row_number().over(by_first) - 1).alias("template_id"), (F.row_number().over(by_count) - 1).alias("freq_id"),
        "skeleton", t.n_vars(F.col("skeleton")).alias("n_vars"), "n_rows", "first_line",
    )


def gate_limit(n_lines: Column, mode: Column) -> Column:
    """A block of more templates than this stays unparsed. n_lines: line feeds plus one."""
    share = F.when(mode == "aggressive", GATE_SHARE["aggressive"]).otherwise(GATE_SHARE["strict"])
    return F.greatest(F.floor(n_lines * share), F.lit(GATE_FLOOR)).cast("long") + 1


def entropy_gate(parsed_lines: DataFrame) -> DataFrame:
    """(block_id, mode, n_lines, n_templates, gate_limit, passthrough): in closed form, whatever the lines' order."""
    feeds = F.count_if(F.endswith(F.col("line"), F.lit("\n"))) + 1
    counted = parsed_lines.groupBy("block_id", "mode").agg(feeds.alias("n_lines"), F.count_distinct("skeleton").alias("n_templates"))
    limit = gate_limit(F.col("n_lines"), F.col("mode"))
    return counted.select("*", limit.alias("gate_limit"), (F.col("n_templates") > limit).alias("passthrough"))


def passthrough_reason(parsed_lines: DataFrame, binary: DataFrame | None = None) -> DataFrame:
    """(block_id, reason): binary, else whichever comes first of a line that collides and the gate; null if parsed."""
    gate = entropy_gate(parsed_lines)
    reg = templates(parsed_lines).select("block_id", "template_id", "first_line")
    fires = gate.where("passthrough").join(reg, "block_id").where("template_id = gate_limit").select("block_id", F.col("first_line").alias("gate_line"))
    hits = parsed_lines.where(t.collides(F.col("line"))).groupBy("block_id").agg(F.min("line_no").alias("hit_line"))
    out = gate.select("block_id").join(fires, "block_id", "left").join(hits, "block_id", "left")
    reason = F.when(F.col("hit_line") <= F.coalesce("gate_line", "hit_line"), "Collision Protected").when(F.col("gate_line").isNotNull(), "Passthrough [Entropy]")
    if binary is not None:
        out = out.join(binary.select("block_id", "binary"), "block_id", "left")
        reason = F.when(F.col("binary"), "Passthrough [Binary]").otherwise(reason)
    return out.select("block_id", reason.alias("reason"))


def assigned(parsed_lines: DataFrame, registry: DataFrame, id_col: str = "template_id") -> DataFrame:
    """(block_id, line_no, template_id, vars): each line's id by an equi-join on its template."""
    ids = registry.select("block_id", "skeleton", F.col(id_col).alias("template_id"))
    return parsed_lines.join(ids, ["block_id", "skeleton"]).select("block_id", "line_no", "template_id", "vars")


def id_flag(n_templates: Column) -> Column:
    """How ids are stored: 3 not at all, 2 in one byte, 0 in two, 1 in four."""
    return F.when(n_templates == 1, 3).when(n_templates < 256, 2).when(n_templates > 65_535, 1).otherwise(0)
