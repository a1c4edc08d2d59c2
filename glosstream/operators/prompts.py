"""Prompts for a model as columns: templates filled in, and one prompt for each group of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(template: Column | str, values: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced."""
    start = F.lit(template) if isinstance(template, str) else template
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string")), values.items(), start)


def item_block(seq: Column, kind: Column, source: Column, target: Column, hints: Column) -> Column:
    """One row of a group: its number and kind, both texts, and the hints if there are any."""
    noted = F.when(F.size(hints) > 0, F.concat(F.lit("hints: "), F.array_join(hints, "; ")))
    return F.concat_ws("\n", F.concat(F.lit("id: "), seq.cast("string")), F.concat(F.lit("kind: "), kind), F.concat(F.lit("source: "), source), F.concat(F.lit("target: "), target), noted)


def group_prompts(rows: DataFrame, template: str, language: str, extra: str = "") -> DataFrame:
    """(group_key, n, prompt) of rows(group_key, seq, row_type, source, target, hints): a group has at most as many rows as a request."""
    block = item_block(F.col("seq"), F.col("row_type"), F.col("source"), F.col("target"), F.col("hints"))
    listed = rows.select("group_key", "seq", block.alias("b")).groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("seq", "b"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["b"]), "\n\n")
    return listed.select("group_key", F.size("l").alias("n"), render(template, {"language": F.lit(language), "count": F.size("l"), "extra": F.lit(extra), "items": text}).alias("prompt"))


def examples_block(examples: Column, source: str, target: str) -> Column:
    """Pairs (source, target) as lines; empty without any."""
    lines = F.transform(examples, lambda e: F.concat(F.lit(f"{source}: "), e["source"], F.lit(f"\n{target}: "), e["target"]))
    return F.when(F.size(examples) > 0, F.array_join(lines, "\n\n")).otherwise("")


def term_block(pairs: Column) -> Column:
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: F.concat(p["ar"], F.lit(" → "), p["title"])), "\n")).otherwise("")
