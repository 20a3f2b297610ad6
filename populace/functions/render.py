"""Prompt text from aggregated rows, with built-in string functions only.

Renderers take columns of tables that are already small (a row a task, a row a
representative), so prompts are made where the aggregates are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.perturb import replace_names

#: Marks of a density bar from empty to full.
MARKS = " .:-=+*#@"
#: What each prompt variant leaves out.
VARIANTS = {"full": (), "no_desc": ("context",), "no_hist": ("histogram",), "no_pv": ("peaks",), "anon": ()}


def density_bar(counts: Column, marks: str = MARKS) -> Column:
    """One mark for each bin, by its share of the fullest one; a bin with rows is never blank."""
    top = F.array_max(counts)
    level = lambda n: F.ceil(n * (len(marks) - 1) / F.greatest(top, F.lit(1))).cast("int")
    return F.array_join(F.transform(counts, lambda n: F.substring(F.lit(marks), level(n) + 1, F.lit(1))), "")


#: The marks of a block bar, from low to full.
BLOCKS = "▁▂▃▄▅▆▇█"


def block_bar(counts: Column, scale: str = "linear") -> Column:
    """A block for each bin, by its share of the fullest one, rounded to even; ``log`` compares
    logarithms of the counts. An empty bin is blank, and a bar without rows all low."""
    size = (lambda n: F.log1p(F.greatest(n, F.lit(0)))) if scale == "log" else (lambda n: F.greatest(n, F.lit(0)).cast("double"))
    top = F.array_max(F.transform(counts, size))
    level = lambda n: F.bround(size(n) / top * (len(BLOCKS) - 1), 0).cast("int")
    mark = lambda n: F.when(top <= 0, BLOCKS[0]).when(n <= 0, " ").otherwise(F.substring(F.lit(BLOCKS), level(n) + 1, F.lit(1)))
    return F.array_join(F.transform(counts, mark), "")


def axis_line(name: Column, n: Column, low: Column, high: Column, quartiles: Sequence[Column]) -> Column:
    return F.format_string("%s: n=%d, %.2f to %.2f, quartiles %.2f / %.2f / %.2f", name, n, low, high, *quartiles)


def points_line(kind: str, at: Column) -> Column:
    """``peaks: 0.50, 2.10`` or ``peaks: none``."""
    shown = F.array_join(F.transform(at, lambda v: F.format_string("%.2f", v)), ", ")
    return F.concat(F.lit(f"{kind}: "), F.when(F.coalesce(F.size(at), F.lit(0)) > 0, shown).otherwise("none"))


def cloud_lines(clouds: Column) -> Column:
    """A line for each cloud: array of struct(level, n, event)."""
    return F.array_join(F.transform(clouds, lambda c: F.format_string("- level %d: %d rows, %s", c["level"], c["n"], c["event"])), "\n")


def prompt(sections: Mapping[str, Column], variant: str = "full", names: Mapping[str, str] | None = None, protected: Sequence[str] = ()) -> Column:
    """Titled sections in order, without those the variant leaves out; ``anon`` also
    replaces marker names, but for protected category names."""
    kept = [F.concat(F.lit(f"## {k}\n"), v) for k, v in sections.items() if k not in VARIANTS[variant]]
    text = F.concat_ws("\n\n", *kept)
    return replace_names(text, names or {}, protected) if variant == "anon" else text


def cells_prompt(rows: DataFrame, group: Sequence[str], slot: str, sentence: str) -> DataFrame:
    """(group, prompt): ``## cell_N`` and its sentence for each representative, by slot."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(slot).alias("i"), F.col(sentence).alias("s"))))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("## cell_"), p["i"].cast("string"), F.lit("\n"), p["s"])), "\n\n")
    return rows.groupBy(*group).agg(text.alias("prompt"))


def options_line(categories: Column) -> Column:
    return F.concat(F.lit("options: "), F.array_join(F.array_distinct(F.concat(categories, F.array(F.lit("Unassigned")))), " | "))
