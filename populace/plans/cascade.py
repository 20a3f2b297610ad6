"""Step-by-step labelling: each step's parent is a predicate over earlier steps' labels.

With gates known up front a whole plan is one projection. Plans of many steps are
cut every few steps by a checkpoint in the shared folder, so expressions stay small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import UNASSIGNED, compile_predicate, parse, quoted
from ..operators.gates import assign


@dataclass(frozen=True)
class Step:
    column: str
    parent: str
    x: str
    y: str
    gates: Mapping = field(default_factory=dict)
    options: Sequence[str] = ()


def cascade(df: DataFrame, steps: Sequence[Step], rule: str = "smallest", cut_every: int = 10) -> DataFrame:
    """Adds each step's column: the winning gate inside the parent, Unassigned elsewhere."""
    for i, s in enumerate(steps, 1):
        label = assign(quoted(s.x), quoted(s.y), s.gates, s.options, rule)
        df = df.withColumn(s.column, F.when(compile_predicate(s.parent, df.columns), label).otherwise(UNASSIGNED))
        if cut_every and i % cut_every == 0 and i < len(steps):
            from .flagship import cut_lineage

            df = cut_lineage(df)
    return df


def step_status(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """(step, n_parent, n_labelled, status) in one pass: empty parents are skipped."""
    aggs = []
    for i, s in enumerate(steps):
        inside = compile_predicate(s.parent, df.columns)
        aggs += [F.count_if(inside).alias(f"p{i}"), F.count_if(quoted(s.column) != UNASSIGNED).alias(f"l{i}")]
    rows = F.explode(F.array(*(F.struct(F.lit(s.column).alias("step"), F.col(f"p{i}").alias("n_parent"), F.col(f"l{i}").alias("n_labelled")) for i, s in enumerate(steps))))
    out = df.agg(*aggs).select(rows.alias("r")).select("r.*")
    return out.withColumn("status", F.when(F.col("n_parent") == 0, "empty_parent").otherwise("ok"))


def labels_from_booleans(df: DataFrame, steps: Sequence[tuple[str, str, Mapping[str, str]]]) -> DataFrame:
    """Label columns from boolean gate columns: (column, parent, category -> gate column);
    the last category in plan order whose gate holds inside the parent wins."""
    for column, parent, gates in steps:
        out = None
        for category, gate in reversed(gates.items()):
            out = F.when(quoted(gate), category) if out is None else out.when(quoted(gate), category)
        df = df.withColumn(column, F.when(compile_predicate(parent, df.columns), out))
    return df


def labels_by_lookup(df: DataFrame, steps: Sequence[tuple[str, str, Sequence[str]]], gates: Sequence[str], aliases: Mapping[str, str] | None = None, hints: Mapping[str, str] | None = None) -> DataFrame:
    """As labels_from_booleans, from (column, parent, categories): a category's gate column is
    found among ``gates`` by its own name or path suffix, else by the name that ``aliases`` gives
    it, of which ``hints`` (category prefix -> part of the parent's path) picks among several.
    A category without a gate column labels nothing."""
    from ..functions.predicates import gate_column

    aliases, hints = aliases or {}, hints or {}
    named = []
    for column, parent, categories in steps:
        found = {}
        for c in categories:
            at = gate_column(gates, c)
            if at is None and c in aliases:
                at = gate_column(gates, aliases[c], next((h for p, h in hints.items() if c.startswith(p)), None))
            if at is not None:
                found[c] = at
        named.append((column, parent, found))
    return labels_from_booleans(df, named)


def leaf_categories(steps: Sequence[tuple[str, Sequence[str]]]) -> list[str]:
    """Categories that no step's parent names, in plan order. steps: (parent, categories)."""
    used = {v for parent, _ in steps for c in parse(parent) for v in c.values}
    return list(dict.fromkeys(c for _, categories in steps for c in categories if c not in used))
