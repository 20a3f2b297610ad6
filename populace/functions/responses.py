"""Model answers: text to gates, leaves and annotations.

Simple shapes use JSON columns. Free text that holds JSON somewhere needs a
brace scanner, which is an Arrow-batched function over whole answers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = r"(?s)```(?:json)?\s*(.*?)```"
GATE = "category string, ord int, kind string, x_min double, x_max double, y_min double, y_max double, vertices array<array<double>>"


def without_thinking(text: Column) -> Column:
    """Closed think blocks go; so does all up to a lone closing tag, or from a lone opening one."""
    text = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    text = F.regexp_replace(text, r"(?s)^.*</think>", "")
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*$", ""))


def fenced(text: Column) -> Column:
    """The last fenced block, or the text itself."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    return F.trim(F.coalesce(F.try_element_at(blocks, F.lit(-1)), text))


def objects(text: str) -> list[str]:
    """Balanced {...} parts at the outermost level, strings respected; an unclosed
    part gives its closed inner ones."""
    out: list[str] = []
    stack: list[int] = []
    inner: list[tuple[int, str]] = []
    quoted = escaped = False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"' and stack:
            quoted = True
        elif c == "{":
            stack.append(i)
        elif c == "}" and stack:
            start = stack.pop()
            part = text[start : i + 1]
            if stack:
                inner.append((start, part))
            else:
                out.append(part)
                inner = []
    return out + [p for _, p in inner] if stack else out


def best_object(text: str | None, expected: Sequence[str]) -> dict | None:
    """The parsed object that shares most keys with ``expected``, the last of equal ones."""
    best = None
    for part in objects(text or ""):
        try:
            doc = json.loads(part)
        except ValueError:
            continue
        if isinstance(doc, dict):
            score = len(set(doc) & set(expected))
            if best is None or score >= best[0]:
                best = score, doc
    return best[1] if best else None


def _gate(g) -> dict | None:
    if not isinstance(g, Mapping):
        return None
    if g.get("absent") is True:
        return {"kind": "absent"}
    if isinstance(v := g.get("vertices"), list) and len(v) >= 3:
        try:
            return {"kind": "polygon", "vertices": [[float(a), float(b)] for a, b in v]}
        except (TypeError, ValueError):
            return None
    try:
        box = {k: float(g[k]) for k in ("x_min", "x_max", "y_min", "y_max")}
    except (KeyError, TypeError, ValueError):
        return None
    return {"kind": "rect", **box} if box["x_min"] < box["x_max"] and box["y_min"] < box["y_max"] else None


def gates_of(text: str | None, categories: Sequence[str]) -> list[dict]:
    """Gate rows of an answer: one for each rectangle, polygon or absent mark; a category
    without a valid gate gives a row of kind ``missing``."""
    doc = best_object(text, categories) or {}
    out = []
    for c in categories:
        many = doc.get(c)
        found = [g for g in map(_gate, many if isinstance(many, list) else [many]) if g]
        out += [{"category": c, "ord": i, **g} for i, g in enumerate(found)] or [{"category": c, "ord": 0, "kind": "missing"}]
    return out


def parse_gates(answers: DataFrame, text: str, categories: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row for each gate of each answer."""
    cats = list(categories)
    fields = [f.split()[0] for f in GATE.split(", ")]

    @F.pandas_udf(f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in GATE.split(', '))}>>")
    def gates(t: pd.Series) -> pd.Series:
        return t.map(lambda s: [{f: g.get(f) for f in fields} for g in gates_of(s, cats)])

    return answers.select(*keep, F.explode(gates(fenced(without_thinking(F.col(text))))).alias("g")).select(*keep, "g.*")


def parse_cells(answers: DataFrame, text: str, expected: str, keep: Sequence[str]) -> DataFrame:
    """(keep, id, annotation, rationale): the object that fits the expected ids best."""

    @F.pandas_udf("array<struct<id: string, annotation: string, rationale: string>>")
    def cells(t: pd.Series, ids: pd.Series) -> pd.Series:
        def one(s, want):
            doc = best_object(s, list(want)) or {}
            out = []
            for i in want:
                v = doc.get(i)
                v = v if isinstance(v, Mapping) else {"annotation": v}
                out.append({"id": i, "annotation": None if v.get("annotation") is None else str(v["annotation"]), "rationale": v.get("rationale")})
            return out

        return pd.Series([one(s, want) for s, want in zip(t, ids)])

    return answers.select(*keep, F.explode(cells(F.col(text), F.col(expected))).alias("c")).select(*keep, "c.*")


def parse_leaves(answers: DataFrame, text: str, vocabulary: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, cluster, leaves, n_invalid) of {cluster: {leaves: [...]}}: known leaves once, in order."""
    words = F.array(*(F.lit(v) for v in vocabulary))
    doc = F.from_json(fenced(F.col(text)), "map<string, struct<leaves: array<string>, rationale: string>>")
    rows = answers.select(*keep, F.explode(doc).alias("cluster", "v"))
    given = F.coalesce("v.leaves", F.array().cast("array<string>"))
    known = F.array_distinct(F.filter(given, lambda x: F.array_contains(words, x)))
    return rows.select(*keep, "cluster", known.alias("leaves"), (F.size(given) - F.size(F.filter(given, lambda x: F.array_contains(words, x)))).alias("n_invalid"))


def assemble(rows: DataFrame, group: Sequence[str], key: str, value: str) -> DataFrame:
    """Flat rows to one JSON object for each group, keys in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))
    return rows.groupBy(*group).agg(F.to_json(F.map_from_entries(entries)).alias("doc"))


def flatten(docs: DataFrame, group: Sequence[str], doc: str) -> DataFrame:
    return docs.select(*group, F.explode(F.from_json(F.col(doc), "map<string, string>")).alias("key", "value"))


def prompt_cells(text: Column) -> Column:
    """Cell numbers of a prompt's ``## cell_N`` headers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^## cell_(\d+)"), F.lit(1)), lambda v: v.cast("int"))


def propagation(parsed: DataFrame, group: Sequence[str]) -> DataFrame:
    """What a group's parsed gates (group, category, kind) come to: categories in all, with
    a gate, declared absent and lost, single gates, and the categories that have one."""
    drawn = F.col("kind").isin("rect", "polygon")
    of = lambda c: F.countDistinct(F.when(c, F.col("category")))
    by = parsed.groupBy(*group).agg(F.countDistinct("category").alias("n_total"), of(drawn).alias("n_valid"), of(F.col("kind") == "absent").alias("n_absent"), of(F.col("kind") == "missing").alias("n_lost"), F.count_if(drawn).alias("n_gates"), F.sort_array(F.collect_set(F.when(drawn, F.col("category")))).alias("categories"))
    return by.select(*group, "n_total", "n_valid", "n_absent", "n_lost", "n_gates", "categories")
