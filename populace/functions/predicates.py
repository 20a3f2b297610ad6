"""Parent predicates: a small text language over label columns, compiled to Columns.

``ALL`` is true. Parts are joined by ``&``; a part is ``column == value``,
``column != value`` or ``column in v1,v2``, tried in that order. Missing labels
(NULL or empty) differ from every value. A predicate that names a column the
table lacks is false; a part of another form sets no condition.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the label of rows without one
UNASSIGNED = "Unassigned"


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    values: tuple[str, ...]

    def compile(self, known: set[str]) -> Column:
        if self.column not in known:
            return F.lit(False)
        c = quoted(self.column)
        if self.op == "!=":
            return ~c.eqNullSafe(F.lit(self.values[0]))
        return F.coalesce(c.isin(*self.values), F.lit(False))


def parse(text: str) -> list[Condition]:
    if text.strip() == "ALL":
        return []
    out = []
    for part in text.split("&"):
        for op in ("==", "!=", " in "):
            if op in part:
                left, right = part.split(op, 1)
                values = [v.strip() for v in right.split(",")] if op == " in " else [right.strip()]
                out.append(Condition(left.strip(), op.strip(), tuple(values)))
                break
    return out


def compile_predicate(text: str, columns: Iterable[str]) -> Column:
    known = set(columns)
    out = F.lit(True)
    for c in parse(text):
        out = out & c.compile(known)
    return out


def breadcrumb(text: str) -> str:
    """``Root -> col(value) -> col(not value)``."""
    if text.strip() == "ALL":
        return "Root"
    shown = []
    for c in parse(text):
        value = ("not " if c.op == "!=" else "") + (",".join(c.values))
        shown.append(f"{c.column}({value})")
    return "Root -> " + " -> ".join(shown)


def normalized(label: Column | str, renames: dict[str, str] | None = None) -> Column:
    """Empty labels become NULL; ``renames`` maps category names."""
    c = quoted(label) if isinstance(label, str) else label
    c = F.nullif(c, F.lit(""))
    if renames:
        pairs = F.create_map(*(F.lit(x) for kv in renames.items() for x in kv))
        c = F.coalesce(F.element_at(pairs, c), c)
    return c


def reference_label(label: Column | str, columns: Iterable[str] | None = None) -> Column:
    """A row's label with missing ones as Unassigned; a column that isn't there gives Unassigned."""
    if isinstance(label, str) and columns is not None and label not in set(columns):
        return F.lit(UNASSIGNED)
    return F.coalesce(normalized(label), F.lit(UNASSIGNED))


def resolve_channel(name: str, columns: Sequence[str], channels: Sequence[tuple[str, str]]) -> str | None:
    """A physical column for a channel or marker name: the column itself, else the
    first channel of that marker. channels: (channel, marker) in metadata order."""
    if name in columns:
        return name
    return next((c for c, m in channels if m == name and c in columns), None)


#: The kinds that are used, in the order in which channels are listed.
KIND_TIERS = ("protein", "livedead", "scatter", "dna", "bead", "gaussian")


def channels_by_kind(channels: Sequence[tuple[str, str, str]], kinds: Sequence[str] = KIND_TIERS) -> list[str]:
    """Channel names of the given kinds, kind by kind, alphabetical inside one; other kinds are left out."""
    return [c for kind in kinds for c in sorted(c for c, _, k in channels if k == kind)]


def display_names(channels: Sequence[tuple[str, str]]) -> dict[str, str]:
    """channel -> marker, or the channel itself where several share the marker or it is empty."""
    count: dict[str, int] = {}
    for _, m in channels:
        count[m] = count.get(m, 0) + 1
    return {c: m if m and count[m] == 1 else c for c, m in channels}


def with_unassigned(categories: Column) -> Column:
    return F.array_union(categories, F.array(F.lit(UNASSIGNED)))


def modality(cofactor: Column, limit: float = 100.0, cohort: Column | None = None, cytof: Sequence[str] = ()) -> Column:
    """flow or cytof: by the list of cytof cohorts where one is given, else by the cofactor."""
    if cohort is not None and cytof:
        return F.when(cohort.isin(*cytof), "cytof").otherwise("flow")
    return F.when(cofactor >= limit, "flow").otherwise("cytof")


def gate_column(columns: Sequence[str], leaf: str, hint: str | None = None) -> str | None:
    """The gate column of a leaf: named so, or ending in ``__`` and the leaf's name. Of several
    the one that holds ``hint``, else the first."""
    found = [c for c in columns if c == leaf or c.endswith(f"__{leaf}")]
    return next((c for c in found if len(found) > 1 and hint and hint in c), found[0] if found else None)
