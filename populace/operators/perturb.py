"""Perturbations: seeded deletion, ratio down-sampling, channel shift and scale.

Seeded choices order rows by md5 of ``seed:key`` and cut the order at an exact
count, so they are the same on every cluster and in any engine with md5. The cut
is found from counts by hash prefix (65,536 a category at most): only the rows of
the prefix that holds the cut are ranked, and no other row is moved.
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import quoted


def seeded_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def split_by_rank(df: DataFrame, category: Column, key: str, seed: int, ranks: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """(rows up to, rows beyond) the given rank of their category in seeded order; rows
    of other categories are in neither."""
    row = F.struct(*(quoted(c) for c in df.columns)).alias("row")
    d = df.select(row, category.alias("cat"), F.col(key).alias("key"), seeded_order(F.col(key), seed).alias("order"))
    d = d.where(F.col("cat").isin(*ranks)).withColumn("prefix", F.substring("order", 1, 4))
    found: dict[str, tuple[str, int]] = {}
    seen = dict.fromkeys(ranks, 0)
    for r in sorted(d.groupBy("cat", "prefix").count().collect()):
        if r["cat"] not in found and seen[r["cat"]] + r["count"] > ranks[r["cat"]]:
            found[r["cat"]] = r["prefix"], ranks[r["cat"]] - seen[r["cat"]]
        seen[r["cat"]] += r["count"]
    found |= {c: ("g", 0) for c in ranks if c not in found}  # beyond all hexadecimal prefixes
    at, left = (F.element_at(F.create_map(*(F.lit(x) for c, v in found.items() for x in (c, v[i]))), F.col("cat")) for i in (0, 1))
    w = Window.partitionBy("cat").orderBy("order", "key")
    edge = d.where(F.col("prefix") == at).withColumn("rank", F.row_number().over(w))
    low = d.where(F.col("prefix") < at).select("row.*").union(edge.where(F.col("rank") <= left).select("row.*"))
    high = d.where(F.col("prefix") > at).select("row.*").union(edge.where(F.col("rank") > left).select("row.*"))
    return low, high


class Perturbation:
    """A table-to-table transform with a description; usable with DataFrame.transform."""

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def parts(self) -> list[str]:
        raise NotImplementedError

    @property
    def slug(self) -> str:
        # fixed value: the characters that names of variants keep
        return re.sub(r"[^A-Za-z0-9._+-]", "_", "-".join(self.parts()))


def _percent(f: float) -> int:
    return int(round(f * 100))


@dataclass(frozen=True)
class Deplete(Perturbation):
    """Drop rows labelled with ``values``: all of them, or exactly round(n * fraction)
    (half to even) chosen by seed. NULL labels never match."""

    column: str
    values: tuple[str, ...]
    fraction: float = 1.0
    seed: int = 42
    key: str = "row_id"

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns or self.fraction <= 0:
            return df
        hit = F.coalesce(quoted(self.column).isin(*self.values), F.lit(False))
        if self.fraction >= 1:
            return df.where(~hit)
        n = df.where(hit).count()
        drop = round(n * self.fraction)
        if not drop:
            return df
        _, kept = split_by_rank(df.where(hit), F.lit("hit"), self.key, self.seed, {"hit": drop})
        return df.where(~hit).union(kept)

    def parts(self) -> list[str]:
        out = ["deplete", self.column, *self.values]
        if self.fraction != 1:
            out.append(f"frac{_percent(self.fraction)}")
        return out + [f"seed{self.seed}"] * (self.seed != 42)


@dataclass(frozen=True)
class RatioShift(Perturbation):
    """Down-sample categories to target ratios: the scale is the least count / weight
    of the categories present, and each keeps round(scale * weight) rows at most."""

    column: str
    ratios: Mapping[str, float]
    seed: int = 42
    key: str = "row_id"

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.column not in df.columns or not self.ratios:
            return df
        c = quoted(self.column)
        counts = {r[0]: r[1] for r in df.where(c.isin(*self.ratios)).groupBy(c).count().collect()}
        scales = [counts[k] / w for k, w in self.ratios.items() if w > 0 and counts.get(k)]
        if not scales:
            return df
        scale = min(scales)
        keep = {k: round(scale * w) for k, w in self.ratios.items() if round(scale * w) < counts.get(k, 0)}
        if not keep:
            return df
        kept, _ = split_by_rank(df, c, self.key, self.seed, keep)
        return df.where(~F.coalesce(c.isin(*keep), F.lit(False))).union(kept)

    def parts(self) -> list[str]:
        return ["ratio_shift", self.column, *(f"{k}{v}" for k, v in self.ratios.items())] + [f"seed{self.seed}"] * (self.seed != 42)


@dataclass(frozen=True)
class _Channels(Perturbation):
    amounts: Mapping[str, float]
    #: (channel, marker) pairs; a marker stands for all its channels.
    channels: Sequence[tuple[str, str]] = field(default=())

    def resolved(self, columns: Sequence[str]) -> dict[str, float]:
        out = {}
        for name, v in self.amounts.items():
            names = [c for c, m in self.channels if m == name and c in columns] or [name]
            out |= {c: v for c in names if c in columns}
        return out

    def change(self, c: Column, v: float) -> Column:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        amounts = self.resolved(df.columns)
        return df.select(*(self.change(quoted(c), amounts[c]).cast(df.schema[c].dataType).alias(c) if c in amounts else quoted(c) for c in df.columns))


@dataclass(frozen=True)
class ChannelShift(_Channels):
    """Adds a constant to channels, in the transformed space; unknown names do nothing."""

    def change(self, c, v):
        return c.cast("double") + F.lit(float(v))

    def parts(self):
        return ["channel_shift", *(f"{k}{v:+g}" for k, v in self.amounts.items())]


@dataclass(frozen=True)
class ChannelScale(_Channels):
    """Multiplies channels on the raw scale: asinh(sinh(x) * factor); factor 1 does nothing."""

    def change(self, c, v):
        return F.asinh(F.sinh(c.cast("double")) * F.lit(float(v))) if v != 1 else c

    def parts(self):
        return ["channel_scale", *(f"{k}x{v:g}" for k, v in self.amounts.items())]


@dataclass(frozen=True)
class Compose(Perturbation):
    steps: tuple[Perturbation, ...]

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(DataFrame.transform, self.steps, df)

    @property
    def slug(self) -> str:
        return "+".join(s.slug for s in self.steps)


def _assignments(tokens: Sequence[str], what: str) -> dict[str, str]:
    bad = [t for t in tokens if "=" not in t]
    if bad or not tokens:
        raise ValueError(f"{what}: name=value expected, got {bad or 'nothing'}")
    return dict(t.split("=", 1) for t in tokens)


def parse_spec(spec: str, key: str = "row_id", channels: Sequence[tuple[str, str]] = ()) -> Perturbation:
    """``deplete col value... [frac=F] [seed=N]``, ``ratio_shift col cat=w... [seed=N]``,
    ``channel_shift name=delta...`` or ``channel_scale name=factor...``, shell-quoted."""
    kind, *rest = shlex.split(spec) or [""]
    if kind == "deplete":
        column, *tokens = rest or [""]
        options = {t.split("=", 1)[0]: t.split("=", 1)[1] for t in tokens if t.startswith(("frac=", "seed="))}
        values = tuple(t for t in tokens if not t.startswith(("frac=", "seed=")))
        if not values:
            raise ValueError(f"deplete needs a column and a value: {spec!r}")
        return Deplete(column, values, float(options.get("frac", 1)), int(options.get("seed", 42)), key)
    if kind == "ratio_shift":
        column, *tokens = rest or [""]
        given = _assignments(tokens, kind)
        seed = int(given.pop("seed", 42))
        if not given:
            raise ValueError(f"ratio_shift needs a weight: {spec!r}")
        return RatioShift(column, {k: float(v) for k, v in given.items()}, seed, key)
    if kind in ("channel_shift", "channel_scale"):
        amounts = {k: float(v) for k, v in _assignments(rest, kind).items()}
        return (ChannelShift if kind == "channel_shift" else ChannelScale)(amounts, channels)
    raise ValueError(f"unknown perturbation: {spec!r}")


def parse_specs(specs: Sequence[str], name: str | None = None, **how) -> tuple[str | None, Perturbation | None]:
    """(name, perturbation) of specs applied from left to right; (None, None) of none."""
    if not specs:
        return None, None
    steps = tuple(parse_spec(s, **how) for s in specs)
    p = steps[0] if len(steps) == 1 else Compose(steps)
    return name or p.slug, p


# fixed value: the registry name that stands for every protein marker
ALL_PROTEINS = "__all_protein_markers__"


@dataclass(frozen=True)
class HardTask:
    """A registered robustness task: values to deplete, or calibrated channel factors."""

    hard_id: str
    scenario: str
    dataset: str
    step: int
    step_column: str
    deplete: tuple[str, ...] = ()
    scales: tuple[tuple[str, float], ...] = ()

    def at(self, magnitude: float = 1.0, seed: int = 42, channels: Sequence[tuple[str, str, str]] = (), key: str = "row_id") -> tuple[str, Perturbation]:
        """(slug, perturbation) at a magnitude: a depleted fraction, or the share of
        the way from factor 1 to the calibrated factor."""
        if self.deplete:
            tail = "" if magnitude == 1 else f"_frac{_percent(magnitude)}"
            return self.hard_id + tail, Deplete(self.step_column, self.deplete, magnitude, seed, key)
        amounts: dict[str, float] = {}
        for name, factor in self.scales:
            effective = 1 + (factor - 1) * magnitude
            proteins = [m for _, m, k in channels if k == "protein"] if name == ALL_PROTEINS and channels else [name]
            amounts |= dict.fromkeys(proteins, effective)
        tail = "" if magnitude == 1 else f"_scale{_percent(magnitude)}"
        return self.hard_id + tail, ChannelScale(amounts, [(c, m) for c, m, _ in channels])


def registry(tasks: Sequence[HardTask], scenarios: Sequence[str]) -> dict[str, HardTask]:
    """Tasks by id; duplicate ids and unknown scenarios are errors."""
    out: dict[str, HardTask] = {}
    for t in tasks:
        if t.hard_id in out:
            raise ValueError(f"duplicate task {t.hard_id}")
        if t.scenario not in scenarios:
            raise ValueError(f"unknown scenario {t.scenario} of {t.hard_id}")
        out[t.hard_id] = t
    return out


def task_perturbation(hard_id: str | None, specs: Sequence[str], tasks: Mapping[str, HardTask], **how) -> tuple[str | None, Perturbation | None]:
    """One of a registered task or inline specs; both together are an error."""
    if hard_id and specs:
        raise ValueError("a registered task and inline perturbations exclude each other")
    return tasks[hard_id].at(**how) if hard_id else parse_specs(specs)


def sample_exact(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """n rows without replacement, by seeded order (a top-n: each task keeps n rows)."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def sample_exact_by(df: DataFrame, group: Sequence[str], n: int, seed: int, key: str = "row_id") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(seeded_order(F.col(key), seed), key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a deviation under 1e-6 counts as 1."""
    r = df.agg(*(f(quoted(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (r[f"m{i}"] or 0.0, r[f"s{i}"] if (r[f"s{i}"] or 0) >= 1e-6 else 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.select(*((quoted(c) - fitted[c][0]) / fitted[c][1] if c in fitted else quoted(c) for c in df.columns)).toDF(*df.columns)


def clip_scale(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, top: float = 10.0) -> DataFrame:
    """Clip to exact quantiles and scale to 0..top."""
    from .windows import quantiles

    row = quantiles(df.withColumn("_all", F.lit(1)), ["_all"], column, (low, high)).first()
    a, b = row["q"] if row else (0.0, 0.0)
    span = (b - a) or 1.0
    c = F.greatest(F.lit(a), F.least(F.lit(b), quoted(column).cast("double")))
    return df.withColumn(column, (c - a) / span * top)


#: Fixed value: the kinds of channels that are clipped and scaled; the others are transformed.
SCALED_KINDS = ("scatter", "tech")


def ingest(df: DataFrame, kinds: Mapping[str, str], cofactor: float, low: float = 0.01, high: float = 0.99, top: float = 10.0) -> DataFrame:
    """``df`` with its channels as they are stored: scatter and tech channels clipped to
    their 1st and 99th percentiles and scaled to 0..top (0 where those are equal), all others
    asinh(x / cofactor). kinds: channel -> kind."""
    from .windows import quantiles

    new = {}
    for c, kind in kinds.items():
        if kind in SCALED_KINDS:
            row = quantiles(df.withColumn("_all", F.lit(1)), ["_all"], c, (low, high)).first()
            a, b = row["q"] if row else (0.0, 0.0)
            new[c] = (F.least(F.greatest(quoted(c), F.lit(a)), F.lit(b)) - a) / (b - a) * top if b > a else F.when(quoted(c).isNotNull(), 0.0)
        else:
            new[c] = F.asinh(quoted(c) / cofactor)
    return df.withColumns(new)


def replace_names(text: Column, names: Mapping[str, str], protected: Sequence[str] = ()) -> Column:
    """Replace names by stand-ins, longest first; protected names stay as they are."""
    held = [(p, f"\x00{i}\x00") for i, p in enumerate(sorted(protected, key=len, reverse=True))]
    swaps = [*held, *sorted(names.items(), key=lambda kv: (-len(kv[0]), kv[0])), *((b, a) for a, b in held)]
    for a, b in swaps:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def label_codes(label: Column, categories: Sequence[str]) -> Column:
    """Position of the label in categories, that of Unassigned (appended if absent) by default."""
    names = list(dict.fromkeys([*categories, "Unassigned"]))
    codes = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))))
    return F.coalesce(F.element_at(codes, label), F.lit(names.index("Unassigned")))
