"""Small dimension tables: splits, channels, plans, registries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def splits(spark: SparkSession, doc: Mapping) -> DataFrame:
    """(grp, dataset, split, sample) of a nested split document; ``dev`` counts as val."""
    rows = [(g, d, "val" if s == "dev" else s, str(x)) for g, ds in doc.items() for d, by in ds.items() for s, xs in by.items() for x in xs]
    return spark.createDataFrame(rows, "grp string, dataset string, split string, sample string")


def allowed_samples(split: DataFrame, names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Samples of the given splits that aren't on the blacklist."""
    key = ["dataset", "sample"]
    return split.where(F.col("split").isin(*names)).select(*key).distinct().join(split.where("split = 'blacklist'").select(*key), key, "left_anti")
