"""Quality rules at host level (DataFrame functions only).

A document fails the base rules when it has under 50 words, or when more than
half of its words lie in 3-word windows that the text holds twice or more.
Failures are then counted by host; the failure rate of a host is shrunk towards
a beta prior fitted to all hosts by the method of moments; a host whose shrunk
rate reaches ``host_limit`` (of which more documents are expected to fail than to
pass) loses its other documents too. A host of few documents is judged by the prior,
so one bad page doesn't condemn it.

Nulls: a null text has no words (it fails); null hosts form one host; a null id is an id
as any other. Repeated rows are judged one by one; an empty table gives an empty result.
Extra columns are ignored. A long text is judged whole, in the memory of a few times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Shrunk failure rate from which a host is rejected.
HOST_LIMIT = 0.5
#: The prior's weight in documents: bounds for the moment estimate.
PRIOR_MIN, PRIOR_MAX = 2.0, 1000.0


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A text's windows are sorted as strings; equal neighbours are repeats.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", F.array_remove(F.split(t, SPACE), ""))
    d = d.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn(
        "_g",
        F.when(F.size("_w") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))),
    )
    same = lambda k, x: F.coalesce(F.get("_g", k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_h", F.sort_array(F.transform(F.filter("_g", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"])))
    gaps = F.aggregate(
        F.col("_h"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("p")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["p"])).alias("n"), i.alias("p")),
        lambda s: s["n"],
    )
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("n_repeat_words", F.coalesce(gaps, F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.drop("_w", "_l", "_g", "_h")


def host_verdicts(metrics: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each host: _host, n, failed, host_rate (shrunk), host_rejected.

    Method of moments over hosts, each weighted by its documents: mean m, and
    variance v beyond that of binomial draws; weight s = m(1-m)/v - 1, held
    between PRIOR_MIN and PRIOR_MAX (PRIOR_MAX where hosts don't differ).
    """
    by = metrics.groupBy(F.col(host).alias("_host")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("base_failed").cast("int")).cast("double").alias("failed"))
    by = by.withColumn("p", F.col("failed") / F.col("n"))
    m, total, k, npp = by.agg(F.sum("failed") / F.sum("n"), F.sum("n"), F.count("*"), F.sum(F.col("n") * F.col("p") * F.col("p"))).first()
    if not k:
        m = s = 0.0
    else:
        v = npp / total - m * m - m * (1 - m) * k / total
        s = max(PRIOR_MIN, min(PRIOR_MAX, m * (1 - m) / v - 1)) if v > 0 else PRIOR_MAX
    m, s = F.lit(m), F.lit(s)
    rate = (F.col("failed") + m * s) / (F.col("n") + s)
    return by.select("_host", "n", "failed", rate.alias("host_rate"), (rate >= host_limit).alias("host_rejected"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None, host_limit: float = HOST_LIMIT) -> DataFrame:
    """_doc (a struct of the ``keep`` columns, all by default), the metrics, host_rate and kept."""
    held = F.struct(*(F.col(c) for c in (keep or docs.columns)))
    m = docs.select(held.alias("_doc"), F.col(host).alias("_of"), F.col(text).alias("_t"))
    m = save(base_metrics(m, "_t").select("_doc", "_of", *METRICS, "base_failed"), "quality")
    v = host_verdicts(m, "_of", host_limit).select("_host", "host_rate", "host_rejected")
    out = m.join(v, F.col("_of").eqNullSafe(F.col("_host")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).select("_doc", *METRICS, "base_failed", "host_rate", "kept")


def judge(docs: DataFrame, keep: list[str], **how) -> DataFrame:
    """``keep`` columns (those not named as a result), the metrics, host_rate and kept."""
    results = [*METRICS, "base_failed", "host_rate", "kept"]
    return judged(docs, keep=keep, **how).select(*(F.col("_doc")[c].alias(c) for c in keep if c not in results), *results)


def passing(docs: DataFrame, **how) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judged(docs, **how).where("kept").select("_doc.*")


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
