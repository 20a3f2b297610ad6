"""Model scoring, joint maps and rescued valleys."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import jointmap as J
from ..operators import density as D
from ..operators import model as N
from ..operators import perturb as T
from ..plans.flagship import shared_folder
from ..sources import tasks as K
from ..operators import valleys as V
from .base import ev, query, table

WIDTH, DIM = 12, 64
STEPS = {"one": ["a", "b", "c"], "two": ["x", "y"]}


def fixed_model():
    """Weights by a rule that SQL can follow: whole numbers over 16."""
    i, j = np.arange(WIDTH)[:, None], np.arange(DIM)
    out = {"layer0.weight": ((i * 31 + j * 17) % 13 - 6) / 16, "layer0.bias": (np.arange(WIDTH) % 5 - 2) / 16}
    for k, (step, names) in enumerate(STEPS.items()):
        c, h = np.arange(len(names))[:, None], np.arange(WIDTH)
        out |= {f"head.{step}.weight": ((c * 7 + h * 5 + 3 * k) % 11 - 5) / 16, f"head.{step}.bias": (np.arange(len(names)) % 3 - 1) / 16}
    return out


_HEADS = " UNION ALL ".join(
    f"SELECT vec_id, '{step}' AS step, {c} AS c, '{name}' AS label, list_sum(list_transform(range(0, {WIDTH}), lambda i: h[i + 1] * (({c} * 7 + i * 5 + {3 * k}) % 11 - 5) / 16.0)) + ({c} % 3 - 1) / 16.0 AS z FROM hid"
    for k, (step, names) in enumerate(STEPS.items()) for c, name in enumerate(names)
)


@query("D15 A22", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), hid AS (
  SELECT vec_id, list_transform(range(0, {WIDTH}), lambda i: greatest(list_sum(list_transform(range(0, {DIM}), lambda j: v[j + 1] * ((i * 31 + j * 17) % 13 - 6) / 16.0)) + (i % 5 - 2) / 16.0, 0)) AS h FROM e
), z AS ({_HEADS}), m AS (SELECT vec_id, step, max(z) AS top FROM z GROUP BY ALL),
p AS (SELECT z.vec_id, step, c, label, exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY z.vec_id, step) AS p FROM z JOIN m USING (vec_id, step))
SELECT vec_id, step, arg_max(label, (round(p, 7), -c)) AS label, round(max(p), 5) AS probability FROM p GROUP BY ALL""")
def model_scores(spark, sf):
    """A model kept as a table scores every vector for two steps in one scan."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    N.save_model(spark, fixed_model(), path)
    out = N.score(table(spark, sf, "embeddings"), "vec_id", "embedding", N.load_model(spark, path), STEPS)
    return out.select(F.col("key").alias("vec_id"), "step", "label", F.round("probability", 5).alias("probability"))


def _density_sql(name, source, key):
    """SQL of densities and valleys of bins (key..., bin, n): ``<name>_d`` and ``<name>_v``."""
    on = " AND ".join(f"a.{k} = m.{k}" for k in key.split(", "))
    both = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    a_key = ", ".join(f"a.{k}" for k in key.split(", "))
    return f"""{name}_m AS (
  SELECT {key}, sum(n)::DOUBLE AS cnt, (sum(n * bin * bin) - sum(n * bin)::DOUBLE * sum(n * bin) / sum(n)) / (sum(n) - 1) AS v FROM {source} GROUP BY ALL HAVING sum(n) >= 2
), {name}_d AS (
  SELECT {a_key}, a.bin, round(sum(b.n * exp(-0.5 * power((a.bin - b.bin) / greatest(sqrt(v) * power(4 / (3 * cnt), 0.2), 0.5), 2)) ORDER BY b.bin) / (cnt * greatest(sqrt(v) * power(4 / (3 * cnt), 0.2), 0.5) * sqrt(2 * pi())), 10) AS d
  FROM {source} a JOIN {source} b ON {both} JOIN {name}_m m ON {on} WHERE v > 1e-9 GROUP BY {a_key}, a.bin, cnt, v
), {name}_r AS (
  SELECT *, sign(d - lag(d) OVER (PARTITION BY {key} ORDER BY bin)) AS rise FROM {name}_d
), {name}_p AS (
  SELECT *, coalesce(rise > 0 AND first_value(nullif(rise, 0) IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < 0, false) AND d >= 0.1 * max(d) OVER (PARTITION BY {key}) AS pk FROM {name}_r
), {name}_g AS (
  SELECT *, sum(pk::INT) OVER (PARTITION BY {key} ORDER BY bin) AS gap FROM {name}_p
), {name}_v AS (
  SELECT {key}, arg_min(bin, (d, bin)) AS bin FROM (SELECT *, max(gap) OVER (PARTITION BY {key}) AS last FROM {name}_g) WHERE gap > 0 AND gap < last AND NOT pk GROUP BY {key}, gap
)"""


def _depth_sql(name, cuts):
    return f"""{name} AS (
  SELECT c.g, c.bin, round(least(coalesce(max(d) FILTER (t.bin < c.bin AND (lo IS NULL OR t.bin > lo)), 0), coalesce(max(d) FILTER (t.bin > c.bin AND (hi IS NULL OR t.bin < hi)), 0)) - max(d) FILTER (t.bin = c.bin), 10) AS depth
  FROM {cuts} c JOIN one_d t ON c.g = t.g GROUP BY c.g, c.bin, lo, hi
)"""


@query("W8 D12 S17", f"""WITH counted AS (
  SELECT user_id % 12 AS g, least(floor(x * 8), 47)::INT AS bin, count(*) AS n FROM ev GROUP BY ALL
), hist AS (
  SELECT g, bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT g FROM counted) CROSS JOIN (SELECT unnest(range(48))::INT AS bin) LEFT JOIN counted USING (g, bin)
), {_density_sql("one", "hist", "g")}, listed AS (
  SELECT g, bin, lag(bin) OVER w AS lo, lead(bin) OVER w AS hi FROM one_v WINDOW w AS (PARTITION BY g ORDER BY bin)
), {_depth_sql("deep", "listed")}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY depth DESC, bin) AS place, count(*) OVER (PARTITION BY g) AS m FROM deep
), lone AS (SELECT g, bin AS cut FROM ranked WHERE m = 1), halves AS (
  SELECT g, CASE WHEN bin < cut THEN 0 ELSE 1 END AS side, bin, n FROM hist JOIN lone USING (g) WHERE bin <> cut
), {_density_sql("two", "halves", "g, side")}, tried AS (
  SELECT g, bin, CASE side WHEN 1 THEN cut END AS lo, CASE side WHEN 0 THEN cut END AS hi FROM two_v JOIN lone USING (g)
), {_depth_sql("more", "tried")}, best AS (
  SELECT g, arg_min(bin, (-depth, bin)) AS more FROM more WHERE depth > 0 GROUP BY g
), median AS (
  SELECT g, min(bin) AS median FROM (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY bin) AS c, sum(n) OVER (PARTITION BY g) AS t FROM hist) WHERE 2 * c >= t GROUP BY g
), top AS (SELECT g, any_value(m) AS m, list(bin ORDER BY bin) FILTER (place <= 2) AS cuts FROM ranked GROUP BY g)
SELECT g, array_to_string(CASE WHEN m IS NULL THEN [median] WHEN m = 1 AND more IS NOT NULL THEN list_sort(list_append(cuts, more)) ELSE cuts END, ' ') AS cuts,
  CASE WHEN m IS NULL THEN 'median' WHEN m > 2 THEN 'top_depth' WHEN m = 2 THEN 'all' WHEN more IS NOT NULL THEN 'split_rescue' ELSE 'middle_dropped' END AS status
FROM median LEFT JOIN top USING (g) LEFT JOIN best USING (g)""")
def rescued_valleys(spark, sf):
    """Two cuts for each of twelve groups, from densities of 48 bins."""
    n = ev(spark, sf).groupBy((F.col("user_id") % 12).alias("g"), F.least(F.floor(F.col("x") * 8), F.lit(47)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = n.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("bin"))
    hist = every.join(n, ["g", "bin"], "left").fillna(0, ["n"])
    out = V.rescued_cuts(hist, ["g"], 2)
    return out.select("g", F.array_join(F.transform("cuts", lambda c: c.cast("string")), " ").alias("cuts"), "status")


NX, NY = 24, 12


@query("D4 D6 R5", f"""WITH b AS (
  SELECT event_type AS g, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ev GROUP BY 1
), h AS (
  SELECT g, least(floor((x - x0) / (x1 - x0) * {NX}), {NX - 1})::INT AS xb, least(floor((y - y0) / (y1 - y0) * {NY}), {NY - 1})::INT AS yb, count(*) AS n FROM ev JOIN b ON g = event_type GROUP BY ALL
), q AS (
  SELECT g, quantile_cont(ln(1 + n), [1/9.0, 2/9.0, 3/9.0, 4/9.0, 5/9.0, 6/9.0, 7/9.0, 8/9.0]) AS q FROM h GROUP BY 1
), s AS (
  SELECT h.*, least(1 + len(list_filter(q, lambda c: c <= ln(1 + n))), 9)::VARCHAR AS shade FROM h JOIN q USING (g)
), pk AS (
  SELECT g, arg_min(xb, (-n, xb, yb)) AS px, arg_min(yb, (-n, xb, yb)) AS py FROM h GROUP BY 1
), near AS (
  SELECT pk.g, px, py, sum(n) FILTER (abs(xb - px) <= 2 AND abs(yb - py) <= 2) / sum(n) AS share FROM pk JOIN h USING (g) GROUP BY ALL
), base AS (
  SELECT b.*, px, py, share, printf('%.2f', x0) AS sx0, printf('%.2f', x1) AS sx1, printf('%.2f', y0) AS sy0, printf('%.2f', y1) AS sy1,
         greatest(4, length(printf('%.2f', y0)), length(printf('%.2f', y1))) AS w FROM b JOIN near USING (g)
), cell AS (
  SELECT g, yb, string_agg(coalesce(shade, ' '), '' ORDER BY xb) AS line FROM (SELECT g FROM b) CROSS JOIN (SELECT unnest(range({NX}))::INT AS xb) CROSS JOIN (SELECT unnest(range({NY}))::INT AS yb) LEFT JOIN s USING (g, xb, yb) GROUP BY ALL
), lab AS (
  SELECT g, yb, line, w, concat_ws('/', CASE yb WHEN {NY - 1} THEN sy1 WHEN 0 THEN sy0 END, CASE WHEN yb = py THEN 'P1' END) AS l FROM cell JOIN base USING (g)
), lines AS (
  SELECT g, 0 AS k, '[Joint distribution: x (x) × y (y)]   n=' || format('{{:,}}', n) AS t FROM base
  UNION ALL SELECT g, 1, 'data:  x ∈ [' || sx0 || ', ' || sx1 || ']   y ∈ [' || sy0 || ', ' || sy1 || ']' FROM base
  UNION ALL SELECT g, 2, 'scale: x ∈ [' || sx0 || ', ' || sx1 || ']   y ∈ [' || sy0 || ', ' || sy1 || ']' FROM base
  UNION ALL SELECT g, 3, 'density ('' ''=empty, 1..9 = log-quantile)' FROM base UNION ALL SELECT g, 4, '' FROM base
  UNION ALL SELECT g, 5, repeat(' ', (w + 1)::INT) || 'y' FROM base
  UNION ALL SELECT g, 6 + {NY - 1} - yb, ' ' || repeat(' ', greatest(0, w - length(l))::INT) || l || ' │' || line FROM lab
  UNION ALL SELECT g, {6 + NY}, repeat(' ', (w + 1)::INT) || '└' || repeat('─', {NX}) FROM base
  UNION ALL SELECT g, {7 + NY}, repeat(' ', (w + 2)::INT) || substr(rpad(sx0, {NX}, ' '), 1, {NX} - length(sx1)) || sx1 FROM base
  UNION ALL SELECT g, {8 + NY}, repeat(' ', (w + 2)::INT) || substr(repeat(' ', px) || 'P1' || repeat(' ', {NX}), 1, {NX}) FROM base
  UNION ALL SELECT g, {9 + NY}, repeat(' ', (w + 2 + {NX} + 2)::INT) || 'x' FROM base
  UNION ALL SELECT g, {10 + NY}, 'P1: x=' || printf('%.2f', x0 + (px + 0.5) * (x1 - x0) / {NX}) || ', y=' || printf('%.2f', y0 + (py + 0.5) * (y1 - y0) / {NY}) || ', frac=' || printf('%.2f', share) FROM base
  UNION ALL SELECT g, {11 + NY}, 'valleys: none' FROM base
)
SELECT g AS event_type, string_agg(t, chr(10) ORDER BY k) AS text FROM lines GROUP BY 1""")
def joint_maps(spark, sf):
    """The map of each event type, its fullest bin marked, with the share of the 5 x 5 bins around it."""
    g, e = ["event_type"], ev(spark, sf)
    bins = D.histogram_2d(e, g, "x", "y", NX, NY)
    full = bins.groupBy(*g).agg(F.min_by(F.struct("xb", "yb"), F.struct(-F.col("n"), "xb", "yb")).alias("b")).select(*g, "b.*")
    box = e.groupBy(*g).agg(*(f(c).alias(f"{c}_{k}") for c in "xy" for k, f in (("min", F.min), ("max", F.max))))
    at = lambda c, b, k: F.col(f"{c}_min") + (F.col(b) + 0.5) * (F.col(f"{c}_max") - F.col(f"{c}_min")) / k
    peaks = J.near_shares(bins, g, full).join(box, g).select(*g, "x_min", "x_max", "y_min", "y_max", F.array(F.struct("xb", "yb", at("x", "xb", NX).alias("x"), at("y", "yb", NY).alias("y"), "share")).alias("peaks"))
    none = F.array().cast("array<struct<xb:int,yb:int,x:double,y:double,left:int,right:int>>")
    rows = J.count_arrays(bins, g, NX, NY).join(peaks, g).withColumns({"valleys": none, "x_data_max": F.col("x_max"), "y_data_max": F.col("y_max")})
    return rows.select("event_type", J.joint_map(rows, NX, NY, "x", "y").alias("text"))


@query("K4 S15 T11", """WITH c AS (SELECT event_type AS sample, asinh(value / 5) AS v, (user_id % 100)::DOUBLE AS u FROM ev),
q AS (SELECT quantile_cont(u, 0.01) AS a, quantile_cont(u, 0.99) AS b FROM c)
SELECT sample, count(*) AS n, round(avg(v), 3) AS mean_v, round(avg((least(greatest(u, a), b) - a) / (b - a) * 10), 3) AS mean_u FROM c, q GROUP BY 1""")
def cohort_zstd(spark, sf):
    """Events as a cohort: channels transformed by kind, stored as floats under zstd, read back."""
    path = f"{shared_folder(spark)}/cohort-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select(F.col("event_type").alias("sample"), F.col("value").alias("v"), F.pmod("user_id", F.lit(100)).cast("double").alias("u"))
    meta = {"cohort": "events", "cofactor": 5, "channels": {"v": ["value", "protein"], "u": ["user", "scatter"]}}
    K.write_parquet_cohort(T.ingest(e, {c: k for c, (_, k) in meta["channels"].items()}, meta["cofactor"]), "sample", path, meta)
    out = K.read_parquet_cohort(spark, path)
    return out.groupBy("sample").agg(F.count("*").alias("n"), F.round(F.avg("v"), 3).alias("mean_v"), F.round(F.avg("u"), 3).alias("mean_u"))
