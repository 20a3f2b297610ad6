"""The map of a joint distribution, by hand."""

from pyspark.sql import functions as F

from populace.functions import jointmap as J

SCHEMA = "g string, n long, x_min double, x_max double, y_min double, y_max double, x_data_max double, y_data_max double, peaks array<struct<xb:int,yb:int,x:double,y:double,share:double>>, valleys array<struct<xb:int,yb:int,x:double,y:double,left:int,right:int>>"


def text(spark, bins, row, nx=8, ny=3):
    b = spark.createDataFrame(bins, "g string, xb int, yb int, n long")
    rows = J.count_arrays(b, ["g"], nx, ny).drop("n").join(spark.createDataFrame([row], SCHEMA), "g", "right")
    return rows.select(J.joint_map(rows, nx, ny, "CD3", "CD4").alias("t")).first()["t"].split("\n")


def test_a_map_with_all_marks(spark):
    bins = [("a", 0, 0, 1), ("a", 1, 0, 3), ("a", 5, 2, 1200), ("a", 7, 1, 7)]
    peaks, valleys = [(5, 2, 5.5, 2.5, 0.99), (1, 0, 1.5, 0.5, 0.005)], [(4, 1, 4.5, 1.5, 0, 1)]
    got = text(spark, bins, ("a", 1211, 0.0, 8.0, 0.0, 3.0, 5.2, 2.9, peaks, valleys))
    assert got == [
        "[Joint distribution: CD3 (x) × CD4 (y)]   n=1,211",
        "data:  x ∈ [0.00, 5.20]   y ∈ [0.00, 2.90]",
        "scale: x ∈ [0.00, 8.00]   y ∈ [0.00, 3.00]",
        "density (' '=empty, 1..9 = log-quantile)   Mx=data x_max, My=data y_max",
        "",
        "      CD4",
        " 3.00/P1/My │     9  ",
        "    V1 │       7",
        " 0.00/P2 │14      ",
        "      └────────",
        "       0.008.00",
        "        P2 V1  ",
        "            Mx ",
        "            P1 ",
        "                 CD3",
        "P1: x=5.50, y=2.50, frac=0.99",
        "P2: x=1.50, y=0.50, frac=0.01",
        "V1: x=4.50, y=1.50 (between P1↔P2)",
    ]


def test_shades_are_quantiles_of_logs(spark):
    import numpy as np

    counts = np.random.default_rng(0).integers(0, 50, (6, 5))
    logs = np.log1p(counts[counts > 0])
    cuts = np.quantile(logs, np.arange(1, 9) / 9)
    want = [["" if not n else str(min(9, 1 + int((cuts <= np.log1p(n)).sum()))) for n in c] for c in counts]
    df = spark.createDataFrame([([[int(n) for n in c] for c in counts],)], "counts array<array<bigint>>")
    got = df.select(F.transform("counts", lambda c: F.transform(c, lambda n: F.trim(J.shade(n, J.shade_cuts(F.col("counts")))))).alias("s")).first()["s"]
    assert [list(r) for r in got] == want


def test_marks_stack_and_end_at_the_edge(spark):
    df = spark.createDataFrame([([(0, "P1"), (1, "V1"), (0, "P2"), (7, "P10"), (3, "x")],), ([],)], "m array<struct<at:int,name:string>>")
    got = [list(r["r"]) for r in df.select(J.stacked_rows(F.col("m"), 8).alias("r")).collect()]
    assert got == [["P1 x   P", "P2      ", " V1     "], []]


def test_nothing_and_one_bin(spark):
    assert text(spark, [("a", 0, 0, 1)], ("b", None, None, None, None, None, None, None, [], []))[1:] == [J.OMITTED]
    got = text(spark, [("a", 2, 1, 5)], ("a", 5, 1.0, 2.0, 1.0, 2.0, 2.0, 2.0, [], []))
    assert got[7] == "      │  9     " and got[3].endswith("quantile)") and got[-2:] == ["peaks: none", "valleys: none"]


def test_share_of_the_bins_around(spark):
    bins = spark.createDataFrame([("a", x, y, x + 10 * y) for x in range(8) for y in range(4)] + [("b", 0, 0, 4)], "g string, xb int, yb int, n long")
    points = spark.createDataFrame([("a", 0, 0, "p"), ("a", 4, 2, "q"), ("b", 0, 0, "r"), ("c", 1, 1, "s"), ("b", 9, 9, "t")], "g string, xb int, yb int, name string")
    total = sum(x + 10 * y for x in range(8) for y in range(4))
    near = lambda a, b: sum(x + 10 * y for x in range(8) for y in range(4) if abs(x - a) < 3 and abs(y - b) < 3) / total
    got = {r["name"]: r["share"] for r in J.near_shares(bins, ["g"], points).collect()}
    assert got == {"p": near(0, 0), "q": near(4, 2), "r": 1.0, "s": 0.0, "t": 0.0}
