"""Row-for-row comparison of a query with its SQL."""


def _cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.8g}"
    return str(v)


def same_rows(df, con, sql):
    got = df.toPandas()
    want = con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(tuple(_cell(v) for v in r) for r in d[columns].astype(object).where(d[columns].notna(), None).values.tolist())
    assert rows(got) == rows(want)
