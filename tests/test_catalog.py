import pytest

from populace import catalog
from populace.queries import base

from .oracle import same_rows

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    if name in SQL:
        same_rows(df, duck, SQL[name])
    else:
        # clouds need more rows than the smallest tables have
        assert df.count() > 0 or catalog.queries()[name](spark, sf.replace("0.001", "0.01")).count() > 0


def test_inventory_is_covered():
    ids = {i for v in base.OPERATORS.values() for i in v.split()}
    sizes = {"S": 17, "K": 9, "P": 17, "T": 15, "J": 16, "A": 29, "W": 13, "L": 7, "U": 6, "D": 15, "G": 7, "C": 7, "E": 5}
    assert not [f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1) if f"{k}{i}" not in ids]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
