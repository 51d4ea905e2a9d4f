"""Every registered query of the reference's operators against its oracle SQL."""

import datetime
import math

import duckdb
import pytest

from quirework.plans import catalog

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    assert rows
    if name not in catalog.ORACLE_SQL:
        return
    result = oracle.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted([tuple(plain(r[i]) for i in at) for r in result.fetchall()], key=repr)


@pytest.mark.parametrize("name", ["lookup_tiered", "carry_forward", "upsert_guarded", "section_state_machine"])
def test_partitions_do_not_matter(spark, name):
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
