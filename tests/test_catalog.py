"""Every query gives the rows of its SQL."""

import duckdb
import pytest

from leafmill import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows(spark, duck, name):
    mine = catalog.QUERIES[name](spark, DIR).toPandas()
    if name not in catalog.ORACLE:  # compared with a sequential model in test_engine.py
        assert len(mine) and len(mine.columns)
        return
    theirs = duck.sql(catalog.ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    rows = lambda df: sorted(str([None if x is None or x != x else x for x in map(lambda v: v.item() if hasattr(v, "item") else v, r)]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(mine) == rows(theirs)


def test_slide_titles_are_whole(spark):
    from leafmill.operators import documents

    title = "word " * 400 + "end"
    rows = documents.split_slides(spark.createDataFrame([(1, f"# {title}\n\ntext")], "document_id long, md string")).collect()
    assert [r.title for r in rows] == [title]
