import os

import pytest
from oracle import engine, same_rows

import __spark_entry__ as entry
from spanloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same_rows(df, engine(SF).sql(ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "idx", "pos", "token", "score"]


def test_fuzzy_spans_move_forward(spark):
    found = QUERIES["align_fuzzy"](spark, SF).where("start_idx is not null").orderBy("doc_id", "idx").collect()
    for a, b in zip(found, found[1:], strict=False):
        assert a["doc_id"] != b["doc_id"] or a["end_idx"] < b["start_idx"]
