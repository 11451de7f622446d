"""Every registered query equals its DuckDB restatement (sf0.001)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from rewrite_lake.plans.catalog import QUERIES
from rewrite_lake.plans.catalog_more import NO_SQL
from tools.oracle_compare import TABLES, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(set(QUERIES) - set(NO_SQL))


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test data absent")
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(NAMES) | set(NO_SQL) and set(NAMES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert rows_of(df.columns, s_rows) == rows_of(d_cols, res.fetchall())


@pytest.mark.parametrize("name", ["prepare_pairs", "prepare_audit", "sample_head", "split_exact", "dense_ids"])
def test_pairs_of_gapped_and_missing_turns_match_oracle(spark, tmpdir_path, name):
    path = os.path.join(tmpdir_path, "conversations.parquet")
    c = duckdb.connect()
    c.execute("create table conversations as select * from (values (1), (2), (null)) a(conv_id), "
              "(select unnest([0, 13, 4090, 4095, 4170, 4300, 9000, 50000, 50001, null])::bigint as turn) b")
    c.execute("alter table conversations add column role varchar default 'user'")
    c.execute("alter table conversations add column text varchar")
    c.execute("update conversations set text = 'conversation ' || coalesce(conv_id, -1) || ' turn ' || coalesce(turn, -1)")
    # several turns without a number: in the order of their texts, null last
    c.execute("insert into conversations select a.conv_id, null, 'user', b.text from (values (1), (2), (null)) a(conv_id), "
              "(select unnest(['banana split', 'bananas', 'apple pie', 'élan vital', 'zebra crossing', 'cherry', null, 'a', '', 'bananas']) as text) b")
    c.execute(f"copy (select conv_id::bigint as conv_id, turn, role, text from conversations) to '{path}' (format parquet)")
    df = E.queries()[name](spark, tmpdir_path)
    res = c.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(d_cols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_no_cartesian_or_nested_loop_plans(spark):
    from tools.plan_audit import FORBIDDEN, audit
    for name, info in audit(spark, SF).items():
        assert not any(info.get(f) for f in FORBIDDEN), name


def test_plan_audit_covers_every_registered_query(spark, monkeypatch):
    import tools.plan_audit as PA
    seen = []

    def query(name):
        return lambda s, d: (seen.append(name), s.range(1))[1]
    every = {n: query(n) for n in E.queries()}
    monkeypatch.setattr(E, "queries", lambda: every)
    assert set(PA.audit(spark, SF)) == set(every) == set(seen)
