"""The driver contract: entry() runs the flagship with a stable schema; every oracle key is a query."""

import __spark_entry__ as entry_module


def test_entry_flagship(spark):
    df = entry_module.entry(spark)
    assert df.schema.simpleString() == "struct<n_tokens:bigint,top1_pct:double,top5_pct:double,top10_pct:double>"
    assert [tuple(r) for r in df.collect()] == [(888, 5.968468, 23.423423, 47.072072)]


def test_contract_shapes():
    qs, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(qs)
    assert all(callable(f) for f in qs.values())
    assert all(isinstance(s, str) and s.strip() for s in sql.values())
    from carepath.plans.queries import QUERIES

    assert set(QUERIES) <= set(qs)  # whether or not the optional operators are there
