"""The training-data queries that SQL can express against their SQL, on whole tables."""

import duckdb
import pytest

from geocairn.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = duck.execute(ORACLES[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in names]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_vector_sql_with_links(spark, tmp_path):
    """The vectors of the table with near copies in chains, equal ones, zero and null vectors and ones that hold nulls or no numbers."""
    duck = duckdb.connect()
    table = f"read_parquet('{SF}/embeddings.parquet')"
    near = "list_transform(embedding, lambda x, i: (x * (1 + vec_id % 3) + case when i = 1 then {0} * sqrt(list_dot_product(embedding, embedding)) else 0 end)::float)"
    odd = "values (5000, []::float[], 0), (5001, null, 0), (5002, [0, 0]::float[], 0), (5003, ['nan'::float, 1], 0), (5004, [null, 1]::float[], 0), (5005, ['inf'::float, 1], 0)"
    parts = " union all ".join(f"select vec_id + {1000 * (k + 1)}, {near.format(k * 0.35)}, label from {table} where vec_id % 10 = 0" for k in range(4))
    duck.execute(f"copy (select vec_id, embedding, label from {table} union all {parts} union all {odd}) to '{tmp_path}/embeddings.parquet' (format parquet)")
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    name = "op1_embedding_dedup"
    columns = ["vec_id", "n_links", "component_id", "kept"]
    want = sorted(tuple(r) for r in duck.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect())
    assert got == want and sum(n > 0 for _, n, _, _ in want) > 100 and any(not kept for *_, kept in want)
