"""Operators that SQL can express against DuckDB over the same tables."""

import duckdb
import pytest

from tests.conftest import SF


def rows_of(rows, names, columns):
    at = [names.index(c) for c in columns]
    return sorted((tuple(r[i] for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", ["op2_itq_hamming_tables", "op4_sampled_splitters", "op9_norm_bucket_topk", "op10_water_filling_mix",
                                  "op11_walsh_hadamard_clusters", "op12_transducer_divergence", "op13_line_hash_arrays"])
def test_query_equals_sql(spark, name):
    from precis.llm.oracle import OP4, ORACLE
    from precis.llm.queries import QUERIES
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute({**ORACLE, "op4_sampled_splitters": OP4}[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    columns = [c for c in names if c != "text_crc32"]
    assert rows_of([tuple(r) for r in df.collect()], df.columns, columns) == rows_of(cur.fetchall(), names, columns)
