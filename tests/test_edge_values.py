"""Values that are rare in small tables and certain in large ones."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import oracle_sql, queries
from tablewright.functions import text

TIES = [0.1328125, -0.1171875, 0.0, -0.0, -1e-9, 1e-9, 5e-7, 1234565.0, 123456.5, 99999.95, 1e-42]


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    folder = tmp_path_factory.mktemp("edge")
    rows = [[TIES[(i + j) % len(TIES)] for j in range(64)] for i in range(20)]
    table = {"vec_id": pa.array(range(20), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * 20, pa.int32())}
    pq.write_table(pa.table(table), folder / "embeddings.parquet")
    return str(folder)


def both(spark, folder, name, column):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = {r["vec_id"]: r[column] for r in queries()[name](spark, folder).collect()}
    want = {row[0]: row[1] for row in con.execute(f"SELECT vec_id, {column} FROM ({oracle_sql()[name]})").fetchall()}
    return got, want


def test_zero_keeps_its_sign(spark, vectors):
    got, want = both(spark, vectors, "impute_array", "embedding")
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
    assert any("-0.0" in str(v) for v in want.values())


def test_numbers_as_c_writes_them(spark, vectors):
    got, want = both(spark, vectors, "serialize_sequence", "sequence")
    assert got == want
    values = [0.1234575, 0.1234565, 2.5, 1234565.0, -0.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text.general_format("v")).collect()] == [f"{v:.6g}" for v in values]
