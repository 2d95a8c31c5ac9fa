import duckdb

from loamgrid.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_the_whole_vector_makes_the_round_trip(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE["q_quantize_roundtrip_whole"]).fetchall())
    got = sorted(map(tuple, QUERIES["q_quantize_roundtrip_whole"](spark, SF).select("vec_id", "q", "max_error").collect()))
    assert got == want and all(q.count(",") == 63 for _, q, _ in got)
