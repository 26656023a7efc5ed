"""Queries on tables larger than sf0.01 against their SQL in DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL, sorted, over ``tables``, which are written into ``folder``."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.table(rows), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_sequence_digest_of_more_than_two_full_levels(spark, tmp_path):
    got, want = both(spark, tmp_path, "sequence_digest", part={"p_partkey": pa.array(range(1, 5001), pa.int64())})
    assert got == want and got[0][0] == 5000


def test_manifest_overlaps_of_coordinates_that_round_alike_whatever_the_keys(spark, tmp_path):
    n = 30_000
    documents = {"doc_id": pa.array(range(600), pa.int64()), "lang": [("en", "de", "fr")[i % 7 % 3] for i in range(600)]}
    got, want = both(spark, tmp_path, "manifest_overlaps", documents=documents, customer={"c_custkey": pa.array(range(n), pa.int64())})
    assert got == want and sum(kind == "coordinate" for kind, *_ in got) == 105
