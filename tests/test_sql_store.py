import duckdb
import pytest
from pyspark.sql import functions as F

from chainloom.catalog_queries import metric
from chainloom.functions.abi import parse_signature
from chainloom.operators.store import bulk_load, create_table_sql, delete_blocks_sql, index_sql
from chainloom.schema import DATASETS, event_table

TRANSFER = event_table("p", "Token", parse_signature("Transfer(address indexed from, address indexed to, uint256 value, uint64[] ids)"), indexes=(("chain", "from"),))


@pytest.fixture
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    return con


def rows(spark, *found):
    df = spark.createDataFrame(list(found), "height bigint, block string, log bigint, value string, seq bigint")
    return df.select(
        F.lit("0xa").alias("address"), F.lit("0xt").alias("transaction_hash"), F.lit(0).alias("transaction_index"), F.col("log").alias("log_index"), F.lit("0x1").alias("from"), F.lit("0x2").alias("to"),
        "value", F.array(F.lit(str(2**64 - 1)).cast("decimal(20,0)")).alias("ids"), F.col("height").alias("block_number"), F.col("block").alias("block_hash"), F.timestamp_seconds("height").alias("block_timestamp"),
        F.lit("c").alias("chain"), F.concat_ws(":", "block", "log").alias("dedupe_key"), "seq",
    )


@pytest.mark.parametrize("name", [*sorted(DATASETS), *sorted(metric().tables())])
def test_a_database_takes_every_table_and_index(duck, name):
    t = (DATASETS | metric().tables())[name]
    for _ in range(2):  # doing it again changes nothing
        duck.execute(create_table_sql(t))
        for statement in index_sql(t):
            duck.execute(statement)
    assert [r[0] for r in duck.execute(f"DESCRIBE {name}").fetchall()] == [f.name for f in t.schema().fields]


def test_loading_replaces_copies_and_orphans_go(spark, duck, tmp_path):
    wide = str(2**255)
    load = lambda *found: bulk_load(rows(spark, *found), TRANSFER, str(tmp_path / "load"), duck.execute)
    for _ in range(2):
        load((1, "a", 0, "1", 1), (1, "a", 0, wide, 2), (2, "b", 0, "3", 1))
    for statement in index_sql(TRANSFER):
        duck.execute(statement)
    held = lambda: duck.execute(f'SELECT block_number::BIGINT, "from", value, ids[1]::VARCHAR FROM {TRANSFER.name} ORDER BY 1').fetchall()
    assert held() == [(1, "0x1", wide, str(2**64 - 1)), (2, "0x1", "3", str(2**64 - 1))]
    load((2, "b", 0, "4", 1))
    assert [r[2] for r in held()] == [wide, "4"]
    duck.execute("CREATE TABLE gone AS SELECT * FROM (VALUES ('a'), ('b')) t(hash)")
    duck.execute(delete_blocks_sql(TRANSFER, "gone", 2))
    assert [r[0] for r in held()] == [1]
    assert delete_blocks_sql(DATASETS["reorgs"], "gone", 0) is None
