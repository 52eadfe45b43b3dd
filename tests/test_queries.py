import duckdb
import pytest
from compare import DATA, assert_same, connection

from packsight.plans import queries, reports


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, DATA), queries.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_scores_between_two_decimals(spark, con):
    """0.65625 and 0.90625 lie half-way between two values of four places."""
    parts = spark.createDataFrame([(127, 31), (974, 31), (1, 31), (3, 29)], "p_partkey long, p_size int")
    truth, guess = (parts.selectExpr("p_partkey as product_key", f"to_json(struct({x})) as record") for x in ("p_size as size, p_partkey % 10 as pack, p_partkey % 2 = 0 as veg", "case when p_partkey % 3 <> 0 then p_size + p_partkey % 7 end as size, p_partkey % 10 as pack, p_partkey % 5 < 3 as veg"))
    pairs = reports.paired(truth, guess).cache()
    scores = {r.product_key: (r.precision, r.recall, r.f1) for r in pairs.collect()}
    assert scores[127] == scores[974] == (0.6563, 0.6563, 0.6563)
    near = spark.createDataFrame([(1, '{"size": 29}', '{"size": 32}')], "product_key long, truth string, guess string")
    assert reports.field_summary(near, ("size",)).first().f1 == 0.9063


@pytest.mark.parametrize("name", ["tier_escalation", "dual_reads", "cached_reads"])
def test_reads_of_odd_documents(spark, tmp_path, name):
    """Null and empty texts, and an id with two texts."""
    texts = ["", None, "x", "a" * 35, "a" * 39, "a" * 40, "a" * 41, "a" * 45, "😀" * 39, " " * 42, "a" * 50]
    rows = [*enumerate(texts), (3, "b" * 61)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(queries.QUERIES[name](spark, str(tmp_path)), queries.oracle_sql()[name], con)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
