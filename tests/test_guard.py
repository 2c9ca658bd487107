"""The SQL guard refuses what would read other tables, files or Java."""

import pytest

from corpusloom.operators.structured import run_sql, validated


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    spark.range(5).withColumnRenamed("id", "o").createOrReplaceTempView("orders")
    spark.range(3).withColumnRenamed("id", "s").createOrReplaceTempView("secret")
    at = f"{tmp_path_factory.mktemp('files')}/x.orders"
    spark.range(2).write.parquet(at)
    return at


REFUSED = [
    "SELECT * FROM secret",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "WITH a AS (SELECT * FROM orders) SELECT * FROM a WHERE o IN (SELECT s FROM secret)",
    "SELECT (SELECT max(s) FROM secret) AS m FROM orders",
    "SELECT * FROM orders JOIN (WITH orders AS (SELECT s AS o FROM secret) SELECT * FROM orders) USING (o)",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM orders",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT * FROM global_temp.orders",
    "DROP TABLE orders",
    "SELECT 1; SELECT 2",
    "INSERT INTO orders VALUES (1)",
    "",
    "SELECT FROM WHERE",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, tables, sql):
    with pytest.raises(ValueError):
        validated(spark, sql, ["orders"])


def test_files_are_refused(spark, tables):
    with pytest.raises(ValueError):
        validated(spark, f"SELECT * FROM parquet.`{tables}`", ["orders"])


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("SELECT * FROM orders;", 5),
        ("WITH secret AS (SELECT o FROM orders WHERE o > 2) SELECT * FROM secret", 2),
        ("SELECT o, ';drop' AS x FROM orders WHERE o = (SELECT max(o) FROM orders)", 1),
        ("SELECT * FROM VALUES (1), (2) AS t(x)", 2),
        ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT n FROM t", 4),
    ],
)
def test_allowed(spark, tables, sql, rows):
    assert run_sql(spark, sql, ["orders"]).count() == rows
