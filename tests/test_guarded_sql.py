"""What guarded SQL lets through and what it doesn't."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidebar.plans.guarded_sql import guarded, position_differences, resource, tried


@pytest.fixture
def tables(spark):
    spark.range(5).createOrReplaceTempView("secret")
    spark.range(9).withColumnRenamed("id", "hidden").createOrReplaceTempView("x")
    yield {"x": spark.range(1000).withColumn("name", F.concat(F.lit("n"), F.col("id"))), "y": spark.range(3)}
    spark.catalog.dropTempView("secret")
    spark.catalog.dropTempView("x")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM secret WHERE 1 IN (WITH secret AS (SELECT 1 AS a) SELECT a FROM secret)", "SELECT reflect('java.lang.System','getProperty','user.home')", "SELECT java_method('java.lang.System','getProperty','user.home') FROM x", "SELECT * FROM secret", "SELECT * FROM x WHERE id IN (SELECT id FROM secret)",
        "SELECT (SELECT max(id) FROM secret)", "WITH x AS (SELECT * FROM secret) SELECT * FROM x", "SELECT * FROM x JOIN secret USING (id)", "SELECT * FROM x UNION SELECT id, '' FROM secret", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM range(10)", "SELECT * FROM x) UNION ALL SELECT id, '' FROM (secret",
        "DROP VIEW x", "INSERT INTO x SELECT 1, ''", "SET a=b", "SHOW TABLES", "CREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", "", "SELECT input_file_name() FROM x", "SELECT current_user()", "SELECT current_user", "SELECT uuid() FROM x", "SELECT explode(sequence(1, 1000000000))", "SELECT TRANSFORM(id) USING 'cat' FROM x", "FROM x INSERT INTO y SELECT id",
        "SELECT mine(id) FROM x", "SELECT upper(name) FROM x -- ) \n, secret", "SELECT * FROM global_temp.g", "EXPLAIN SELECT * FROM x", "DESCRIBE x",
    ],
)
def test_refused(spark, tables, text):
    spark.udf.register("mine", lambda i: i)
    spark.range(1).createOrReplaceGlobalTempView("g")
    with pytest.raises(ValueError):
        guarded(spark, text, tables)


@pytest.mark.parametrize(
    ("text", "count"),
    [
        ("SELECT * FROM x WHERE id >= 0", 500), ("with z as (select id from x where id < 7) select count(*) from z", 1), ("SELECT 'drop table; secret' AS s FROM y -- it only says so", 3), ("SELECT * FROM x a LEFT JOIN y b ON a.id = b.id ORDER BY a.id DESC LIMIT 3", 3), ("SELECT id % 3 AS k, sum(id), avg(id), count(DISTINCT name) FROM x GROUP BY 1 HAVING count(*) > 1", 3),
        ("SELECT id, row_number() OVER (PARTITION BY id % 2 ORDER BY id) AS n FROM x WHERE upper(name) LIKE 'N1%' AND id BETWEEN 10 AND 19", 10), ("WITH secret AS (SELECT id FROM y) SELECT * FROM secret", 3), ("SELECT * FROM y WHERE id IN (SELECT max(id) FROM x WHERE x.id < 3) OR EXISTS (SELECT 1 FROM x WHERE x.id = y.id AND x.id = 0)", 2), ("SELECT 1 AS one", 1), ("SELECT * FROM y UNION ALL SELECT id FROM y", 6),
        ("SELECT CASE WHEN id > 1 THEN 'a' ELSE coalesce(NULL, 'b') END AS c, round(id / 3, 2), date_add(DATE'2024-01-01', CAST(id AS INT)) FROM y", 3),
    ],
)
def test_allowed(spark, tables, text, count):
    assert guarded(spark, text, tables, 9999).count() == count
    assert spark.table("x").columns == ["hidden"] and not [t for t in spark.catalog.listTables() if t.name.startswith("guard_")]


def test_tried(spark, tables):
    assert tried(spark, "SELECT max(id) AS m FROM y", tables) == {"ok": True, "count": 1, "rows": [{"m": 2}], "read_only": True}
    assert tried(spark, "SELECT nothing FROM y", tables)["ok"] is False


def test_resource(spark):
    trades = spark.createDataFrame([(i, f"S{i % 3}", "Trend" if i % 2 else None, i * 10) for i in range(20)], "id int, symbol string, strategy string, timestamp long")
    got = resource({"trades": trades, "wallet": trades.limit(0)}, symbol="s1", strategy="TREND", limit=2).collect()
    assert [(r["id"], r["matched"]) for r in got] == [(19, 4), (13, 4)]
    assert resource({"trades": trades}, action="buy").count() == 0 and resource({"trades": trades, "wallet": trades.limit(0)}, "WALLET").count() == 0
    for name in ("users", "signals", ""):
        with pytest.raises(ValueError):
            resource({"trades": trades}, name)


def test_position_differences(spark):
    make = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    assert sorted(map(tuple, position_differences(make("a", "b", "b"), make("b", "c")).collect())) == [("a", "missing_in_memory"), ("c", "missing_in_db")]
