import duckdb
import pytest
from pyspark.sql import functions as F

from veltra.catalogue import ORACLE, QUERIES, TABLES
from veltra.errors import CatalogError, PlannerError
from veltra.session import Engine


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def e(spark):
    engine = Engine(spark)
    engine.register("users", spark.createDataFrame([(1, "Ann", True, 1.5), (2, "Bob", False, None), (3, None, None, -2.0)], "id int, name string, active boolean, score double"))
    engine.register("orders", spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.0), (12, 9, 1.0), (13, None, 2.0)], "id int, user_id int, amount double"))
    return engine


def test_three_valued_logic(spark):
    values = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    e = Engine(spark).register("v", spark.createDataFrame(values, "a boolean, b boolean"))
    got = {(r.a, r.b): (r.x, r.y, r.z, r.n, r.t, r.f) for r in e.sql("SELECT a, b, a AND b AS x, a OR b AS y, a XOR b AS z, NOT a AS n, a IS NOT TRUE AS t, a IS FALSE AS f FROM v").collect()}
    for (a, b), (x, y, z, n, t, f) in got.items():
        assert x == (False if a is False or b is False else None if a is None or b is None else True)
        assert y == (True if a or b else None if a is None or b is None else False)
        assert z == (None if a is None or b is None else a != b)
        assert n == (None if a is None else not a) and t == (a is not True) and f == (a is False)


def test_joins_and_nulls(e):
    assert rows(e.sql("SELECT users.id, amount FROM users LEFT JOIN orders ON users.id = orders.user_id")) == rows_of([(1, 5.0), (1, 7.0), (2, None), (3, None)])
    assert e.sql("SELECT users.id AS u, amount FROM users FULL OUTER JOIN orders ON orders.user_id = users.id").count() == 6
    assert rows(e.sql("SELECT * FROM users JOIN orders ON 1 = 1 WHERE amount > 6")) and e.sql("SELECT * FROM users JOIN orders ON 1 = 1").columns == ["id", "name", "active", "score", "id", "user_id", "amount"]


def rows_of(x):
    return sorted(map(repr, x))


def test_ambiguous_and_missing_names(e):
    for text, part in (("SELECT id FROM users JOIN orders ON users.id = user_id", "ambiguous"), ("SELECT nope FROM users", "not found"), ("SELECT orders.name FROM users", "not found"), ("SELECT Name FROM users", "not found"), ("SELECT name FROM users GROUP BY id", "grouped"), ("SELECT a FROM nowhere", "not found")):
        with pytest.raises((PlannerError, CatalogError), match=part):
            e.sql(text)


def test_null_groups_and_empty_input(e):
    assert rows(e.sql("SELECT active, COUNT(*) AS n, COUNT(score) AS s FROM users GROUP BY active")) == rows_of([(True, 1, 1), (False, 1, 0), (None, 1, 1)])
    assert rows(e.sql("SELECT COUNT(*) AS n, SUM(score) AS s FROM users WHERE id > 99")) == rows_of([(0, None)])
    assert e.sql("SELECT id FROM users WHERE id > 99 GROUP BY id").count() == 0


def test_number_edges(e):
    assert e.sql("SELECT -5 % 3 AS m, 5 / 2 AS d, 2147483647 AS top, TRY_CAST('3000000000' AS INT) AS big, TRY_CAST(' 1 ' AS INT) AS spaced").collect()[0] == (-2, 2.5, 2147483647, None, 1)
    with pytest.raises(Exception, match="BY_ZERO"):
        e.sql("SELECT 1 % 0 AS x").collect()


def test_order_by_hidden_alias_and_nulls(e):
    assert [r[0] for r in e.sql("SELECT id FROM users ORDER BY score DESC NULLS LAST").collect()] == [1, 3, 2]
    assert [r[0] for r in e.sql("SELECT id, score * 2 AS s2 FROM users ORDER BY s2 ASC NULLS FIRST").collect()] == [2, 3, 1]
    assert [r[0] for r in e.sql("SELECT id FROM users ORDER BY id LIMIT 1 OFFSET 1").collect()] == [2]


def test_insert_checks(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE u (id INT, name VARCHAR)")
    for text, part in (("INSERT INTO u (id, name) VALUES ('Charlie', 42)", "Type mismatch for column 'id'"), ("INSERT INTO u (id, name) VALUES (1, 'Alice', TRUE)", "Column count mismatch"), ("INSERT INTO u (id, id) VALUES (1, 2)", "twice"), ("INSERT INTO u (x) VALUES (1)", "not found")):
        with pytest.raises(PlannerError, match=part):
            e.sql(text)
    with pytest.raises(CatalogError, match="exists"):
        e.sql("CREATE TABLE u (a INT)")
    e.sql("INSERT INTO u (name) VALUES ('Ann'); INSERT INTO u SELECT 7, 'B'")
    assert rows(e.sql("SELECT * FROM u")) == rows_of([(None, "Ann"), (7, "B")])


def test_dml_only_matches_true(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE n (a INT, b INT); INSERT INTO n VALUES (1, 1), (NULL, 2), (3, 3)")
    e.sql("UPDATE n SET a = b + 10, b = a WHERE a > 0")
    assert rows(e.sql("SELECT * FROM n")) == rows_of([(11, 1), (None, 2), (13, 3)])
    e.sql("DELETE FROM n WHERE a > 11")
    assert rows(e.sql("SELECT * FROM n")) == rows_of([(11, 1), (None, 2)])
    table = e.catalog.table("n")
    assert table.read(1).count() == 3 and len(table.versions()) == 4
    e.sql("DELETE FROM n")
    assert e.sql("SELECT * FROM n").count() == 0 and e.sql("SELECT * FROM n").columns == ["a", "b"]


def test_concurrent_writers_are_refused(spark):
    e = Engine(spark)
    e.sql("CREATE TABLE c (a INT)")
    table = e.catalog.table("c")
    before = table.manifest()
    table.append(spark.range(1).select(F.lit(1).alias("a")))
    table.manifest = lambda version=None: before
    with pytest.raises(CatalogError, match="another writer"):
        table.append(spark.range(1).select(F.lit(2).alias("a")))
    assert e.sql("SELECT a FROM c").collect() == [(1,)]


def test_strict_planner(spark):
    e = Engine(spark, strict=True).register("t", spark.createDataFrame([(1, 2)], "a int, b int"))
    for text in ("SELECT CAST(a AS BIGINT) FROM t", "SELECT a FROM t JOIN t ON a > b", "SELECT a FROM t JOIN t ON a = b AND b = a"):
        with pytest.raises(PlannerError):
            e.sql(text)


def test_pushdown_reaches_the_scan(spark, sf_dir):
    plan = Engine(spark).register_parquet(sf_dir, "lineitem").explain("SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R'")
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    return repr(round(float(value), 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_catalogue(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE:
        assert got
        return
    result = con.sql(ORACLE[name])
    assert sorted(result.columns) == columns
    place = [result.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in place) for r in result.fetchall())
