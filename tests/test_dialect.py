import pytest
from hypothesis import given
from hypothesis import strategies as st

from veltra.dialect import parse
from veltra.dialect import tree as t
from veltra.dialect.lexer import KEYWORDS, tokenize
from veltra.errors import ParserError, TokenizerError

ACCEPTED = [
    "SELECT * FROM t;", "SELECT a FROM t", "select a, b from t where a = 1;", "SELECT x, * FROM t", "SELECT a AS x FROM t;", "SELECT 'a' || 'b' FROM t;",
    "SELECT t.a, s.t.b FROM t;", "SELECT 1., 1.5, 9L, TRUE, NULL FROM t", 'SELECT "text" FROM t', "SELECT /* note */ a FROM t", "SELECT `a` FROM `t`",
    "SELECT a FROM t JOIN u ON t.a = u.b", "SELECT a FROM t INNER JOIN u ON t.a = u.b LEFT JOIN v ON v.x = u.b", "SELECT a FROM t RIGHT JOIN u ON 1 = 1",
    "SELECT a FROM t FULL OUTER JOIN u ON t.a = u.b", "SELECT a FROM t GROUP BY a, b + 1 ORDER BY a DESC, t.b ASC LIMIT 3 OFFSET 4", "SELECT a FROM t OFFSET 2",
    "SELECT a FROM t GROUP ORDER BY a", "SELECT CAST(a AS INT), TRY_CAST(a AS VARCHAR(9)), CEIL(a), FLOOR(a + 1) FROM t", "SELECT id, count FROM t",
    "INSERT INTO t VALUES (1);", "INSERT INTO t (a, b) VALUES (1, 'x')", "INSERT INTO t(a,b)VALUES(1,2);", "INSERT INTO t (a) SELECT b FROM u", "INSERT INTO t VALUES (-1 + a.b)",
    "INSERT INTO t VALUES (1) ORDER BY a LIMIT 2", "UPDATE t SET a = 1", "UPDATE t SET a = b || 'x', c = -4 WHERE a > 0 AND b < 10;", "DELETE FROM t", "DELETE FROM t WHERE --42 = a",
    "DELETE FROM t WHERE NOT a == b XOR c <> d OR e % 2 >= 1", "CREATE TABLE t (a INT, b INT(11), c BIGINT(20), d BOOLEAN, e DATE, f FLOAT, g FLOAT(8), h FLOAT(8, -2), i DOUBLE(10, 2), j DOUBLE PRECISION, k DOUBLE PRECISION UNSIGNED, l VARCHAR(255))",
    ";;SELECT a FROM t;; SELECT b FROM u;", "", "DELETE FROM t WHERE a = 'no end",
]
REFUSED = [
    "SELECT FROM t;", "SELECT a;", "SELECT a, FROM t", "SELECT *, a FROM t", "SELECT a b FROM t", "SELECT a AS id FROM t", "SELECT a AS count FROM t", "SELECT a FROM 12;",
    "SELECT a FROM t WHERE;", "SELECT a FROM t LIMIT;", "SELECT a FROM t LIMIT x", "SELECT a FROM t OFFSET 1 LIMIT 2", "SELECT a FROM t GROUP BY;", "SELECT a FROM t ORDER BY;",
    "SELECT a FROM t JOIN u", "SELECT a FROM t JOIN u ON", "SELECT a FROM t FULL JOIN u ON a = b", "SELECT a FROM t LEFT OUTER JOIN u ON a = b", "SELECT a FROM t AS x", "SELECT a FROM t, u",
    "SELECT a FROM (SELECT b FROM u)", "SELECT DISTINCT a FROM t", "SELECT SUM(a) FROM t", "SELECT a FROM t HAVING a > 1", "SELECT a FROM t UNION SELECT b FROM u", "WITH x AS (SELECT a FROM t) SELECT a FROM x",
    "SELECT a FROM t WHERE a IS NULL", "SELECT a FROM t WHERE a IN (1)", "SELECT a FROM t WHERE a BETWEEN 1 AND 2", "SELECT a FROM t WHERE a LIKE 'x'", "SELECT a FROM t WHERE a != 1", "SELECT a & 1 FROM t",
    "SELECT a | 1 FROM t", "SELECT a::INT FROM t", "SELECT a[1] FROM t", "SELECT _a FROM t", "SELECT a. FROM t", "SELECT ((a) FROM t", "SELECT CAST(a AS INT FROM t", "SELECT CAST(a AS TIME) FROM t",
    "VALUES (1)", "SHOW TABLES", "DROP TABLE t", "ALTER TABLE t", "INSERT t VALUES (1)", "INSERT INTO t VALUES;", "INSERT INTO t () VALUES (1)", "INSERT INTO t (a,) VALUES (1)", "INSERT INTO t VALUES (1,)",
    "INSERT INTO t VALUES (1), (2)", "INSERT INTO t (a) (1)", "UPDATE SET a = 1", "UPDATE t a = 1", "UPDATE t SET a 1", "UPDATE t SET a = 1,", "UPDATE t SET a = 1 WHERE", "UPDATE t AS x SET a = 1", "DELETE t", "DELETE FROM",
    "DELETE FROM t WHERE +", "DELETE FROM t WHERE 1 +", "DELETE FROM t WHERE SELECT 1", "DELETE FROM t AS x", "CREATE t (a INT)", "CREATE TABLE t ()", "CREATE TABLE t (a INT(1, 2))", "CREATE TABLE t (a DECIMAL)", "SELECT !@# FROM t;", "SELECT a FROM t SELECT b FROM u",
]


@pytest.mark.parametrize("text", ACCEPTED)
def test_strict_accepts(text):
    parse(text, strict=True)


@pytest.mark.parametrize("text", REFUSED)
def test_strict_refuses(text):
    with pytest.raises((ParserError, TokenizerError)):
        parse(text, strict=True)


EXTENDED = [
    "SELECT DISTINCT a x, t.* FROM t AS q, u JOIN v USING (k) CROSS JOIN w", "SELECT COUNT(*), SUM(DISTINCT a) FROM t GROUP BY CUBE (a, b) HAVING MAX(c) > 1", "SELECT a FROM t WHERE a IS NOT NULL AND b IS TRUE AND c NOT IN (1, 2) OR d NOT BETWEEN 1 AND 2",
    "SELECT CASE a WHEN 1 THEN 'x' ELSE 'y' END, CASE WHEN b THEN 1 END FROM t", "WITH x AS (SELECT 1 AS a), y AS (SELECT a FROM x) SELECT a FROM y UNION ALL SELECT a FROM x EXCEPT SELECT 2 ORDER BY 1 NULLS LAST LIMIT 1", "VALUES (1, 'a'), (2, 'b')", "SELECT 'it''s' FROM t",
    "SELECT a::BIGINT, b[1], a & 1 | 2 ^ 3 FROM t WHERE a != 1 AND EXISTS (SELECT 1) AND x > (SELECT MAX(y) FROM u)", "DROP TABLE IF EXISTS a, b; SHOW TABLES", "SELECT a FROM t LEFT SEMI JOIN u ON a = b ANTI JOIN v ON a = c", "SELECT LEFT(a, 2), IF(a > 1, 2, 3) FROM t WHERE a NOT LIKE 'x%' AND a REGEXP 'y'",
]


@pytest.mark.parametrize("text", EXTENDED)
def test_extended_accepts_what_strict_refuses(text):
    parse(text)
    with pytest.raises((ParserError, TokenizerError)):
        parse(text, strict=True)


def where(text):
    return parse(f"DELETE FROM t WHERE {text}")[0].where


N = {c: t.Name((c,)) for c in "abcd"}


@pytest.mark.parametrize(
    "text, tree",
    [
        ("a + b * c", t.Binary("+", N["a"], t.Binary("*", N["b"], N["c"]))),
        ("a - b - c", t.Binary("-", t.Binary("-", N["a"], N["b"]), N["c"])),
        ("a || b + c", t.Binary("+", t.Binary("||", N["a"], N["b"]), N["c"])),
        ("-a * b", t.Binary("*", t.Unary("-", N["a"]), N["b"])),
        ("NOT a = b", t.Unary("NOT", t.Binary("=", N["a"], N["b"]))),
        ("NOT a AND b", t.Binary("AND", t.Unary("NOT", N["a"]), N["b"])),
        ("a OR b AND c", t.Binary("OR", N["a"], t.Binary("AND", N["b"], N["c"]))),
        ("a > b XOR c > d", t.Binary(">", t.Binary(">", N["a"], t.Binary("XOR", N["b"], N["c"])), N["d"])),
        ("a == b", t.Binary("=", N["a"], N["b"])),
        ("(a)", t.Nested(N["a"])),
        ("a.b.c", t.Name(("a", "b", "c"))),
    ],
)
def test_precedence(text, tree):
    assert where(text) == tree


def test_literals():
    assert [i.expr for i in parse("SELECT 42, 9L, 1., 1.5, 'a', \"b\", FALSE, NULL FROM t")[0].body.items] == [
        t.Literal("integer", 42), t.Literal("long", 9), t.Literal("decimal", 1.0), t.Literal("decimal", 1.5), t.Literal("string", "a"), t.Literal("string", "b"), t.Literal("boolean", False), t.Literal("null"),
    ]


def test_keywords_are_upper_case_and_complete():
    assert len(KEYWORDS) == 70 and all(k == k.upper() for k in KEYWORDS)


@given(st.text(max_size=40))
def test_any_text_is_read_or_refused(text):
    for strict in (True, False):
        try:
            parse(text, strict)
            assert tokenize(text, strict)[-1].kind == "end"
        except (ParserError, TokenizerError):
            pass
