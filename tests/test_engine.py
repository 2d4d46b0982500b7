"""The dialect: expected values are written out by hand from its rules."""

import sqlite3

import pytest

from tessera import errors
from tessera.functions.core import glob_regex
from tessera.functions.python_parts import difference, rendered
from tessera.lexer import tokens
from tessera.parser import parse
from tessera.session import Session


@pytest.fixture(scope="module")
def s(spark):
    return Session(spark)


def rows(s, sql):
    return [tuple(r) for r in s.script(sql)[-1].collect()]


SCALARS = [
    ("1 + 2", 3), ("7 / 2", 3), ("-7 / 2", -3), ("7 / 0", None), ("7 % 0", None), ("-7 % 3", -1), ("7.5 % 2", 1.0), ("7 / 2.0", 3.5),
    ("'5' + 1", 6), ("'1.5x' + 1", 2.5), ("'abc' + 1", 1), ("9223372036854775807 + 1", 9223372036854775808.0),
    ("1 = '1'", 0), ("1 < 'a'", 1), ("'a' < x'00'", 1), ("NULL = NULL", None), ("NULL IS NULL", 1), ("1 IS NOT NULL", 1), ("1 IS DISTINCT FROM 2", 1),
    ("NULL AND 0", 0), ("NULL OR 1", 1), ("NOT NULL", None), ("'1abc' AND 1", 1), ("'abc' OR 0", 0),
    ("2 IN (1, NULL)", None), ("1 IN (1, NULL)", 1), ("NULL IN ()", 0), ("2 NOT IN (1, 3)", 1), ("2 IN (SELECT 1 UNION ALL SELECT NULL)", None), ("NULL IN (SELECT 1 WHERE 0)", 0),
    ("1 << 64", 0), ("-1 >> 70", -1), ("8 >> 1", 4), ("1 << -1", 0), ("~5", -6), ("6 & 3", 2), ("6 | 3", 7),
    ("'ABC' LIKE 'a%'", 1), ("'É' LIKE 'é'", 0), ("'a_c' LIKE 'a\\_c' ESCAPE '\\'", 1), ("'abc' LIKE 'a\\_c' ESCAPE '\\'", 0), ("'a%' LIKE 'a\\' ESCAPE '\\'", 0),
    ("'abc' GLOB 'a[b-d]?'", 1), ("'abc' GLOB 'A*'", 0), ("'x' GLOB '[^a-c]'", 1), ("like('a%', 'ABC')", 1), ("glob('a*', 'abc')", 1),
    ("CASE 1 WHEN 1 THEN 'x' ELSE 'y' END", "x"), ("CASE NULL WHEN NULL THEN 1 ELSE 2 END", 2), ("'a' = 'A' COLLATE NOCASE", 1), ("'a ' = 'a' COLLATE RTRIM", 1),
    ("CAST('12abc' AS INTEGER)", 12), ("CAST('1.5e2x' AS REAL)", 150.0), ("CAST(3.9 AS INTEGER)", 3), ("CAST('5.0' AS NUMERIC)", 5), ("CAST(-9e99 AS INTEGER)", -9223372036854775808),
    ("1.0 || ''", "1.0"), ("0.1 + 0.2 || ''", 0.1 + 0.2), ("(0.1 + 0.2) || ''", "0.3"), ("1e15 || ''", "1.0e+15"), ("1e14 || ''", "100000000000000.0"), ("0.00001 || ''", "1.0e-05"), ("-2.5 || ''", "-2.5"),
    ("substr('hello', 0, 3)", "he"), ("substr('hello', -3, 2)", "ll"), ("substr('hello', 4, -2)", "el"), ("substr('hello', -10, 7)", "he"), ("substr(x'010203', 2)", b"\x02\x03"),
    ("round(2.355, 2)", 2.35), ("round(0.125, 2)", 0.13), ("round(-2.5)", -3.0), ("round(123.4, -1)", 123.0), ("round(2.55, 1)", 2.5),
    ("log(100)", 2.0), ("log(2, 8)", 3.0), ("sqrt(-1)", None), ("ln(0)", None), ("acos(2)", None), ("floor(-1.5)", -2.0), ("ceil(3)", 3), ("trunc(-1.7)", -1.0), ("sign(-3.2)", -1), ("mod(7, 0)", None), ("sqrt('4x')", None),
    ("length('héllo')", 5), ("octet_length('é')", 2), ("length(x'0102')", 2), ("upper('aé')", "Aé"), ("replace('aaa', '', 'b')", "aaa"), ("instr('hello', 'll')", 3), ("trim('  a ')", "a"), ("ltrim('xxa', 'x')", "a"),
    ("hex(17)", "3137"), ("hex(NULL)", ""), ("unhex('41')", b"A"), ("unhex('4')", None), ("unhex('41-42', '-')", b"AB"), ("unhex('4-142', '-')", None), ("quote('it''s')", "'it''s'"), ("quote(NULL)", "NULL"), ("quote(x'0a')", "X'0A'"),
    ("char(65, 233)", "Aé"), ("unicode('é')", 233), ("concat('a', NULL, 1)", "a1"), ("concat_ws('-', NULL, 'a', '', 'b')", "a--b"), ("concat_ws('-', '', 'a')", "a"),
    ("iif(0, 'y', 'n')", "n"), ("iif(0, 1, 1, 2)", 2), ("nullif(1, 1)", None), ("nullif(1, '1')", 1), ("coalesce(NULL, 2)", 2), ("min(3, 1, 2)", 1), ("max(1, NULL)", None),
    ("typeof(1)", "integer"), ("typeof(1.5)", "real"), ("typeof('a')", "text"), ("typeof(x'00')", "blob"), ("typeof(NULL)", "null"), ("zeroblob(2)", b"\0\0"),
    ("date('2024-01-31', '+1 month')", "2024-03-02"), ("date('2023-02-29')", "2023-03-01"), ("datetime('2024-02-29 12:34:56.789')", "2024-02-29 12:34:56"), ("time('12:34', 'subsec')", "12:34:00.000"),
    ("date('2024-05-05', 'weekday 0')", "2024-05-05"), ("date('2024-05-06', 'start of month', '-1 day')", "2024-04-30"), ("datetime(1700000000, 'unixepoch')", "2023-11-14 22:13:20"), ("date(2460000.5)", "2023-02-25"),
    ("julianday('2000-01-01')", 2451544.5), ("unixepoch('2024-01-01')", 1704067200), ("datetime('2024-01-01T00:00+05:00')", "2023-12-31 19:00:00"), ("date('no')", None), ("date('2024-13-01')", None), ("strftime('%Q', '2024-01-01')", None),
    ("strftime('%Y-%j %W %U %w %u %V %G', '2024-03-10')", "2024-070 10 10 0 7 10 2024"), ("strftime('%I %p %l %k', '2024-01-01 15:04:05')", "03 PM  3 15"), ("date('2024-01-01', 'bogus')", None), ("date('2024-01-15', '+1.5 months')", "2024-03-01"),
    ("timediff('2024-03-31', '2024-02-29')", "+0000-01-02 00:00:00.000"), ("timediff('2024-01-01', '2024-01-02 12:00')", "-0000-00-01 12:00:00.000"),
    ("printf('%05d|%-4s|%.2f', 42, 'ab', 3.14159)", "00042|ab  |3.14"), ("json_array(1, 'a', NULL, 2.5)", '[1,"a",null,2.5]'), ("json_object('a', 1, 'b', 'x\"y')", '{"a":1,"b":"x\\"y"}'), ("json_array()", "[]"),
    ("0xFF", 255), ("1_000", 1000), ("9223372036854775808", 9223372036854775808.0), ("-9223372036854775808", -9223372036854775808), ("1 IS TRUE", 1), ("NULL IS NOT TRUE", 1), ("TRUE + 1", 2),
    ("(SELECT 1 WHERE 0)", None), ("(SELECT 5 UNION ALL SELECT 6 ORDER BY 1 LIMIT 1)", 5), ("EXISTS (SELECT 1)", 1), ("NOT EXISTS (SELECT 1)", 0),
]


def test_scalars(s):
    """All in one query, so that one plan is made."""
    got = rows(s, "SELECT " + ", ".join(e for e, _ in SCALARS))[0]
    bad = [(e, g, w) for (e, w), g in zip(SCALARS, got, strict=True) if (bytes(g) if isinstance(g, bytearray) else g) != w or type(g) is bool]
    assert not bad


def test_printf():
    show = lambda v, c: "" if v is None else str(v)
    cases = [("%d", "t", ["12x"], "12"), ("%5.1e", "r", ["1234.5"], "1.2e+03"), ("%+d % d", "ii", ["5", "5"], "+5  5"), ("%x %#x %o %X", "iiii", ["255"] * 4, "ff 0xff 377 FF"), ("%u", "i", ["-1"], "18446744073709551615"),
             ("%r %r %r", "iii", ["1", "12", "23"], "1st 12th 23rd"), ("%q|%Q|%w", "ttt", ["a'b", "a'b", 'a"b'], "a''b|'a''b'|a\"\"b"), ("%Q", "n", [None], "NULL"), ("%c%%", "t", ["xyz"], "x%"), ("%*d", "ii", ["4", "7"], "   7"), ("%.2s", "t", ["abc"], "ab"), ("", "", [], None), ("%y", "i", ["1"], None)]
    for fmt, kinds, args, want in cases:
        assert rendered(fmt, kinds, args, show) == want
    assert difference(None, 1) is None and difference(0, 0) == "+0000-00-00 00:00:00.000"


def test_syntax():
    assert [t.value for t in tokens("a -- c\n<> x'4a'")][:3] == ["a", "<>", b"J"]
    for bad in ("SELECT", "SELECT 1 FROM", "SELECT * FROM a RIGHT JOIN b ON 1", "SELECT 12ab", "SELECT 1 SELECT 2", "SELECT x'4'", "CREATE TABLE t(a, PRIMARY KEY(a))", "SELECT 'a' COLLATE nope", "SELECT \"a\""):
        with pytest.raises(errors.SyntaxFault):
            parse(bad)
    assert glob_regex("[a") is None


def test_rejections(s):
    for sql, kind in [
        ("SELECT nope", errors.NoSuchColumn), ("SELECT * FROM nope", errors.NoSuchTable), ("SELECT nope(1)", errors.UnknownFunction), ("SELECT abs(1, 2)", errors.WrongArgumentCount), ("SELECT 1 UNION SELECT 1, 2", errors.ColumnCountMismatch),
        ("SELECT 1 ORDER BY 2", errors.SyntaxFault), ("SELECT 1 HAVING 1", errors.SyntaxFault), ("SELECT 1 LIMIT 'x'", errors.DatatypeMismatch), ("SELECT sum(1) FROM (VALUES (1)) WHERE sum(1) > 0", errors.UnknownFunction),
        ("SELECT column1 FROM (VALUES (1)) a, (VALUES (2)) b", errors.AmbiguousColumn), ("SELECT *, count(*) FROM (VALUES (1))", errors.SyntaxFault), ("SELECT 'a' LIKE 'b' ESCAPE 'cc'", errors.InvalidEscape), ("SELECT json_array(x'00')", errors.DatatypeMismatch),
        ("VALUES (1), (2, 3)", errors.ColumnCountMismatch), ("WITH RECURSIVE c(n) AS (SELECT n FROM c UNION ALL SELECT 1) SELECT * FROM c", errors.SyntaxFault),
    ]:
        with pytest.raises(kind):
            s.sql(sql)


def test_queries(s):
    assert rows(s, "SELECT 1 UNION SELECT 2 INTERSECT SELECT 2 EXCEPT SELECT 3") == [(2,)]
    assert rows(s, "SELECT column1 FROM (VALUES ('b'), ('A'), (NULL), ('a')) ORDER BY column1 COLLATE NOCASE DESC LIMIT 2")[0] == ("b",)
    assert rows(s, "SELECT column1 FROM (VALUES (2), (NULL), (1)) ORDER BY 1") == [(None,), (1,), (2,)]
    assert rows(s, "SELECT count(*), sum(column1), total(column1), group_concat(column1) FROM (VALUES (1)) WHERE 0") == [(0, None, 0.0, None)]
    assert rows(s, "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 150) SELECT count(*), max(n) FROM c") == [(150, 150)]
    assert rows(s, "WITH RECURSIVE c(n) AS (SELECT 1 UNION SELECT (n + 1) % 5 FROM c) SELECT n FROM c ORDER BY n") == [(i,) for i in range(5)]
    assert sorted(rows(s, "SELECT DISTINCT column1 COLLATE NOCASE FROM (VALUES ('a'), ('a'), ('b'))")) == [("a",), ("b",)]
    assert s.sql("SELECT 1+2, column1 AS z, column2 FROM (VALUES (1, 2))").columns == ["1+2", "z", "column2"]


def test_statements(spark):
    s = Session(spark)
    s.script("CREATE TABLE t(id INTEGER PRIMARY KEY, x TEXT COLLATE NOCASE NOT NULL, y INTEGER CHECK(y > 0)); INSERT INTO t VALUES (1, 'a', 5), (5, 'B', 6)")
    assert rows(s, "INSERT INTO t(x) VALUES ('c') RETURNING id, x, y") == [(6, "c", None)]
    for bad in ("INSERT INTO t VALUES (1, 'q', 1)", "INSERT INTO t VALUES (9, NULL, 1)", "INSERT INTO t VALUES (9, 'q', 0)", "UPDATE t SET y = 0", "INSERT INTO t VALUES (8, 'a', 1), (8, 'b', 1)"):
        with pytest.raises(errors.ConstraintFault):
            s.script(bad)
    assert rows(s, "SELECT count(*) FROM t") == [(3,)]
    s.script("INSERT OR IGNORE INTO t VALUES (1, 'z', 1), (7, 'ok', 1), (8, NULL, 1)")
    assert rows(s, "SELECT id, x FROM t WHERE x IN ('A', 'ok') ORDER BY id") == [(1, "a"), (7, "ok")]
    s.script("INSERT OR REPLACE INTO t VALUES (1, 'new', 1), (1, 'newer', 2)")
    assert rows(s, "SELECT x, y FROM t WHERE id = 1") == [("newer", 2)]
    assert rows(s, "UPDATE t SET y = id * 10 WHERE x = 'b' RETURNING id, y") == [(5, 50)]
    assert rows(s, "SELECT changes()") == [(1,)]
    assert rows(s, "BEGIN; DELETE FROM t; ROLLBACK; SELECT count(*) FROM t") == [(4,)]
    assert rows(s, "SAVEPOINT a; DELETE FROM t WHERE id > 1; ROLLBACK TO a; RELEASE a; SELECT count(*) FROM t") == [(4,)]
    assert rows(s, "DELETE FROM t WHERE id IN (SELECT id FROM t WHERE y IS NULL) RETURNING x") == [("c",)]
    assert rows(s, "PRAGMA user_version = 3; PRAGMA user_version") == [(3,)]
    assert rows(s, "SELECT group_concat(x, ';'), x FROM t") == [("newer;B;ok", "newer")]


def test_database_file(spark, tmp_path):
    path = str(tmp_path / "a.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, x TEXT, y REAL, z BLOB)")
    db.execute("CREATE TABLE e(a)")
    many = [(i * 3 - 5, "é" * (i % 50), i / 7, bytes([i % 256])) for i in range(3000)] + [(99999, "long" * 5000, None, None)]
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", many)
    db.execute("ALTER TABLE t ADD COLUMN w INTEGER")
    db.commit()
    db.execute("PRAGMA journal_mode = WAL")
    db.execute("PRAGMA wal_autocheckpoint = 0")
    db.execute("INSERT INTO t VALUES (200000, 'in the log', 1.5, NULL, 7)")
    db.commit()
    s = Session(spark).attach(path)
    got = rows(s, "SELECT id, x, y, z, w FROM t ORDER BY id")
    want = db.execute("SELECT id, x, y, z, w FROM t ORDER BY id").fetchall()
    assert [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got] == want
    assert rows(s, "SELECT count(*) FROM e") == [(0,)]
    assert sorted(rows(s, "SELECT name FROM sqlite_schema")) == [("e",), ("t",)]
    db.close()


def test_file_mode(spark, tmp_path):
    path = str(tmp_path / "w.db")
    s = Session(spark).attach(path, write=True)
    s.script("CREATE TABLE t(id INTEGER PRIMARY KEY, x TEXT COLLATE NOCASE NOT NULL, y REAL, z); CREATE TABLE u(a)")
    s.script("BEGIN; INSERT INTO t VALUES (1, 'one', 1.5, x'00ff'), (7, printf('%09000d', 3), NULL, NULL); INSERT INTO u VALUES ('a'); COMMIT; PRAGMA user_version = 12")
    db = sqlite3.connect(path)
    assert db.execute("PRAGMA integrity_check").fetchall() == [("ok",)] and db.execute("PRAGMA user_version").fetchone() == (12,)
    assert db.execute("SELECT id, x, y FROM t ORDER BY id").fetchall() == [(1, "one", 1.5), (7, "0" * 8999 + "3", None)]
    assert db.execute("SELECT sql FROM sqlite_master WHERE name = 't'").fetchone()[0].startswith("CREATE TABLE t(id INTEGER PRIMARY KEY, x TEXT COLLATE NOCASE NOT NULL")
    db.executemany("INSERT INTO u VALUES (?)", [(f"row {i}" * 9,) for i in range(4000)])
    db.commit()
    db.close()
    s = Session(spark).attach(path, write=True)
    assert rows(s, "SELECT count(*), min(x) FROM t WHERE x = 'ONE'") == [(1, "one")]
    s.script("BEGIN; DELETE FROM u; ROLLBACK; UPDATE t SET y = id * 2 WHERE y IS NULL; DELETE FROM u WHERE a LIKE 'row 1%'")
    with pytest.raises(errors.ConstraintFault):
        s.sql("INSERT INTO t(x) VALUES (NULL)")
    db = sqlite3.connect(path)
    assert db.execute("PRAGMA integrity_check").fetchall() == [("ok",)] and db.execute("SELECT y FROM t ORDER BY id").fetchall() == [(1.5,), (14.0,)]
    assert db.execute("SELECT count(*) FROM u").fetchone() == (1 + 4000 - 1111,)
    db.execute("CREATE TABLE w(a INTEGER)")
    db.executemany("INSERT INTO w VALUES (?)", [(1,), ("x",), (2.5,), (None,)])
    db.execute("CREATE TABLE odd(a, b, PRIMARY KEY(a, b))")
    root = db.execute("SELECT rootpage FROM sqlite_master WHERE name = 'w'").fetchone()[0]
    db.commit()
    db.close()
    with pytest.warns(UserWarning, match="odd"):
        s = Session(spark).attach(path)
    assert sorted(rows(s, "SELECT a FROM w"), key=str) == [("1",), ("2.5",), ("x",), (None,)]
    raw = bytearray(open(path, "rb").read())
    raw[(root - 1) * 4096] = 99  # a page that is none
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="is no table page"):
        Session(spark).attach(path)


def test_streams_are_tables(spark, tmp_path):
    """A streaming DataFrame can be registered; queries over it are streams."""
    spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k long, v double").write.parquet(str(tmp_path / "in"))
    s = Session(spark)
    s.register("ev", spark.readStream.schema("k long, v double").parquet(str(tmp_path / "in")))
    out = s.sql("SELECT k, count(*) AS n, sum(v) AS t FROM ev WHERE v > 2 GROUP BY k HAVING count(*) > 1")
    assert out.isStreaming
    q = out.writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("streamed").collect()) == [(0, 9, 135.0), (1, 9, 144.0), (2, 9, 153.0)]


def test_appends_become_one_snapshot(spark):
    s = Session(spark)
    s.sql("CREATE TABLE t(a INTEGER)")
    for i in range(10):
        s.sql(f"INSERT INTO t VALUES ({i}), ({i})")
    assert s.tables["t"].parts < 10 and rows(s, "SELECT count(*), sum(a), last_insert_rowid() FROM t") == [(20, 90, 20)]


def test_shell(spark, tmp_path):
    import io

    from tessera.__main__ import main

    def said(args, lines=()):
        out, err = io.StringIO(), io.StringIO()
        return main(args, Session(spark), lines, out, err), out.getvalue(), err.getvalue()

    assert said(["-c", "VALUES (1, NULL, 2.50, 'a' || char(1) || 'b' || char(0) || 'c', x'41')"]) == (0, "1||2.5|a^Ab|A\n", "")
    assert said(["-c", "SELECT nope"])[0] == 1 and "NoSuchColumn" in said(["-c", "SELECT nope"])[2]
    path = str(tmp_path / "c.db")
    lines = ["CREATE TABLE t(a INTEGER, b TEXT)", "", "SELECT oops(", "INSERT INTO t VALUES (1, 'x'), (2, 'y') RETURNING a", ".help", ".exit", "SELECT 5"]
    code, out, err = said(["-file", path], lines)
    assert code == 0 and out.startswith("1\n2\n") and ".help shows" in out and "5" not in out.splitlines() and err.startswith("error: SyntaxFault")
    assert said(["-file", path, "-c", "SELECT b FROM t ORDER BY a DESC"]) == (0, "y\nx\n", "")
    assert said(["-x", "1"])[0] == 2


def test_plans(spark):
    """Filters and columns reach the scan; joins hash; top-k isn't a full sort."""
    from tessera import catalogue

    s = catalogue.open_session(spark, "/root/testdata/sf0.001")
    plan = lambda sql: s.sql(sql)._jdf.queryExecution().executedPlan().toString()
    p = plan("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
    assert "GreaterThan(l_quantity,45" in p and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    assert "HashJoin" in plan("SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey")
    assert "LeftSemi" in plan(catalogue.QUERIES["semi_exists"][0]) and "TakeOrderedAndProject" in plan(catalogue.QUERIES["topk"][0])
    assert "partial_sum" in plan(catalogue.FLAGSHIP)


def test_timediff_of_all_orders(spark):
    from datetime import datetime, timedelta

    from tessera import catalogue

    folder, start = "/root/testdata/sf0.001", datetime(1990, 1, 1)
    want = {}
    for r in spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate").collect():
        d = datetime.combine(r.o_orderdate, datetime.min.time()) if not isinstance(r.o_orderdate, datetime) else r.o_orderdate
        months = (d.year - 1990) * 12 + d.month - 1
        left = d - datetime(d.year, d.month, 1)
        assert d >= start
        h, ms = divmod((left - timedelta(days=left.days)) // timedelta(milliseconds=1), 3600000)
        want[r.o_orderkey] = f"+{months // 12:04d}-{months % 12:02d}-{left.days:02d} {h:02d}:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"
    got = catalogue.queries()["fn_timediff"](spark, folder).collect()
    assert len(got) == len(want) > 500 and {r.o_orderkey: r.d for r in got} == want


ZEROS = [(1, "a", 0, -0.0, "X"), (2, "b", 1, 0.0, "Y"), (3, "c", 2, -0.004, "Z"), (4, "d", 3, -12.5, "X"), (5, "e", 4, 9999.99, "Y")]


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("zeros"))
    spark.createDataFrame(ZEROS, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return folder


def same_as_sql(spark, folder, name):
    import duckdb

    from tessera import catalogue

    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{folder}/customer.parquet/*.parquet')")
    want = sorted(db.execute(catalogue.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, catalogue.queries()[name](spark, folder).collect())) == want
    return want


def test_printf_number_of_a_negative_zero(spark, zeros):
    assert same_as_sql(spark, zeros, "fn_printf_number")[0][1].startswith("1st|-0.000000e+00|-0.000E+00|")


def test_real_text_of_a_negative_zero(spark, zeros):
    assert same_as_sql(spark, zeros, "fn_real_text")[0][1] == "-0.0"
    at = "FROM customer WHERE c_custkey = 1"
    s = Session(spark).load(zeros, ["customer"])
    # columns of Parquet files keep the sign, through subqueries and sets too
    assert rows(s, f"SELECT r || '', quote(r), CAST(r COLLATE NOCASE AS TEXT), printf('%s %d', r, r) FROM (SELECT c_acctbal AS r {at})") == [("-0.0", "-0.0", "-0.0", "-0.0 0")]
    assert rows(s, f"WITH w(r) AS (SELECT c_acctbal {at}) SELECT r || '' FROM w UNION ALL SELECT r FROM w UNION ALL SELECT r || '' FROM (SELECT r FROM w UNION ALL SELECT r FROM w)") == [("-0.0",)] * 4
    assert rows(s, f"SELECT c_acctbal || '' {at} GROUP BY c_custkey") == [("-0.0",)]
    # what the dialect computes or stores has none
    assert rows(s, f"SELECT -0.0 || '', (0.0 * -1) || '', (c_acctbal * 1) || '', round(c_acctbal) || '', printf('%f', -0.0), printf('%+e', c_acctbal * 1) {at}") == [("0.0", "0.0", "0.0", "0.0", "0.000000", "+0.000000e+00")]
    assert rows(s, f"CREATE TABLE z(x REAL); INSERT INTO z SELECT c_acctbal {at}; SELECT x || '' FROM z") == [("0.0",)]
    assert rows(s, "SELECT printf('%.1f', x) FROM z") == [("0.0",)]


def test_printf_of_a_negative_zero(spark, zeros):
    assert same_as_sql(spark, zeros, "fn_printf")[0][1] == "00001|X           |   -0.00|1"
    show = lambda v, c: "" if v is None else str(v)
    assert rendered("%.1f %+g %d %r", "RrRR", ["-0.0"] * 4, show) == "-0.0 +0 0 0th"


def test_printf_of_reals_with_more_than_15_digits(spark, tmp_path):
    at = [4.0150000000000006, 1.0049999999999999, 2333.3650000000002, -4516.9650000000001, 0.12500000000000003, 123456789012345.67, 9999.99]
    kept = [(i, f"n{i}", 0, x, "X") for i, x in enumerate(at)]
    spark.createDataFrame(kept, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert [p for _, p in same_as_sql(spark, str(tmp_path), "fn_printf")][4] == "00004|X           |    0.13|4"
    # text still has 15 digits, whatever takes the arguments before it
    s = Session(spark).load(str(tmp_path), ["customer"])
    r = "c_acctbal"
    got = rows(s, f"SELECT printf('%.17g cwqs %s|%%|%n%*.*f %s|%-8.3s|%.2f', {r}, {r}, 20, 17, {r}, {r}, {r}, {r}) FROM customer WHERE c_custkey = 4")
    assert got == [("0.12500000000000003 cwqs 0.125|%| 0.12500000000000003 0.125|0.1     |0.13",)]
