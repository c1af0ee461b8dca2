import pytest

from quern.plans.ddl import Statement, StatementError, parse


def test_create():
    s = parse("create oindex if not exists i on db.t (a, b desc, `c d` asc) using bitmap partition (k = 1, p='x y');")
    assert s == Statement("create", "i", "db.t", (("a", True), ("b", False), ("c d", True)), "BITMAP", {"k": "1", "p": "x y"}, True)
    assert parse("CREATE SINDEX i ON t (a)") == Statement("create", "i", "t", (("a", True),))


def test_others():
    assert parse("DROP OINDEX IF EXISTS i ON t PARTITION (d=2020-01-01)") == Statement("drop", "i", "t", partition={"d": "2020-01-01"}, lenient=True)
    assert parse("refresh sindex on `my t`") == Statement("refresh", None, "my t")
    assert parse("SHOW OINDEX IN t") == parse("show oindex from t") == Statement("show", None, "t")
    assert parse("CHECK OINDEX ON t PARTITION (k=1)").partition == {"k": "1"}
    assert parse("DISABLE OINDEX i") == Statement("disable", "i") and parse("ENABLE OINDEX i").kind == "enable"


@pytest.mark.parametrize("sql", ["SELECT 1", "CREATE TABLE t (a int)", "SHOW TABLES", "-- CREATE OINDEX", "DROP TABLE oindex", ""])
def test_other_statements_are_not_ours(sql):
    assert parse(sql) is None


@pytest.mark.parametrize(
    "sql",
    ["CREATE OINDEX i ON t", "CREATE OINDEX i ON t (a) USING HASH", "CREATE OINDEX i ON t (a) extra", "REFRESH OINDEX t", "SHOW OINDEX t", "DROP OINDEX i ON t PARTITION (a=1, a=2)", "DROP OINDEX i ON t PARTITION (a=)", "CREATE OINDEX i ON t (a"],
)
def test_errors(sql):
    with pytest.raises(StatementError):
        parse(sql)
