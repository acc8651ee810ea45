import pytest

from agentmeter.plans import catalog


def test_long_lines_of_parents_are_no_circles():
    """Sessions 7 apart descend from each other where the number is 5 modulo 7, and lead back where it is 3."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.sql(
        """CREATE TABLE conversations AS SELECT c * 7 + g AS conv_id, turn, 'text' AS text,
               CASE WHEN turn = 0 THEN 'user' ELSE 'assistant' END AS role
           FROM range(2100) a(c), (VALUES (3), (5)) b(g), range(2) d(turn)"""
    )
    faults = db.sql(catalog.oracle_sql()["rollout_quality"]).fetchall()
    cyclic = {session for kind, session, *_ in faults if kind == "cyclic_ancestry"}
    assert cyclic == {f"s{c * 7 + 3}" for c in range(2100)}
    inherited = {session: (call_id, other) for kind, session, call_id, other in faults if kind == "inherited_call"}
    assert inherited == {f"s{c * 7 + 5}": ("shared", f"s{c * 7 - 2}") for c in range(1, 2100)}
    assert len(faults) == 2100 + 2099
