"""Every operator of the list has its query; the guard of the entry point must not hide a broken one."""

import __spark_entry__ as entry


def test_all_operators_are_registered():
    names = set(entry.queries())
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1, n
    assert "pipeline" in names
    for n in (1, 5, 6, 10, 11):
        assert any(q.startswith(f"op{n}_") for q in entry.oracle_sql()), n
