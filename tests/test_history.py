"""The paged history: months as partitions, failing months as rows."""

import pytest

from medlattice.sources import history


def write(folder, kind, year, month, text):
    path = folder / f"kind={kind}" / f"year={year}" / f"month={month}"
    path.mkdir(parents=True)
    (path / "part-0.txt").write_bytes(text)


def test_one_bad_month_stops_nothing(spark, tmp_path):
    write(tmp_path, "a", 2020, 1, b'{"aaData": [{"k": "1"}, 7, {"k": "2"}]}')
    write(tmp_path, "a", 2020, 12, b"\xff\xfe not text")
    write(tmp_path, "a", 2021, 2, b'{"other": []}')
    write(tmp_path, "b", 2020, 1, b'{"aaData": []}')
    write(tmp_path, "b", 2020, 3, b"")
    (tmp_path / "kind=b" / "year=2020" / "month=3" / "_SUCCESS").write_bytes(b"")
    months = history.answers(spark, str(tmp_path), ["a", "b"])
    assert months.rdd.getNumPartitions() == 5
    got = sorted(((r.kind, r.year, r.month, (r.record or {}).get("k"), (r.error or "").split(":")[0]) for r in history.records(months).collect()), key=str)
    shape = "unexpected shape"
    assert got == sorted([("a", 2020, 1, "1", ""), ("a", 2020, 1, "2", ""), ("a", 2020, 12, None, "UnicodeDecodeError"), ("a", 2021, 2, None, shape), ("b", 2020, 3, None, shape)], key=str)


def test_unknown_kinds_and_other_clients(spark, tmp_path):
    with pytest.raises(Exception, match="kind=none"):
        history.answers(spark, str(tmp_path), ["none"]).collect()
    (tmp_path / "kind=empty").mkdir()
    assert history.answers(spark, str(tmp_path), ["empty"]).count() == 0
    write(tmp_path, "a", 2020, 1, b"{}")
    with pytest.raises(Exception, match="no_such_client"):
        history.answers(spark, str(tmp_path), ["a"], "no_such_client:ask").collect()
