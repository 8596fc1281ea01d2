"""Snapshots: reused while inputs and parameters are the same, never read half-written."""

import dataclasses
import os

import pytest

from funnelwise.sources import snapshots as S
from funnelwise.sources.loader import read_shop_tables, write_shop_tables
from tests.shopgen import random_shop, to_spark


@pytest.fixture
def stored(spark, tmp_path):
    shop = str(tmp_path / "shop")
    write_shop_tables(to_spark(spark, random_shop(3, 40)), shop, files=2)
    return lambda: dataclasses.replace(read_shop_tables(spark, shop), scratch=str(tmp_path / "scratch")), shop, str(tmp_path / "scratch")


def counting(t, log):
    def build():
        log.append(1)
        return t.sessions.groupBy("device_type").count()
    return build


def test_reused_by_another_tables_object(spark, stored):
    tables, _, scratch = stored
    a, b, log = tables(), tables(), []
    first = a.temporary_table("by_device", ("x",), counting(a, log))
    again = a.temporary_table("by_device", ("x",), counting(a, log))
    later = b.temporary_table("by_device", ("x",), counting(b, log))  # as in a later application
    assert len(log) == 1 and first is again
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, later.collect()))
    assert len(os.listdir(f"{scratch}/by_device")) == 1


def test_changed_inputs_or_parameters_give_a_new_copy(spark, stored):
    tables, shop, scratch = stored
    a, log = tables(), []
    before = a.temporary_table("by_device", ("x",), counting(a, log)).agg({"count": "sum"}).first()[0]
    other = tables()
    other.temporary_table("by_device", ("y",), counting(other, log))
    assert len(log) == 2
    spark.read.parquet(f"{shop}/website_sessions").limit(5).write.mode("append").parquet(f"{shop}/website_sessions")
    changed = tables()
    after = changed.temporary_table("by_device", ("x",), counting(changed, log)).agg({"count": "sum"}).first()[0]
    assert len(log) == 3 and after == before + 5
    keep = S.snapshot_key("by_device", ("x",), S.fingerprint(changed.as_dict()))
    assert S.drop_others(spark, scratch, "by_device", keep) == 2
    assert os.listdir(f"{scratch}/by_device") == [keep]


def test_a_half_written_copy_is_never_read(spark, stored):
    tables, _, scratch = stored
    a, log = tables(), []
    home = f"{scratch}/by_device/{S.snapshot_key('by_device', ('x',), S.fingerprint(a.as_dict()))}"
    spark.range(3).write.parquet(f"{home}/0000")  # an application that was lost before its mark
    assert S.complete_copies(spark, home) == []
    got = a.temporary_table("by_device", ("x",), counting(a, log))
    assert got.columns == ["device_type", "count"] and len(log) == 1
    assert len(S.complete_copies(spark, home)) == 1
    assert S.drop_others(spark, scratch, "by_device", os.path.basename(home)) == 1
    assert len(os.listdir(home)) == 1


def test_two_tables_with_one_folder_keep_apart(spark, stored, tmp_path):
    tables, _, scratch = stored
    a, log = tables(), []
    second = str(tmp_path / "second")
    write_shop_tables(to_spark(spark, random_shop(4, 60)), second, files=2)
    b = dataclasses.replace(read_shop_tables(spark, second), scratch=scratch)
    x = a.temporary_table("by_device", (), counting(a, log)).agg({"count": "sum"}).first()[0]
    y = b.temporary_table("by_device", (), counting(b, log)).agg({"count": "sum"}).first()[0]
    assert (x, y) == (a.sessions.count(), b.sessions.count()) and x != y


def test_tables_without_files(spark, tmp_path):
    t = dataclasses.replace(to_spark(spark, random_shop(3, 20)), scratch=str(tmp_path))
    assert S.fingerprint(t.as_dict()) is None
    log = []
    assert t.temporary_table("n", (), counting(t, log)).count() == t.temporary_table("n", (), counting(t, log)).count()
    assert len(log) == 1
    u = dataclasses.replace(t)
    u.temporary_table("n", (), counting(u, log))
    assert len(log) == 2
