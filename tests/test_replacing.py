"""A table that is replaced stays readable whatever happens to the write."""

import os

import pytest

from armlift.sources import experiment_table, replacing


def values(spark, path):
    return sorted(r.id for r in experiment_table.read_experiment(spark, path).collect())


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    experiment_table.write_experiment(spark.range(5), path)
    # some tasks write their files, one of them fails half way
    failing = spark.range(0, 1000, 1, 4).selectExpr("if(id = 999, raise_error('stop'), id) as id")
    with pytest.raises(Exception, match="stop"):
        experiment_table.write_experiment(failing, path)
    assert values(spark, path) == [0, 1, 2, 3, 4] and os.listdir(tmp_path) == ["table"]


def test_a_table_can_be_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "table")
    experiment_table.write_experiment(spark.range(5), path)
    experiment_table.write_experiment(experiment_table.read_experiment(spark, path).selectExpr("id + 10 as id"), path)
    assert values(spark, path) == [10, 11, 12, 13, 14] and os.listdir(tmp_path) == ["table"]


def test_a_run_that_ends_between_the_renames_is_mended(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    experiment_table.write_experiment(spark.range(3), path)
    whole, calls = replacing.renamed, []

    def stops(fs, source, target):
        calls.append(source)
        if len(calls) == 2:
            raise KeyboardInterrupt
        whole(fs, source, target)

    monkeypatch.setattr(replacing, "renamed", stops)
    with pytest.raises(KeyboardInterrupt):
        experiment_table.write_experiment(spark.range(9), path)
    monkeypatch.setattr(replacing, "renamed", whole)
    assert not os.path.exists(path) and values(spark, path) == [0, 1, 2]
    experiment_table.write_experiment(spark.range(2), path)
    assert values(spark, path) == [0, 1]
