"""Intermediate tables."""

import os

import pytest

from tessera.operators import storage


def test_tables_are_read_back_and_removed(spark):
    table = storage.materialize(spark.range(5), "five")
    folder = next(f for f in storage._written if os.path.isdir(f"{f}/five"))
    assert table.count() == 5 and storage.release([folder]) == 1
    assert not os.path.exists(folder) and folder not in storage._written


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "none"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())
