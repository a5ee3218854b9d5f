import os

import pytest

from codeweft import staging


def test_folders_come_and_go(spark):
    folder = staging.shared_folder(spark).removeprefix("file://")
    one = staging.staged(spark.range(10), "one")
    two = staging.staged(one.selectExpr("id + 1 AS id"), "two", instead_of=one)
    kept = staging.keep(staging.staged(two, "kept"))
    assert sorted(r.id for r in two.collect()) == [*range(1, 11)] and not os.path.exists(one._codeweft_path.removeprefix("file://"))
    there = {n for n in os.listdir(folder) if n.startswith(("codeweft-two", "codeweft-kept"))}
    assert len(there) == 2 and staging.sweep(spark) >= 1
    assert [n for n in there if os.path.exists(f"{folder}/{n}")] == [os.path.basename(kept._codeweft_path)]
    staging._remove(spark, kept._codeweft_path)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError):
        staging.shared_folder(Session())
