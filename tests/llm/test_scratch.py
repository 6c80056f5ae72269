"""Where tables between steps go."""

import pytest

from palimpsest.llm import _scratch


class Session:
    """A session without a shared folder of its own."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        applicationId, master = "app-of-a-test", "local[2]"


class Cluster(Session):
    class sparkContext:
        applicationId, master = "app-of-a-cluster", "spark://host:7077"


def test_a_folder_is_made_only_in_one_process_where_none_is_named(spark):
    assert _scratch.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    first = _scratch.shared_dir(Session)
    assert first.startswith("file://") and _scratch.shared_dir(Session) == first
    with pytest.raises(ValueError):
        _scratch.shared_dir(Cluster)


def test_names_that_are_taken_are_not_used(spark):
    df = spark.createDataFrame([(1, 2)], "RID int, rid_ int")
    assert _scratch.unused(df, "rid", "kept") == ["rid__", "kept"]


def test_kept_tables_lie_in_the_folder(spark):
    kept = _scratch.keep(spark.range(10).repartition(4), "x")
    assert kept.count() == 10 and all(f.startswith(_scratch.shared_dir(spark)) for f in kept.inputFiles())
    dealt, name = _scratch.keep_dealt(spark.range(100).repartition(4, "id"), "id")
    assert dealt.count() == 100 and "Exchange" not in dealt.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {name}")
