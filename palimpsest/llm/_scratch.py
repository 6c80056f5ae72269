"""Tables between the jobs of one operator, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, a folder that all machines share.

    Where it is unset and the session is one process (tests), a temporary folder
    of that process; on a cluster an error, as executors couldn't read each other's files.
    """
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = _own[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return found.rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Shuffled partitions that go into one file, one task reading them one after the other; more of them where every core has so many tasks anyway.
PER_FILE, MOST_PER_FILE, TASKS_PER_CORE = 2, 4, 8


def fewer_files(df: DataFrame, partitions: int, per_file: int) -> DataFrame:
    """``df``, which has so many partitions or fewer, with up to ``per_file`` of them in one task, or up to ``MOST_PER_FILE`` where there are many for each core."""
    many = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, min(partitions // per_file, max(many, partitions // MOST_PER_FILE))))


def keep(df: DataFrame, name: str = "t", scan: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running stage only.  The
    folder goes when the application ends.  ``scan``: ``df`` has no shuffle, so
    that its partitions are those of its input, each of them costly.
    """
    spark = df.sparkSession
    if scan:
        df = fewer_files(df, df._jdf.queryExecution().toRdd().getNumPartitions(), 1)
    else:
        df = fewer_files(df, int(spark.conf.get("spark.sql.shuffle.partitions")), PER_FILE)
    path = f"{shared_dir(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_dealt(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """Like ``keep``, in buckets of ``column``: joins on it read the table in place, without a shuffle.

    Meant for the result of a join on ``column``, which is dealt out like that already.

    Returns the table and its name; whoever is done with it drops the name.
    """
    spark = df.sparkSession
    name = f"palimpsest_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(name)
    return spark.table(name), name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python at most ``rows`` at a time; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: Plan nodes that leave rows in the order of what is below, whichever columns are read.
_IN_ORDER = {"Project", "Filter", "SubqueryAlias", "View", "LocalRelation"}


def _is_of_files(node) -> bool:
    """A scan of files; other sources (JDBC and the like) may give rows in another order each time."""
    kind = node.getClass().getSimpleName()
    return kind == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation"


def settled(df: DataFrame) -> DataFrame:
    """``df`` if every scan of it gives the same rows in the same places, else a written copy of it.

    Files that are only projected and filtered are as they should be; a shuffle
    below would deal rows out anew depending on the columns that are asked for.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    todo, fine = [plan], bool(plan.deterministic())
    while todo and fine:
        node = todo.pop()
        children = node.children()
        fine = node.nodeName() in _IN_ORDER or _is_of_files(node)
        todo += [children.apply(i) for i in range(children.size())]
    return df if fine else keep(df, "settled")


def rows_with_id(df: DataFrame, *columns: str) -> DataFrame:
    """``rid``, a number for each input row, and ``columns``.

    The number comes from the partition and the place in it; of a ``settled``
    input every scan gives the same row the same number.
    """
    from pyspark.sql import functions as F

    small_batches(df.sparkSession)
    return df.select(F.monotonically_increasing_id().alias("rid"), *columns)
