"""Session helpers: the test session, the shared checkpoint folder, cutting lineage."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches, with a checkpoint folder of its own unless `conf` names one."""
    conf = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-checkpoint-")} | conf
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("arrayloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary folder; a
    cluster is refused, as its executors don't share such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return _own_roots[app]


def tree_fan(spark: SparkSession) -> int:
    """Groups of tasks whose partial results are merged first: about the root of the number of tasks, so that neither
    step of the merge meets more than about as many partial results."""
    return max(32, 3 * math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))


def tree_blocks(spark: SparkSession) -> int:
    """Blocks of keys that the last step of such a merge handles side by side: at least one for each reduce task."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage and keep partitions and their order as they are (needed where rows of a
    partition are addressed by its number). Eager; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by drop_written or at the end of the session."""
    path = f"{shared_folder(spark)}/arrayloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def write_through(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing a table into the shared folder and reading it again.
    Its size is known afterwards, so Spark decides on a broadcast from a measured size."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arrayloom_path = path
    return out


def forget(written: DataFrame) -> None:
    """Delete a table of write_through that nothing reads any more, such as the last round's in a loop."""
    path = getattr(written, "_arrayloom_path", None)
    entry = (written.sparkSession, path)
    if entry in _written:
        _written.remove(entry)
        _delete(*entry)


def drop_written(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables that write_through made for this session, but for the newest `keep`."""
    mine = [x for x in _written if x[0] is spark]
    for entry in mine[: len(mine) - keep]:
        _delete(*entry)
        _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
