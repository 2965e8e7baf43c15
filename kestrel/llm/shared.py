"""What the corpus operators share: the shared folder, word rules and packed rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters, in every operator.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a new folder of its own; on a cluster it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="kestrel-")
    return _own[key]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/kestrel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Delete all tables and models that this session's operators wrote to the shared folder.

    Results that weren't written elsewhere can't be read afterwards. Says whether there was anything.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kestrel/{context.applicationId}")
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The column of numbered().
ROW = "__kestrel_row"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df plus ROW, a number of each row, written once: rows that repeat, or have no id, can be told apart by it."""
    return keep(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def chosen(docs: DataFrame, marks: DataFrame, by: str) -> DataFrame:
    """The rows of docs whose value of `by` marks have, null as a value."""
    name = fresh(docs, by)
    wanted = marks.select(F.col(by).alias(name))
    return docs.join(wanted, F.col(by).eqNullSafe(F.col(name)), "left_semi")


def fresh(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Tasks that rows of one group are spread over when they get what their group came to.
SALTS = 32


def hand_back(rows: DataFrame, groups: DataFrame, keys: list[str], row: str) -> DataFrame:
    """rows with the other columns of groups (one row for each of keys), where a group may hold a large share of the rows.

    Rows are salted by their number `row`. A group's row is copied to those salts only that its rows have, found by an
    aggregate that combines before the shuffle, so a small group costs one row and a large one SALTS.
    """
    salted = rows.withColumn("__kestrel_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
    spread = salted.groupBy(*keys, "__kestrel_salt").agg(F.lit(1).alias("__kestrel_one")).drop("__kestrel_one")
    return salted.join(spread.join(groups, keys), [*keys, "__kestrel_salt"]).drop("__kestrel_salt")


def running(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """df plus before_X for X of sums: the sum of X over the rows before, in an order without ties that matter.

    Rows are range-partitioned and written once; totals of the partitions give offsets, and running sums go on inside.
    """
    part = "__kestrel_part"
    dealt_ = keep(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)
    totals = dealt_.groupBy(part).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = totals.select(part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__kestrel_{c}") for c in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt_.join(F.broadcast(offsets), part)
    out = placed.withColumns(
        {f"before_{c}": F.col(f"__kestrel_{c}") + F.sum(c).over(inside) - F.col(c) for c in sums}
    )
    return out.drop(part, *[f"__kestrel_{c}" for c in sums])


def dealt(rows: DataFrame, again=None, tasks: int | None = None) -> DataFrame:
    """Rows (lane, sub, ...): those of a lane in one task, in the order of subs. `again` splits lanes into subs first.

    Lanes go to `tasks` tasks, or to as many as the session shuffles to.
    """
    out = rows.repartition(tasks, "lane") if tasks else rows.repartition("lane")
    if again is not None:
        out = out.mapInArrow(again, rows.schema)
    return out.sortWithinPartitions("lane", "sub")


def lane_tasks(spark: SparkSession, lanes: int) -> int:
    """Tasks for so many lanes, a few lanes each: they grow with the lanes whatever the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), lanes // 4)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, by one scan; sizes the partitions of what follows."""
    return df.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()["n"] or 0


def parts(total: int, each: int) -> int:
    return max(1, -(-total // each))
