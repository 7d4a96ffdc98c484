"""Tables in and out: Parquet entities, JSON bodies, append-only logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.errors import EngineError


def entity(spark: SparkSession, folder: str, name: str, hidden: frozenset[str] = frozenset()) -> DataFrame:
    """An entity's rows. A hidden entity is refused before it is looked for."""
    if name in hidden:
        raise EngineError("entity_hidden", f"{name} is hidden")
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as e:
        raise EngineError("entity_unknown", f"{name} is not an entity") from e


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt out evenly over the cluster. A table of few bytes a row is read by one or two tasks however many rows it has, so
    rows are dealt out before work that costs more than moving them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def kept(df: DataFrame) -> DataFrame:
    """df worked out once: written to the shared folder if the cluster names one, else kept by the tasks' machines."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return df.checkpoint() if shared else df.localCheckpoint()


def json_body(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of a JSON body column: one for each item of its list `value`, or one for a single object.
    A body that is no JSON gives no row. A count that isn't ASCII digits is null."""
    parsed = df.withColumn("__list", F.from_json(column, f"struct<value:array<struct<{schema}>>>")["value"])
    parsed = parsed.withColumn("__one", F.from_json(column, f"struct<{schema}>"))
    empty = F.forall(F.array(*(F.col("__one")[f].isNull() for f in parsed.schema["__one"].dataType.names)), lambda x: x)
    items = F.coalesce(F.col("__list"), F.when(~empty, F.array("__one")))
    count = F.get_json_object(column, "$['odata.count']")
    return parsed.withColumn("item", F.explode(items)).withColumn("total", F.when(count.rlike("^[0-9]+$"), count.cast("bigint"))).drop("__list", "__one")


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log. Spark's committer makes them visible together."""
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str, version: int) -> str:
    """Writes a new version beside the older ones and returns its path: readers never see a half-written table."""
    target = f"{path.rstrip('/')}/v{version:08d}"
    df.write.mode("errorifexists").parquet(target)
    return target
