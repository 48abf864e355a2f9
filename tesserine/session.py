"""Session helpers: reading tables, cutting lineage in the shared folder, mapping rows in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit the engine; a session that has them set otherwise keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def session(app: str = "tesserine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use "_" for "."."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, else a new one for local runs.

    A machine-local folder is taken only where the master is local; on a cluster the setting is required.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tesserine-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, f: Callable[[Iterator[dict]], Iterable[tuple]], schema: str, columns: list[str] | None = None) -> DataFrame:
    """Apply ``f`` to the rows of a partition, in Arrow batches; ``f`` gets an iterator of dicts and yields tuples.

    Only ``columns`` reach Python. Results are sent on in batches of 2,048 rows, so memory follows the batch, not the partition.
    """
    source = df.select(*columns) if columns else df
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches):
        import pyarrow as pa

        def rows() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from batch.slice(at, 256).to_pylist()

        def emit(held: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], type=field.type) for i, field in enumerate(arrow)], schema=arrow)

        held: list[tuple] = []
        for row in f(rows()):
            held.append(row)
            if len(held) >= 2048:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    return source.mapInArrow(run, parsed)

