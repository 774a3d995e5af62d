"""Where intermediate tables go, and how whole documents pass through Arrow."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.text import blocks


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset,
    as in tests on one machine, a temporary folder becomes the checkpoint folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ravelin-"))  # the setting itself can't be changed in a running session
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once a context, so that they need no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_ravelin_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="ravelin-code-")) / "ravelin.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._ravelin_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it again: lineage ends here, a lost executor
    costs nothing that came before, and the shuffle files of what came before can go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets the context cleaner drop the shuffle files of unreachable plans
    return spark.read.schema(df.schema).parquet(path)


_models: dict[str, dict] = {}


def models(of: str) -> dict:
    """What operator `of` keeps in this worker between tasks, by key. What others kept goes: a worker has one operator's models."""
    for k in [k for k in _models if k != of]:
        del _models[k]
    return _models.setdefault(of, {})


def release(of: str = "") -> None:
    """Drop other operators' models, and give memory that Arrow and the C library hold but don't use back to the system:
    workers outlive their tasks."""
    models(of)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], dict], schema: str, block: int = 1 << 20, of: str = "") -> DataFrame:
    """fn over blocks of whole rows with about `block` bytes of text each. Rows keep their
    partitions, nothing is shuffled, and memory follows the block and the longest text. of: the operator whose models() fn uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(of)
        for batch in batches:
            for part in blocks(batch, block):
                got = fn(part)
                if got:
                    yield pa.RecordBatch.from_pydict(got)
        release(of)

    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def remainder(doc_id: str, n: int):
    """crc32 of the id as text, modulo n. A null id has remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def first_of_each(rows: DataFrame, by: str, n: int, salt: str) -> DataFrame:
    """The n rows (doc_id, by) of each of the few values of by that come first by a hash of doc_id, ties by doc_id.

    The hash is cut so that about 2n rows a value are ranked at all; where chance leaves fewer than n, all of that value are.
    """
    h = F.xxhash64("doc_id", F.lit(salt))
    sizes = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    some = rows.withColumn("h", h)

    def below(value, share: float):
        return (F.col(by) == F.lit(value)) & (F.col("h") <= F.lit(int(-(2**63) + min(share, 1.0) * (2**64 - 1024))).cast("long")) if share < 1 else F.col(by) == F.lit(value)

    wanted = {v: (2.0 * n + 100) / c for v, c in sizes.items()}
    pick = F.lit(False)
    for v, share in wanted.items():
        pick = pick | below(v, share)
    got = {r[by]: r["count"] for r in some.filter(pick).groupBy(by).count().collect()}
    pick = F.lit(False)
    for v, share in wanted.items():
        pick = pick | below(v, share if got.get(v, 0) >= n else 1.0)
    order = Window.partitionBy(by).orderBy("h", "doc_id")
    return some.filter(pick).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).select("doc_id", by)
