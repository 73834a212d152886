"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to Python at once.  Texts may be long, so far fewer than Spark's default of 10,000.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that go to Python workers; a value set by the user stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset (tests on one machine) a temporary folder is taken and set for the
    context, so that later calls find the same one.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage and outlives a lost executor."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def texts(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """The named columns and the text, null as empty."""
    return docs.select(*more, F.coalesce(F.col(text), F.lit("")).alias("text"))


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | Iterable[dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """Apply fn to the columns of each Arrow batch (as lists), return the columns it makes."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            for o in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([pa.array(o[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, st)


_holder: list = [None]


def claim(table) -> None:
    """Word tables of a Python worker take turns: the one in use clears the one before it.

    Workers are reused by stage after stage; without this their tables would add up.
    """
    if _holder[0] is not table:
        if _holder[0] is not None:
            _holder[0].clear()
            trim()
        _holder[0] = table


def trim() -> None:
    """Free memory goes back to the system, where the C library can do that."""
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


@contextlib.contextmanager
def threads(on: bool) -> Iterator[None]:
    """Lets the tokenizer library use its threads; otherwise a Python worker keeps to its own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if on else "false"
    try:
        yield
    finally:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """One tokenizer per Python worker; a bare file name is looked up among the public ones."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t
