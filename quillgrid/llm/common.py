"""Pieces that the training-data operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word of the contracts: a run of anything but ASCII white space.
WORD = "[^\x20\x09-\x0d]+"
words_of = re.compile(WORD).findall
#: Rows of one Arrow batch that are Python objects at the same time.
SLICE = 256


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet, compared without case."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def struct_udf(setup: Callable[[], Callable], fields: list[tuple[str, str]]) -> Callable[..., Column]:
    """A scalar Arrow UDF that returns one struct for each row.

    ``setup`` runs once for each Python task and gives the function that is called for each row, with one
    argument for each column, None for null, and returns a tuple in the order of ``fields``.
    """
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = setup()
        for a in batches:
            out = []
            for i in range(0, len(a), SLICE):
                rows = [one(x) for x in a.slice(i, SLICE).to_pylist()]
                out.append(pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names))
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct(list(zip(names, kinds, strict=True))))

    return F.arrow_udf(run, schema)


#: Rows of one Arrow batch between Spark and Python at most: texts may be long, and a batch stands in memory several times.
BATCH = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH rows; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


def with_struct(df: DataFrame, udf: Callable[..., Column], col: str, name: str) -> DataFrame:
    """``df`` with the struct of ``udf(col)`` as the new column ``name``."""
    bounded_batches(df.sparkSession)
    return df.withColumn(name, udf(F.col(f"`{col}`")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says. Only in local mode, as in tests, a local folder is taken where nothing is set; elsewhere that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if folder is None:
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)


def fold(doc_id: str = "doc_id", n: int = 4) -> Column:
    """crc32 of the id's decimal text, modulo n (null for a null id)."""
    return F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % n
