"""Shared pieces of the training-data operators: the shared work folder and Arrow row mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataforge.sources.work import shared_folder, work_path

#: A word by ASCII white space, as Java and Python regular expressions spell it.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables written by stored() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        root = shared_folder(spark).removeprefix("file://")
        parents = {f.rpartition("/")[0] for f in df.inputFiles()}
        for parent in parents:
            if root not in parent:
                raise ValueError(f"{parent} is outside the shared folder")
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[tuple]], schema: T.StructType, rows: int = 2048) -> DataFrame:
    """mapInArrow over dict-like rows; output goes out in batches of `rows`, so memory stays bounded."""
    names = df.columns
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for b in batches:
                cols = [b.column(i) for i in range(b.num_columns)]
                for i in range(b.num_rows):
                    yield {n: c[i].as_py() for n, c in zip(names, cols, strict=True)}

        held: list[tuple] = []
        for row in fn(each()):
            held.append(row)
            if len(held) >= rows:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def struct(text: str) -> T.StructType:
    """A schema from DDL, e.g. 'doc_id long, n_words long'."""
    return T._parse_datatype_string(text) if hasattr(T, "_parse_datatype_string") and SparkSession.getActiveSession() else T.StructType.fromDDL(text)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (string) alone: other columns, whatever their names, are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_keys(text: Column) -> list[Column]:
    """k1 and k2: 128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame, *but: str) -> list[Column]:
    """df's columns (but for some), whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in but]


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on find this package where the driver found it, unless they are told otherwise already."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
