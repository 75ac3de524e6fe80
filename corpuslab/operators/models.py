"""Batch hooks for models that live outside Spark: scorers, encoders, generators.

``load`` runs once per task on the worker and returns a function from column lists to a
list of results, so weights are never shipped with rows and ids travel with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StringType, StructField, StructType

Load = Callable[[], Callable[..., Sequence]]


def apply_model(
    df: DataFrame, load: Load, inputs: Sequence[str], out: str, kind: DataType, batch: int = 32,
) -> DataFrame:
    """Add ``out`` = model(inputs) to every row, ``batch`` rows per call."""
    schema = StructType([*df.schema.fields, StructField(out, kind)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rows in batches:
            table = pa.Table.from_batches([rows])
            results: list = []
            for part in table.select(list(inputs)).to_batches(max_chunksize=batch):
                results += list(model(*[c.to_pylist() for c in part.columns]))
            yield from table.append_column(out, pa.array(results, arrow)).to_batches()

    return df.mapInArrow(run, schema)


def model_scorer(load: Load, batch: int = 32) -> Callable[[DataFrame], DataFrame]:
    """A scorer out of a model's ``(contexts, continuations) -> log probabilities``."""
    return lambda requests: apply_model(
        requests, load, ["context", "continuation"], "score", DoubleType(), batch)


def encode_sentences(df: DataFrame, load: Load, text: str = "text", batch: int = 32) -> DataFrame:
    """Add ``vector`` from a model's ``(sentences) -> vectors``."""
    return apply_model(df, load, [text], "vector", ArrayType(FloatType()), batch)


def generate_answers(df: DataFrame, load: Load, prompt: str = "prompt", batch: int = 8) -> DataFrame:
    """Add ``completion`` from a model's ``(prompts) -> texts``."""
    return apply_model(df, load, [prompt], "completion", StringType(), batch)
