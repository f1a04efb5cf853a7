"""Readers: files of any format as a DataFrame of values, ready for the kernel.

The result has in_ord (file and place in it), value (JSON text), error (JSON text or null) and path. Line formats
are split by Spark and scale with their size; a file of a document format is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.values import QueryError, dumps, loads, quoted
from larkspur.sources.text import DECODERS, probe

LINES = {"jsonl", "ndjson", "raw"}


def _line_decoder(fmt: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            vs, es = [], []
            for t in b.column(1).to_pylist():
                try:
                    vs.append(quoted(t) if fmt == "raw" else dumps(loads(t)))
                    es.append(None)
                except QueryError as e:
                    vs.append(None)
                    es.append(dumps(e.value))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vs, pa.string()), pa.array(es, pa.string()), b.column(2)], ["in_ord", "value", "error", "path"])

    return run


def _document_decoder(fmt: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                vs, es = [], []
                try:
                    text = bytes(text).decode("utf-8")
                    for v in DECODERS[probe(text) if fmt == "auto" else fmt](text):
                        vs.append(dumps(v))
                        es.append(None)
                except (QueryError, UnicodeDecodeError) as e:
                    vs.append(None)
                    es.append(dumps(str(e)))
                n = len(vs)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(vs, pa.string()), pa.array(es, pa.string()), pa.array([path] * n, pa.string())], ["in_ord", "value", "error", "path"])

    return run


def read(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """in_ord, value, error, path of every value in the files. Values before a decoding error are kept."""
    schema = "in_ord long, value string, error string, path string"
    if fmt != "auto" and fmt not in DECODERS:
        raise ValueError(f"unknown format {fmt}")
    if fmt in LINES:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("in_ord"), "value", F.input_file_name().alias("path"))
        lines = lines.where(F.trim("value") != "") if fmt != "raw" else lines
        return lines.mapInArrow(_line_decoder(fmt), schema)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_document_decoder(fmt), schema)


def null_input(spark: SparkSession) -> DataFrame:
    """The one input null."""
    return spark.range(1).select(F.lit(0).cast("long").alias("in_ord"), F.lit("null").alias("value"))


def slurped(values: DataFrame) -> DataFrame:
    """One value: the array of all values, in order. For inputs that fit one row, as the operation is defined."""
    ordered = F.array_sort(F.collect_list(F.struct("in_ord", "value")))
    return values.agg(F.lit(0).cast("long").alias("in_ord"), F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["value"]), ","), F.lit("]")).alias("value"))


def events(values: DataFrame) -> DataFrame:
    """in_ord, res_ord, value: the [path, leaf] and [path] records of each value."""
    from larkspur.operators.batches import run

    return run(values, "tostream").drop("error")
