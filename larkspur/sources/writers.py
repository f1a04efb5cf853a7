"""Writers of results: JSON texts in a DataFrame to files of any format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.values import loads
from larkspur.sources.text import ENCODERS

#: Formats in which files may be cut anywhere between results.
PIECES = {"json", "jsonl", "json-seq", "toon-seq", "raw"}


def write(results: DataFrame, path: str, fmt: str = "jsonl", order: tuple[str, ...] = (), **options) -> None:
    """Write the ``value`` column. Framed formats are written by all tasks; the others are one document, by one task.

    order: columns to sort by first; the order of files is that of the sort. options: indent, sort_keys, ascii
    (json); end (raw).
    """
    if fmt not in ENCODERS:
        raise ValueError(f"unknown format {fmt}")
    one = fmt not in PIECES
    df = results.orderBy(*order) if order else results
    df = df.select("value").coalesce(1) if one else df.select("value")

    def run(batches):
        import pyarrow as pa

        if one:
            values = [loads(t) for b in batches for t in b.column(0).to_pylist()]
            texts = [ENCODERS[fmt](values, **options)] if values else []
            yield pa.RecordBatch.from_arrays([pa.array([t.removesuffix("\n") for t in texts], pa.string())], ["value"])
            return
        for b in batches:
            texts = [ENCODERS[fmt]([loads(t)], **options).removesuffix("\n") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    df.mapInArrow(run, "value string").write.text(path)


def single(results: DataFrame):
    """The one result; raises if there is none or more than one."""
    got = results.select("value").limit(2).collect()
    if len(got) != 1:
        raise ValueError("exactly one result is needed")
    return loads(got[0][0])


def exit_status(results: DataFrame) -> int:
    """0, or 1 if the last result is false or null, or 4 without results."""
    last = results.orderBy(F.col("in_ord").desc(), F.col("res_ord").desc()).select("value").first()
    return 4 if last is None else int(last[0] in ("false", "null"))
