"""The kernel over DataFrames: any query, on JSON text, in Arrow batches.

Each input row is one value; its results are rows (in_ord, res_ord, value). A value is JSON text, so key order
and the spelling of numbers are kept. ``sort_key`` gives bytes that sort, group and join as the language
orders and equates values.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.values import QueryError, dumps, kind, loads, sorted_keys
from larkspur.operators.kernel import Program


def encode_key(v) -> bytes:
    """Bytes in the total order of values: equal values have equal keys."""
    k = kind(v)
    if k == "null":
        return b"\x01"
    if k == "boolean":
        return b"\x03" if v else b"\x02"
    if k == "number":
        x = float(v) + 0.0
        if math.isnan(x):
            return b"\x04" + bytes(8)
        (bits,) = struct.unpack(">Q", struct.pack(">d", x if x else 0.0))
        return b"\x04" + struct.pack(">Q", bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63)
    if k == "string":
        return b"\x05" + v.encode("utf-8", "surrogatepass").replace(b"\x00", b"\x00\xff") + b"\x00\x00"
    if k == "array":
        return b"\x06" + b"".join(map(encode_key, v)) + b"\x00"
    keys = sorted_keys(v)
    return b"\x07" + b"".join(map(encode_key, keys)) + b"\x00" + b"".join(encode_key(v[x]) for x in keys) + b"\x00"


def sort_key(value: Column) -> Column:
    """The key of a column of JSON texts, as binary."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def key(s):
        return s.map(lambda t: None if t is None else encode_key(loads(t)))

    return key(value)


def as_json(df: DataFrame) -> DataFrame:
    """in_ord, value: each row as the JSON text of an object."""
    plain = []
    for f in df.schema:
        t, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if t in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif t == "decimal":
            c = c.cast("double")
        plain.append(c.alias(f.name))
    return df.select(F.monotonically_increasing_id().alias("in_ord"), F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("value"))


def run(values: DataFrame, query: str, variables: dict | None = None, errors: str = "raise") -> DataFrame:
    """in_ord, res_ord, value, error: the results of a query on each JSON text.

    values: in_ord (long) and value (JSON text; a null text is the value null). errors: ``raise``, or ``keep``,
    where a row that fails gives the results it had and one row with the error's JSON.
    """
    program = Program(query, variables)

    def batch(it):
        import pyarrow as pa

        for b in it:
            rows = []
            for o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                i = 0
                try:
                    for i, v in enumerate(program.run(None if t is None else loads(t)), 1):
                        rows.append((o, i - 1, dumps(v), None))
                except QueryError as e:
                    if errors == "raise":
                        raise
                    rows.append((o, i, None, dumps(e.value)))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["in_ord", "res_ord", "value", "error"])

    return values.select("in_ord", "value").mapInArrow(batch, "in_ord long, res_ord long, value string, error string")
