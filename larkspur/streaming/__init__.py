"""Queries over Structured Streaming sources: results row by row, and keyed running folds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.values import dumps, loads
from larkspur.operators.kernel import Program


def run(stream: DataFrame, query: str, value: str = "value") -> DataFrame:
    """The results of a query on each JSON text of a stream, as a stream of JSON texts."""
    program = Program(query)

    def batch(it):
        import pyarrow as pa

        for b in it:
            out = [dumps(v) for t in b.column(0).to_pylist() for v in program.run(None if t is None else loads(t))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return stream.select(F.col(value)).mapInArrow(batch, "value string")


def fold(stream: DataFrame, key: str, init: str, step: str, value: str = "value") -> DataFrame:
    """foreach over each key's values as they arrive: key, value (the new state) for every input.

    step sees the state as ``.`` and the input as ``$x``. The state is JSON text in Spark's state store.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    first = dumps(next(Program(init).run(None)))
    # the input travels with the state, as the program's variables are fixed when it is compiled
    program = Program(f".[1] as $x | .[0] | {step}")

    def update(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = loads(state.get[0] if state.exists else first)
        out = []
        for f in frames:
            for t in f["value"]:
                held = next(program.run([held, loads(t)]), None)
                out.append((k[0], dumps(held)))
        state.update((dumps(held),))
        yield pd.DataFrame(out, columns=["key", "value"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, value string", "state string", "append", GroupStateTimeout.NoTimeout)
