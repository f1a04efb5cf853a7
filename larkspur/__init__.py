"""A jq-language query engine on Spark."""

from __future__ import annotations

from larkspur.functions.values import dumps, loads


def query(df, text: str, slurp: bool = False, tables: dict | None = None, variables: dict | None = None):
    """Run a query over a DataFrame whose rows are objects.

    Planned as built-in Spark operators where the query has such a form. Otherwise the kernel runs it in Arrow
    batches and the results are JSON texts (in_ord, res_ord, value). Without a plan, an array of all rows is one value of
    one task, and so are tables: only up to WHOLE_BYTES of JSON, counted first; beyond that ``Unsupported`` is raised.
    """
    from larkspur.operators import batches, columns

    try:
        return columns.plan(df, text, slurp, tables, variables)
    except columns.Unsupported as e:
        values = batches.as_json(df)
        if not slurp and not tables:
            return batches.run(values, text, variables).drop("error")
        given = dict(variables or {})
        for name, t in (tables or {}).items():
            given[name] = _held(batches.as_json(t), e)
        if slurp:
            rows = _held(values, e)
            values = df.sparkSession.createDataFrame([(0, dumps(rows))], "in_ord long, value string")
        return batches.run(values, text, given).drop("error")


#: Most bytes of JSON that rows may have to be one value.
WHOLE_BYTES = 64 << 20


def _held(values, why: Exception) -> list:
    """The values as a list, if they are few."""
    from pyspark.sql import functions as F

    size = values.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > WHOLE_BYTES:
        raise type(why)(f"{why}; and {size} bytes are too many for one value") from why
    return [loads(r["value"]) for r in values.orderBy("in_ord").collect()]


def evaluate(text: str, value=None, **variables):
    """The results of a query on one value, in this process."""
    from larkspur.operators.kernel import Program

    return list(Program(text, variables).run(value))
