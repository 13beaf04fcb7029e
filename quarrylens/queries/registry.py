"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import quoted, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one directory by attribute: ``t.orders``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    def pick(self, name: str, *columns: str) -> DataFrame:
        """Some columns of a table."""
        return getattr(self, name).select(*columns)

    def sql(self, text: str, *names: str) -> DataFrame:
        """Run SQL text whose tables are written as {name}."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


# A hair more than rounding noise: keeps decimals that end in 5 off the rounding edge.
NUDGE = 1.000000000001


def significant(column, digits: int):
    """Round a double to ``digits`` decimals of its scientific form."""
    text = F.format_string(f"%.{digits}e", column * F.lit(NUDGE))
    return F.when(column.isNotNull(), text.cast("double"))


def query(name: str, sql: str | None = None, approx: str = "", digits: int = 9):
    """Register a function of ``Tables``.

    ``approx`` names the floating columns that both sides round to the same number
    of significant digits, since the order of a distributed sum is not fixed.
    """

    def register(function):
        columns = approx.split()

        def run(spark: SparkSession, directory: str) -> DataFrame:
            out = function(Tables(spark, directory))
            return out.withColumns(
                {c: significant(quoted(c).cast("double"), digits) for c in columns}
            ) if columns else out

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if columns:
                replaced = ", ".join(
                    f"CAST(printf('%.{digits}e', CAST(\"{c}\" AS DOUBLE) * CAST({NUDGE} AS DOUBLE)) AS DOUBLE) AS \"{c}\"" for c in columns
                )
                text = f"SELECT * REPLACE ({replaced}) FROM (\n{text}\n) AS result"
            ORACLES[name] = text
        return function

    return register


def per_column(columns, template: str, source: str) -> str:
    """UNION ALL of ``template`` over columns; ``{c}`` is the column, ``{i}`` its position."""
    return "\nUNION ALL ".join(
        template.replace("{c}", c).replace("{i}", str(i)) + f" FROM {source}" for i, c in enumerate(columns)
    )
