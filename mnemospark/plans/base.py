"""Registration of queries beside their SQL, and tables and fixtures for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name; sql: the same for DuckDB."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Derived:
    """A table made from the given ones: as a DataFrame, and as SQL for a WITH clause."""

    def __init__(self, name: str, sql: str, build):
        self.name, self.body, self.df = name, sql, build

    @property
    def sql(self) -> str:
        return f"{self.name} AS ({self.body})"


def shared(name: str, source: str, /, **columns: str) -> Derived:
    """A table made of a given one by expressions that both dialects read."""
    body = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"
    return Derived(name, body, lambda spark, sf: table(spark, sf, source).selectExpr(*(f"{e} AS {c}" for c, e in columns.items())))


class Fixture:
    """A few literal rows as a DataFrame and as a VALUES clause."""

    def __init__(self, name: str, ddl: str, rows: list[tuple]):
        self.name, self.ddl, self.rows = name, ddl, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    @property
    def sql(self) -> str:
        """``name AS (SELECT ... FROM (VALUES ...))`` for a WITH clause, with the columns' types."""
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}
        cols = [c.strip().split(" ", 1) for c in self.ddl.split(",")]

        def literal(v):
            if v is None:
                return "NULL"
            if isinstance(v, list):
                return "[" + ", ".join(map(literal, v)) + "]"
            if isinstance(v, (bool, int, float)):
                return str(v)
            return "'" + str(v).replace("'", "''") + "'"

        body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f'CAST("{n}" AS {kinds[k]}) AS "{n}"' for n, k in cols)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {body}) AS v({', '.join(chr(34) + n + chr(34) for n, _ in cols)}))"
