"""Registry of the library's queries: a callable each and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer partitions than the cluster has cores are dealt out first.

    Tokenising is the costly part, and a table of one row group would do it in one task. A large
    table has many partitions as it is, and is read without a shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() < 2 * cores:
        return df.repartition(cores)
    return df


#: SQL pieces shared by the oracles.
def norm_sql(col: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({col}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def words_sql(rel: str, key: str, col: str = "text") -> str:
    """key, w: the array of normalised words."""
    return f"SELECT {key}, list_filter(string_split({norm_sql(col)}, ' '), lambda x: x <> '') AS w FROM {rel}"


def tokens_sql(rel: str, key: str, col: str = "text") -> str:
    return f"SELECT {key}, k - 1 AS pos, w[k] AS tok FROM (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS k FROM ({words_sql(rel, key, col)}))"


def grams_sql(rel: str, key: str, n: int) -> str:
    return (
        f"SELECT {key}, k - 1 AS pos, {n} AS n, array_to_string(w[k : k + {n - 1}], ' ') AS gram "
        f"FROM (SELECT {key}, w, unnest(range(1, len(w) - {n} + 2)) AS k FROM ({words_sql(rel, key)}) WHERE len(w) >= {n})"
    )
