"""Sources and sinks: explicit schemas for CSV, Parquet tables, JDBC options, bulk deletes, snapshots.

Defined results: CSV fields that don't parse are null, as are empty ones. A snapshot that breaks a rule isn't there afterwards. Paths that
don't exist are deleted without a word.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators import validation

SERIES_SCHEMA = "date DATE, value DOUBLE"
LABELLED_SCHEMA = "X1 DOUBLE, X2 DOUBLE, y INT"

#: Tables of the blog service.
SCHEMAS = {
    "users": "id INT NOT NULL, username STRING NOT NULL, email STRING NOT NULL, password_hash STRING NOT NULL, image_file STRING",
    "posts": "id INT NOT NULL, title STRING NOT NULL, content STRING NOT NULL, user_id INT NOT NULL, date_posted TIMESTAMP NOT NULL, likes INT NOT NULL",
    "password_reset_tokens": "id INT NOT NULL, user_id INT NOT NULL, token_hash STRING NOT NULL, expires_at TIMESTAMP NOT NULL, created_at TIMESTAMP NOT NULL",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; types are inferred only without a schema, as that reads the file twice."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """A daily series in date order."""
    return read_csv(spark, path, SERIES_SCHEMA).orderBy("date")


#: Environment variables that describe an external store, and the options that they set.
JDBC_ENVIRONMENT = {"DATABASE_URL": "url", "DATABASE_USER": "user", "DATABASE_PASSWORD": "password", "DATABASE_DRIVER": "driver"}


def jdbc_options(environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options of the external store from the environment; a url without a scheme of JDBC gets one."""
    environment = os.environ if environment is None else environment
    found = {option: environment[name] for name, option in JDBC_ENVIRONMENT.items() if environment.get(name)}
    if "url" not in found:
        raise ValueError("DATABASE_URL isn't set")
    if not found["url"].startswith("jdbc:"):
        found["url"] = "jdbc:" + found["url"]
    return found


def read_jdbc(spark: SparkSession, name: str, url: str | None = None, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table of an external store, by default the environment's, read in parallel ranges of a numeric key if one is given."""
    options = ({"url": url} if url else jdbc_options()) | {"dbtable": name}
    if key:
        options |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Empty managed tables; running it again changes nothing."""
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    for name in reversed(list(SCHEMAS)):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The truncated state, children first."""
    return {name: spark.createDataFrame([], SCHEMAS[name]) for name in reversed(list(SCHEMAS))}


def write_snapshot(df: DataFrame, root: str) -> str:
    """Writes a new version of a table beside the old ones and returns its path; nothing that is read is overwritten."""
    path = f"{root}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


#: Keys of the blog service's tables: unique columns (compared in any case), and foreign keys as (column, table, column).
UNIQUE = {"users": ["username", "email"], "posts": [], "password_reset_tokens": ["token_hash"]}
FOREIGN = {"users": [], "posts": [("user_id", "users", "id")], "password_reset_tokens": [("user_id", "users", "id")]}

Rule = Callable[[DataFrame], DataFrame]


class ConstraintError(ValueError):
    """A snapshot broke rules; `broken` names them."""

    def __init__(self, broken: list[str]):
        super().__init__(f"broken: {', '.join(broken)}")
        self.broken = broken


def write_checked(df: DataFrame, root: str, rules: dict[str, Rule]) -> str:
    """Writes a new version, holds each rule against what was written, and takes it back if one returns a row."""
    path = write_snapshot(df, root)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    broken = [name for name, rule in rules.items() if not rule(written).isEmpty()]
    if broken:
        delete_paths(df.sparkSession, [path])
        raise ConstraintError(broken)
    return path


def table_rules(name: str, others: dict[str, DataFrame]) -> dict[str, Rule]:
    """The rules of a table of the blog service: primary key, required and unique columns, and foreign keys into the other tables."""
    required = [c.split()[0] for c in SCHEMAS[name].split(", ") if c.endswith("NOT NULL")]
    rules: dict[str, Rule] = {"required": lambda df: validation.not_null(df, required), "primary key": lambda df: validation.not_unique(df, F.col("id"))}
    for c in UNIQUE[name]:
        rules[f"unique {c}"] = lambda df, c=c: validation.not_unique(df, F.lower(c))
    for fk, parent, pk in FOREIGN[name]:
        rules[f"foreign {fk}"] = lambda df, fk=fk, parent=parent, pk=pk: validation.without_parent(df, fk, others[parent], pk)
    return rules


def truncated(spark: SparkSession, root: str) -> dict[str, str]:
    """Empty snapshots of all tables, children first: the path of each."""
    return {name: write_snapshot(df, f"{root}/{name}") for name, df in empty_tables(spark).items()}


def delete_paths(spark: SparkSession, paths: list[str]) -> int:
    """Bulk delete through Hadoop's file system of each path; the number that was there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done
