"""A Spark data source over SQLite files, with column pruning and range partitions on rowid."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .session import ship

#: Spark passes filters on to Python data sources only with this on.
PUSHDOWN = ("spark.sql.python.filterPushdown.enabled", "true")
#: Filters that mean the same in SQLite, as SQL with the column in place of {}.
COMPARED = {ds.EqualTo: "{} = ?", ds.EqualNullSafe: "{} IS ?", ds.GreaterThan: "{} > ?", ds.GreaterThanOrEqual: "{} >= ?", ds.LessThan: "{} < ?", ds.LessThanOrEqual: "{} <= ?", ds.StringContains: "instr({}, ?) > 0"}
KINDS = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "BLOB": "binary"}


class RowidRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """Options: path, table, partitions (4). Without a schema that of the table is taken, and `seq` (the rowid) is added."""

    @classmethod
    def name(cls) -> str:
        return "tenura_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            rows = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        return ", ".join([f"`{r[1]}` {KINDS.get((r[2] or '').upper(), 'string')}" for r in rows] + ["seq bigint"])

    def reader(self, schema) -> SqliteReader:  # noqa: ANN001
        # a column whose values SQLite may keep in another type than Spark reads is not compared there
        exact = {f.name for f in schema.fields if f.dataType.typeName() in ("long", "string")}
        return SqliteReader(self.options, schema.names, exact)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str], exact: set[str]):
        self.path, self.table, self.n = options["path"], options["table"], int(options.get("partitions", 4))
        self.columns, self.exact = columns, exact
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        """Takes over the filters that SQLite can apply; gives back the others, which stay Spark's."""
        for f in filters:
            made = self.condition(f)
            if made:
                self.where.append(made)
            else:
                yield f

    def condition(self, f: ds.Filter) -> tuple[str, list] | None:
        if isinstance(f, ds.Not):
            inner = self.condition(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        if len(f.attribute) != 1 or f.attribute[0] not in self.exact:
            return None
        column = self.named(f.attribute[0])
        if isinstance(f, (ds.IsNull, ds.IsNotNull)):
            return f"{column} IS {'NOT ' * isinstance(f, ds.IsNotNull)}NULL", []
        values = list(f.value) if isinstance(f, ds.In) else [f.value]
        if not all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in values):
            return None
        if isinstance(f, ds.In):
            return f"{column} IN ({', '.join('?' * len(values))})", values
        if isinstance(f, ds.StringStartsWith):
            return f"substr({column}, 1, ?) = ?", [len(f.value), f.value]
        return (COMPARED[type(f)].format(column), values) if type(f) in COMPARED else None

    def named(self, column: str) -> str:
        return "rowid" if column == "seq" else quoted(column)

    def partitions(self) -> list[RowidRange]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [RowidRange(0, 0)]
        step = -(-(high - low + 1) // self.n)
        return [RowidRange(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: RowidRange) -> Iterator[tuple]:
        wanted = ", ".join(map(self.named, self.columns))
        where = " AND ".join(["rowid >= ? AND rowid < ?", *(f"({sql})" for sql, _ in self.where)])
        values = [partition.low, partition.high, *(v for _, vs in self.where for v in vs)]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(f"SELECT {wanted} FROM {quoted(self.table)} WHERE {where} ORDER BY rowid", values)


def read_sqlite(spark: SparkSession, path: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of a table; with `columns` (a prune list) only those and `seq` are read. The file must be readable by every executor.

    Comparisons with whole numbers and texts are SQLite's work, for which the session's PUSHDOWN is turned on.
    """
    ship(spark)
    spark.conf.set(*PUSHDOWN)
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("tenura_sqlite").option("path", path).option("table", table)
    if columns:
        full = dict(x.rsplit(" ", 1) for x in SqliteSource({"path": path, "table": table}).schema().split(", "))
        reader = reader.schema(", ".join(f"`{c}` {full[f'`{c}`'] if c != 'seq' else 'bigint'}" for c in [*columns, "seq"]))
    return reader.load()


JOB_COLUMNS = ["run_id", "title", "company", "url", "category", "seniority", "sector", "remote", "skills", "description"]


def read_panel(spark: SparkSession, path: str, kind: str = "sqlite") -> tuple[DataFrame, DataFrame]:
    """(scrape_runs, jobs with seq) from a SQLite file or from a folder with a Parquet table of each."""
    if kind == "sqlite":
        return read_sqlite(spark, path, "scrape_runs", ["id", "run_date"]), read_sqlite(spark, path, "jobs", JOB_COLUMNS)
    return spark.read.parquet(f"{path}/scrape_runs.parquet"), spark.read.parquet(f"{path}/jobs.parquet")
