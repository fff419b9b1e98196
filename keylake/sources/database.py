"""Database tables by any DB-API module: a reader by pages of the key, and a writer that merges by key in place.

    spark.dataSource.register(KeyedTable)
    spark.read.format("keyed_table").schema(...).options(module="sqlite3", database="...", table="t", key="id").load()
    df.write.format("keyed_table").mode("append").options(...).save()

Options that are not named here are arguments of the module's connect(), timeout and port as numbers. A read deals ranges of the key to `parts` tasks
(by its least and largest value), and each goes through its range in pages of `page` rows, from the last key on, so that no
cursor stays open and a task that is tried again begins at its range. A write stages each task attempt's rows under a name
of its own; once all tasks are done, the rows of those attempts that Spark counts are merged in one transaction: those
with new keys are inserted, others replace the row of their key. Attempts that were lost leave nothing behind.

Rows with null key are neither read nor written. Of rows of one write with equal keys any one stays. The key is a whole number.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

OWN = ("module", "table", "key", "parts", "page", "mark", "path")
NUMBERS = ("timeout", "port")


def connect(options: dict[str, str]):
    given = {k: int(v) if k in NUMBERS else v for k, v in options.items() if k not in OWN}
    return importlib.import_module(options["module"]).connect(**given)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Range(InputPartition):
    """Keys above `after`, up to `last`."""

    after: int
    last: int


class _Pages(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.options = [f.name for f in schema.fields], options
        self.mark, self.page = options.get("mark", "?"), int(options.get("page", 10_000))

    def partitions(self) -> list[Range]:
        key, table = quoted(self.options["key"]), quoted(self.options["table"])
        with closing(connect(self.options)) as db, closing(db.cursor()) as cursor:
            cursor.execute(f"SELECT min({key}), max({key}) FROM {table}")
            low, high = cursor.fetchone()
        if low is None:
            return [Range(0, 0)]
        parts = max(1, min(int(self.options.get("parts", 8)), high - low + 1))
        bounds = [low - 1 + (high - low + 1) * k // parts for k in range(parts + 1)]
        return [Range(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        key, names = quoted(self.options["key"]), ", ".join(map(quoted, self.columns))
        sql = f"SELECT {names}, {key} FROM {quoted(self.options['table'])} WHERE {key} > {self.mark} AND {key} <= {self.mark} ORDER BY {key} LIMIT {self.page}"
        after = partition.after
        with closing(connect(self.options)) as db:
            while True:
                with closing(db.cursor()) as cursor:
                    cursor.execute(sql, (after, partition.last))
                    rows = cursor.fetchall()
                for *row, after in rows:
                    yield tuple(row)
                if len(rows) < self.page:
                    return


@dataclass
class Staged(WriterCommitMessage):
    attempt: str


class _Merge(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.options, self.mark = [f.name for f in schema.fields], options, options.get("mark", "?")
        self.place = self.columns.index(options["key"])
        self.stage = f"{options['table']}_stage_{uuid.uuid4().hex}"
        names = ", ".join(map(quoted, self.columns))
        with closing(connect(options)) as db:
            db.cursor().execute(f"CREATE TABLE {quoted(self.stage)} AS SELECT {names}, '' AS attempt FROM {quoted(options['table'])} WHERE 1 = 0")
            db.commit()

    def write(self, iterator: Iterator) -> Staged:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        sql = f"INSERT INTO {quoted(self.stage)} VALUES ({', '.join([self.mark] * (len(self.columns) + 1))})"
        page, rows = int(self.options.get("page", 10_000)), []

        def put() -> None:  # a page is one short transaction, so that tasks wait little for each other
            with closing(connect(self.options)) as db:
                db.cursor().executemany(sql, rows)
                db.commit()
            rows.clear()

        for row in iterator:
            if row[self.place] is not None:
                rows.append((*row, attempt))
                if len(rows) >= page:
                    put()
        if rows:
            put()
        return Staged(attempt)

    def commit(self, messages: list) -> None:
        table, stage, key = quoted(self.options["table"]), quoted(self.stage), quoted(self.options["key"])
        names = ", ".join(map(quoted, self.columns))
        others = [quoted(c) for c in self.columns if c != self.options["key"]]
        change = f"DO UPDATE SET {', '.join(f'{c} = excluded.{c}' for c in others)}" if others else "DO NOTHING"
        with closing(connect(self.options)) as db:
            cursor = db.cursor()
            for m in messages:
                cursor.execute(f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} WHERE attempt = {self.mark} ON CONFLICT ({key}) {change}", (m.attempt,))
            cursor.execute(f"DROP TABLE {stage}")
            db.commit()

    def abort(self, messages: list) -> None:
        with closing(connect(self.options)) as db:
            db.cursor().execute(f"DROP TABLE IF EXISTS {quoted(self.stage)}")
            db.commit()


class KeyedTable(DataSource):
    """A table with a unique whole-number key."""

    @classmethod
    def name(cls) -> str:
        return "keyed_table"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a keyed table is merged into; use mode append")
        return _Merge(schema, dict(self.options))
