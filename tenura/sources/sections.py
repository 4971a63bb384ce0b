"""A Spark data sink for the sections of a document: JSON lines, committed in two phases.

Tasks write files of their own into a folder that nobody reads. When all of them are done, the driver renames the folder
and then replaces the section's small manifest, which names the files that count, in one step. An aborted write removes
its folder; attempts that were repeated leave files that no manifest names. A later write of a section replaces it.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .session import ship


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    rows: int


def value(v: object) -> object:
    if isinstance(v, Row):
        return {k: value(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [value(x) for x in v]
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    return float(v) if isinstance(v, Decimal) else v


class SectionSink(DataSource):
    """Options: path, a folder that all machines share under that name, and section."""

    @classmethod
    def name(cls) -> str:
        return "tenura_sections"

    def writer(self, schema, overwrite: bool) -> SectionWriter:  # noqa: ANN001
        return SectionWriter(self.options["path"], self.options["section"])


class SectionWriter(DataSourceWriter):
    def __init__(self, path: str, section: str):
        self.path, self.section, self.token = path, section, uuid.uuid4().hex
        self.staged, self.final = f"{path}/.{section}-{self.token}", f"{path}/{section}-{self.token}"
        os.makedirs(self.staged, exist_ok=True)  # tasks make no folder, so none comes back after an abort

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        part = context.partitionId()
        name, n = f"part-{part:05d}-{context.taskAttemptId()}.json", 0
        with open(f"{self.staged}/{name}", "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(json.dumps({k: value(v) for k, v in row.asDict().items()}, ensure_ascii=False) + "\n")
                n += 1
        return Written(part, name, n)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.part)
        os.rename(self.staged, self.final)
        before = manifest(self.path, self.section)
        with open(f"{self.final}/manifest", "w", encoding="utf-8") as f:
            json.dump({"folder": os.path.basename(self.final), "files": [m.file for m in done], "rows": sum(m.rows for m in done)}, f)
        os.replace(f"{self.final}/manifest", f"{self.path}/{self.section}.json")
        if before:
            shutil.rmtree(f"{self.path}/{before['folder']}", ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        gone = f"{self.staged}-aborted"
        os.rename(self.staged, gone)  # tasks that still run find no folder to write to
        shutil.rmtree(gone, ignore_errors=True)


def manifest(path: str, section: str) -> dict | None:
    """What was committed last of a section: its folder, files and rows; None if nothing was."""
    try:
        with open(f"{path}/{section}.json", encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def write_section(df: DataFrame, path: str, section: str) -> None:
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(SectionSink)
    df.write.format("tenura_sections").option("path", path).option("section", section).mode("append").save()


def read_section(path: str, section: str) -> list[dict]:
    """The committed rows of a section, in the order of the DataFrame that was written."""
    found = manifest(path, section) or {"files": []}
    out = []
    for name in found["files"]:
        with open(f"{path}/{found['folder']}/{name}", encoding="utf-8") as f:
            out += [json.loads(line) for line in f]
    return out
