"""Source trees as tables: a batch source over a root folder, and a stream of its changes.

Spark's own file listing drops names that begin with "_" or ".", so ``__init__.py`` would vanish; this source lists them.
Folders that are always excluded are pruned while walking, and predicates on path, name and language run before any file is
opened. Reading happens on the executors, one partition per batch of files.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tesserine.config import ALWAYS_EXCLUDED, EXTENSION_TO_LANGUAGE, Config
from tesserine.schema import SOURCE_FILES
from tesserine.sources.ignore import Matcher, load_gitignore

CHANGES = "path string, op string, language string, content string, content_hash string"


def walk(config: Config) -> list[tuple[str, str]]:
    """(relative path, language) of the files that pass all predicates but those on content, in order of path components."""
    ignored, excluded, included = Matcher(load_gitignore(config.root)), Matcher(config.exclude), Matcher(config.include)
    extensions = {e.lower() for e in config.extensions}
    languages = set(config.languages) | ({"javascript"} if "typescript" in config.languages else set())
    found = []
    for folder, folders, names in os.walk(config.root):
        folders[:] = sorted(d for d in folders if d not in ALWAYS_EXCLUDED)
        base = os.path.relpath(folder, config.root).replace(os.sep, "/")
        for name in names:
            rel = name if base == "." else f"{base}/{name}"
            suffix = os.path.splitext(name)[1].lower()
            language = EXTENSION_TO_LANGUAGE.get(suffix)
            if suffix not in extensions or language not in languages or not os.path.isfile(os.path.join(folder, name)):
                continue
            if ignored.match(rel) or excluded.match(rel) or excluded.match(rel + "/"):
                continue
            if config.include and not included.match(rel) and not any(rel.startswith(p.rstrip("/") + "/") for p in config.include):
                continue
            found.append((rel, language))
    return sorted(found, key=lambda x: x[0].split("/"))


def read_text(path: str) -> str | None:
    """Text of a file; None where it cannot be read, has a NUL in its first 2,048 bytes, or is no UTF-8."""
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError:
        return None
    if b"\0" in data[:2048]:
        return None
    try:
        return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


def _config(options: dict) -> Config:
    given = json.loads(options.get("config", "{}"))
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
    return Config(**(given | {"root": options.get("root") or options.get("path") or given.get("root", ".")}))


class _Batch(InputPartition):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class RepositorySource(DataSource):
    """``spark.read.format("repository").option("root", folder)``; option ``config`` takes settings as JSON, ``batch`` files per partition."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SOURCE_FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_config(self.options), int(self.options.get("batch", 200)))


class _Reader(DataSourceReader):
    def __init__(self, config: Config, batch: int) -> None:
        self.config, self.batch = config, batch

    def partitions(self):
        files = walk(self.config)
        return [_Batch(files[i : i + self.batch]) for i in range(0, len(files), self.batch)] or [_Batch([])]

    def read(self, partition):
        for rel, language in partition.files:
            text = read_text(os.path.join(self.config.root, rel))
            if text is not None:
                yield rel, rel.split("/"), os.path.splitext(rel)[1].lower(), language, text, hashlib.sha256(text.encode()).hexdigest(), len(text)


class RepositoryChanges(DataSource):
    """``spark.readStream.format("repository_changes").option("root", folder)``: files written or deleted since the last batch.

    The offset holds the modification time of every file seen, so it is as large as the tree that is watched.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_changes"

    def schema(self) -> str:
        return CHANGES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(_config(self.options))


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, config: Config) -> None:
        self.config = config

    def initialOffset(self) -> dict:
        return {"seen": {}}

    def _now(self) -> dict[str, int]:
        out = {}
        for rel, _ in walk(self.config):
            try:
                out[rel] = os.stat(os.path.join(self.config.root, rel)).st_mtime_ns
            except OSError:
                continue
        return out

    def _rows(self, before: dict, after: dict):
        for rel, stamp in after.items():
            if before.get(rel) != stamp:
                text = read_text(os.path.join(self.config.root, rel))
                if text is not None:
                    yield rel, "write", EXTENSION_TO_LANGUAGE.get(os.path.splitext(rel)[1].lower()), text, hashlib.sha256(text.encode()).hexdigest()
        for rel in before:
            if rel not in after:
                yield rel, "delete", None, None, None

    def read(self, start: dict):
        after = self._now()
        return iter(list(self._rows(start["seen"], after))), {"seen": after}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(list(self._rows(start["seen"], end["seen"])))


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    spark.dataSource.register(RepositorySource)
    spark.dataSource.register(RepositoryChanges)


def scan(spark: SparkSession, config: Config, batch: int = 200) -> DataFrame:
    """The files of a root as a table."""
    register(spark)
    from dataclasses import asdict

    given = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(config).items()}
    return spark.read.format("repository").option("root", config.root).option("config", json.dumps(given)).option("batch", batch).load()
