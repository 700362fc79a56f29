"""``spark.read.format("leafmill")``: decks and Markdown as a data source, a task for some files each.

Options: ``path`` (or ``load(path)``; several as ``paths``, one to a line), ``recursive`` (true), ``files`` (to a task, 16). The folders must be mounted where the driver plans and the executors read; use
``inputs.listing`` with ``pptx.shapes`` for stores that only Spark reaches. Files come in order of their names, each once; a filter on ``suffix`` or ``source`` reaches the reader, so that other files aren't opened.
A file that is missing, of an unknown format or broken is one row with its error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from leafmill.sources import pptx

NAME, FILES = "leafmill", 16
#: Columns before and behind those of a deck's shapes: the file's suffix, and the text of Markdown files.
SCHEMA = f"suffix string, {pptx.SCHEMA}, markdown string"
DECKS, TEXTS = (".pptx",), (".md", ".markdown")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def found(paths: list[str], recursive: bool) -> list[str]:
    """Files of folders that have a known suffix, sorted, and named ones as they are; each once, at its first place."""
    out: dict[str, None] = {}
    for path in paths:
        if not os.path.isdir(path):
            out[path] = None
            continue
        for folder, inner, names in os.walk(path):
            inner.sort()
            out |= {os.path.join(folder, n): None for n in sorted(names) if os.path.splitext(n)[1].lower() in DECKS + TEXTS}
            if not recursive:
                break
    return list(out)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.names = schema.fieldNames()
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split("\n") if p]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.files = max(1, int(options.get("files", FILES)))
        self.wanted: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("suffix",), ("source",)):
                self.wanted.append((f.attribute[0], set(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        own = {"suffix": lambda p: os.path.splitext(p)[1].lower(), "source": lambda p: p}
        paths = [p for p in found(self.paths, self.recursive) if all(own[c](p) in values for c, values in self.wanted)]
        return [Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            suffix = os.path.splitext(path)[1].lower()
            try:
                for row in self.rows(path, suffix):
                    yield tuple(({"suffix": suffix, "source": path} | row).get(n) for n in self.names)
            except Exception as e:
                yield tuple({"suffix": suffix, "source": path, "error": f"{type(e).__name__}: {e}"}.get(n) for n in self.names)

    def rows(self, path: str, suffix: str) -> Iterator[dict]:
        if suffix not in DECKS + TEXTS:
            if not os.path.exists(path):
                raise FileNotFoundError(path)
            raise ValueError(f"unsupported format: {suffix}")
        with open(path, "rb") as f:
            content = f.read()
        if suffix in TEXTS:
            yield {"kind": "markdown", "markdown": content.decode("utf-8-sig")}
            return
        deck = pptx.Deck(content)
        # all rows of a deck before the first goes out, so that a broken one is its error alone
        yield from [{"slide_w": deck.size[0], "slide_h": deck.size[1]} | r for r in deck.rows()]


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters that reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
