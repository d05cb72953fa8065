"""Extension points: stages that run around writes and reads, and readers as data sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

HOOKS = ("on_remember", "on_recall", "on_dream")
Stage = Callable[[DataFrame], DataFrame]


class Plugins:
    """Named stages per hook, run in the order they were added.

    A plugin is a function from DataFrame to DataFrame, so it joins the plan and is optimised
    with it.  In an enterprise store no plugin may see contents that are written.
    """

    def __init__(self, enterprise: bool = False) -> None:
        self.enterprise = enterprise
        self.stages: dict[str, list[tuple[str, Stage]]] = {hook: [] for hook in HOOKS}

    def add(self, hook: str, name: str, stage: Stage) -> None:
        if hook not in self.stages:
            raise ValueError(f"no hook {hook}; there are {', '.join(HOOKS)}")
        if self.enterprise and hook == "on_remember":
            raise PermissionError("an enterprise store takes no plugin on contents")
        self.stages[hook].append((name, stage))

    def run(self, hook: str, df: DataFrame) -> DataFrame:
        for _, stage in self.stages[hook]:
            df = stage(df)
        return df


class LinesReader(DataSourceReader):
    """Reads given records of an adapter: one partition for each of its parts."""

    def __init__(self, adapter) -> None:
        self.adapter = adapter

    def partitions(self):
        return self.adapter.parts()

    def read(self, partition) -> Iterator[tuple]:
        yield from self.adapter.load(partition)


def register_adapter(spark: SparkSession, name: str, schema: str, make: Callable[[dict], object]) -> None:
    """Make an adapter readable as ``spark.read.format(name)``.

    ``make`` turns the reader's options into an object with ``parts()``, the input partitions,
    and ``load(part)``, the rows of one.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return LinesReader(make(dict(self.options)))

    spark.dataSource.register(Source)


def edit_lines(text: str, edits: list[tuple]) -> str:
    """Line edits of a text: ``("insert", at, new)``, ``("replace", first, last, new)``,
    ``("delete", first, last)`` by numbers from 1, ``("anchor", old, new)`` where ``old`` occurs
    once.  Out-of-range numbers and other anchors are errors."""
    for kind, *args in edits:
        lines = text.split("\n")
        if kind == "anchor":
            old, new = args
            if text.count(old) != 1:
                raise ValueError(f"anchor occurs {text.count(old)} times")
            text = text.replace(old, new)
            continue
        first = args[0]
        last = args[1] if kind in ("replace", "delete") else first
        if not 1 <= first <= last <= len(lines) + (kind == "insert"):
            raise ValueError(f"lines {first} to {last} of {len(lines)}")
        new = args[-1].split("\n") if kind != "delete" else []
        lines[first - 1 : last if kind != "insert" else first - 1] = new
        text = "\n".join(lines)
    return text
