"""TextGrids as a data source: ``spark.read.format("textgrid").load(folder)``.

    register(spark)
    spark.read.format("textgrid").option("files_a_partition", 100).load("/corpus").where("tier = 'ann - words'")

Files are found by pyarrow's file systems, so any store that these reach will do; each partition reads a share of them. Equality with a path or tier is
pushed down: other files aren't opened, other tiers aren't turned into rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..session import ship_package
from .files import parse_textgrid

SCHEMA = "path string, tier string, begin double, end double, label string, error string"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TextGridReader(DataSourceReader):
    def __init__(self, root: str, files_a_partition: int):
        self.root, self.size = root, files_a_partition
        self.wanted: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes path = x and tier = x (one of each); others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("path",), ("tier",)) and f.attribute[0] not in self.wanted and isinstance(f.value, str):
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(x.path for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".textgrid"))
        paths = [p for p in paths if self.wanted.get("path", p) == p]
        return [Files(paths[k : k + self.size]) for k in range(0, len(paths), self.size)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        tier = self.wanted.get("tier")
        for path in partition.paths:
            try:
                with store.open_input_stream(path) as f:
                    rows = parse_textgrid(f.read().decode("utf-8-sig"))
            except UnicodeDecodeError:
                rows = None
                error = "not UTF-8"
            except (ValueError, IndexError, TypeError, AttributeError):
                rows = None
                error = "not a TextGrid"
            if rows is None:
                if tier is None:
                    yield path, None, None, None, None, error
                continue
            yield from ((path, *row, None) for row in rows if tier is None or row[0] == tier)


class TextGridSource(DataSource):
    """Options: path, files_a_partition (64). A file that can't be read gives one row with its error, unless a tier is asked for."""

    @classmethod
    def name(cls) -> str:
        return "textgrid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TextGridReader:
        return TextGridReader(self.options["path"], int(self.options.get("files_a_partition", 64)))


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters pushed down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextGridSource)
