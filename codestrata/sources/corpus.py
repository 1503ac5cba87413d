"""Source files as tables, and versioned writes."""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories that no scan enters.
EXCLUDED = (".venv", "venv", "__pycache__", ".git", "node_modules", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".eggs")
#: Directories that a tree is divided into, at least, where it has as many.
SLICES = 256


def source_files(files: DataFrame, exclude_dirs: tuple[str, ...] = EXCLUDED, suffix: str = ".py") -> DataFrame:
    """Rows of a files table (path, ...) whose path ends in suffix and has no excluded component."""
    bad = F.array(*map(F.lit, exclude_dirs))
    return files.filter(F.endswith("path", F.lit(suffix)) & ~F.arrays_overlap(F.split("path", "/"), bad))


class SourceTree(DataSource):
    """Raw source trees by path: a partition for each directory under the root, listed and read by its task; names that begin with _ are kept."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo string, path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.repo = options["path"].rstrip("/"), options.get("repo", "")
        self.excluded = tuple(x for x in options.get("exclude", ",".join(EXCLUDED)).split(",") if x)

    def partitions(self):
        """Directories are opened level by level until there are SLICES of them; those opened are read without what is below."""
        flat, deep = [], [""]
        while deep and len(flat) + len(deep) < SLICES:
            inner = [os.path.join(d, e.name) for d in deep for e in os.scandir(os.path.join(self.root, d)) if e.is_dir(follow_symlinks=False) and e.name not in self.excluded]
            flat, deep = flat + deep, sorted(inner)
        return [InputPartition((d, False)) for d in flat] + [InputPartition((d, True)) for d in deep]

    def read(self, partition):
        top, deep = partition.value
        for folder, dirs, names in os.walk(os.path.join(self.root, top)):
            dirs[:] = sorted(d for d in dirs if deep and d not in self.excluded)
            for n in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, n)
                with open(full, encoding="utf-8", errors="replace") as f:
                    yield self.repo, os.path.relpath(full, self.root), f.read()


def read_tree(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("repo", repo).load(root)


def write_files(files: DataFrame, path: str, version: int, apply: bool = False) -> DataFrame:
    """files as they would be written; with apply, also write them as a new version folder, complete once it has _SUCCESS."""
    if apply:
        files.write.mode("errorifexists").parquet(f"{path}/v={version:08d}")
    return files


def read_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of write_files, by default the last complete one; folders without _SUCCESS (a writer died) are passed over."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in store.listStatus(folder)]
    done = sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and store.exists(hadoop(p, "_SUCCESS")))
    if version is None and not done or version is not None and version not in done:
        raise FileNotFoundError(f"no complete version {'' if version is None else version} under {path}")
    return spark.read.parquet(f"{path}/v={done[-1] if version is None else version:08d}")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
