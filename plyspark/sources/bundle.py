"""A bundle: a folder of Parquet tables with a JSON manifest.

Tables are never written over.  A change writes new versions beside the old ones, and one atomic
replacement of the manifest makes them current; readers at work keep theirs.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..operators.search import clustered
from ..schemas import SCHEMA_VERSION, TABLES, SchemaMismatch, migrated
from .pgn import open_path

MANIFEST = "manifest.json"


class Bundle:
    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str = "games") -> Bundle:
        fs, inner = open_path(path)
        if fs.get_file_info(f"{inner}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise FileExistsError(path)
        fs.create_dir(inner, recursive=True)
        made = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        bundle = cls(spark, path, {"name": name, "schema_version": SCHEMA_VERSION, "game_count": 0, "created_at": made, "position_index_dirty": False, "tables": {}, "next_ids": {}})
        bundle._save()
        return bundle

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Bundle:
        fs, inner = open_path(path)
        with fs.open_input_stream(f"{inner}/{MANIFEST}") as f:
            manifest = json.loads(f.read())
        if manifest["schema_version"] > SCHEMA_VERSION:
            raise SchemaMismatch(f"schema version {manifest['schema_version']} is newer than {SCHEMA_VERSION}")
        return cls(spark, path, manifest)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, name: str = "games") -> Bundle:
        try:
            return cls.create(spark, path, name)
        except FileExistsError:
            return cls.open(spark, path)

    def _save(self) -> None:
        fs, inner = open_path(self.path)
        new = f"{inner}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as f:
            f.write(json.dumps(self.manifest, indent=1).encode())
        fs.move(new, f"{inner}/{MANIFEST}")

    def table(self, name: str) -> DataFrame:
        schema = TABLES[name]
        versions = self.manifest["tables"].get(name, [])
        if not versions:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.parquet(*[f"{self.path}/{v}" for v in versions])
        return migrated(df, self.manifest["schema_version"]) if name == "game" else df

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, **fields) -> None:
        """Writes tables and makes them, and the manifest's fields, current in one step."""
        tables = {k: list(v) for k, v in self.manifest["tables"].items()}
        for name, df in (append or {}).items():
            tables[name] = [*tables.get(name, []), self._write(name, df)]
        for name, df in (replace or {}).items():
            tables[name] = [self._write(name, df)]
        self.manifest = self.manifest | {"tables": tables} | fields
        self._save()

    def _write(self, name: str, df: DataFrame) -> str:
        version = f"{name}/{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        df = df.select(*columns)
        # Positions are clustered by hash in small row groups, for scans that ask for one hash.
        writer = clustered(df).write.option("parquet.block.size", 16 << 20) if name == "position" else df.write
        writer.parquet(f"{self.path}/{version}")
        return version
