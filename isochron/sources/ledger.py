"""The rollout ledger as a data source of its own, ``ledger``: appended by many tasks, and what a lost or repeated attempt wrote is never seen.

Each task writes one Parquet file under a name of its own; the driver commits an append by one manifest that names the files and
rows of the attempts that counted. Readers go by manifests alone, one partition for each file. Paths are those of any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


def _manifests(system: fs.FileSystem, root: str) -> list[dict]:
    """Committed appends in order of time."""
    found = system.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    texts = []
    for f in sorted(found, key=lambda f: f.path):
        if f.path.endswith(".json"):
            with system.open_input_stream(f.path) as stream:
                texts.append(json.loads(stream.read()))
    return texts


class LedgerReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        return [InputPartition(name) for m in _manifests(system, root) for name in m["files"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        system, root = fs.FileSystem.from_uri(self.path)
        with pq.ParquetFile(f"{root}/{partition.value}", filesystem=system) as file:
            yield from file.iter_batches(columns=self.names)


class LedgerWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema.json()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        name, rows, out = f"rows-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in batches:
                if out is None:
                    system.create_dir(root)
                    out = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/_commits")
        counted = [m for m in messages if m is not None and m.name]
        text = json.dumps({"schema": self.schema, "files": [m.name for m in counted], "rows": sum(m.rows for m in counted)})
        made = f"{root}/_commits/{time.time_ns():020d}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{made}.tmp") as stream:
            stream.write(text.encode())
        system.move(f"{made}.tmp", f"{made}.json")  # from here on it counts

    def abort(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{root}/{m.name}")


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> StructType:
        """That of the first append; later ones must have the same."""
        found = _manifests(*fs.FileSystem.from_uri(self.options["path"]))
        if not found:
            raise ValueError(f"no ledger at {self.options['path']}")
        return StructType.fromJson(json.loads(found[0]["schema"]))

    def reader(self, schema: StructType) -> LedgerReader:
        return LedgerReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> LedgerWriter:
        if overwrite:
            raise ValueError("a ledger is only appended to")
        found = _manifests(*fs.FileSystem.from_uri(self.options["path"]))
        if found and StructType.fromJson(json.loads(found[0]["schema"])).simpleString() != schema.simpleString():
            raise ValueError("the rows have other columns than the ledger")
        return LedgerWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("ledger")`` and ``df.write.format("ledger").mode("append")`` known."""
    spark.dataSource.register(LedgerSource)
