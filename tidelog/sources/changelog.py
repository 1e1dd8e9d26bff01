"""A streaming source of committed changes: `spark.readStream.format("changelog").option("path", root)`.

Offsets are store versions. Each batch reads exactly the files that the commits in between appended to
`changes`, one task for each file; a version or file that retention or an erasure has removed meanwhile
is an error, never a silent gap. A fresh stream over such a log starts from a snapshot and `startingVersion`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schema import LOG_TABLES


class _File(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.first = int(options.get("startingversion", options.get("startingVersion", 0)))

    def initialOffset(self) -> dict:
        return {"version": self.first}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, base = _open(self.root)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{base}/manifest")) if f.base_name.endswith(".json")]
        return {"version": max((int(n[:-5]) for n in names if n[:-5].isdigit()), default=self.first)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _open(self.root)
        out: list[InputPartition] = []
        for version in range(start["version"] + 1, end["version"] + 1):
            try:
                with store.open_input_file(f"{base}/manifest/{version}.json") as f:
                    appended = json.loads(f.read()).get("appended", {}).get("changes", [])
            except FileNotFoundError as gone:
                raise FileNotFoundError(f"version {version} has been trimmed; start again from a snapshot, with startingVersion {end['version']}") from gone
            for path in appended:
                folder = _open(path)[1]
                infos = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                if not infos:
                    raise FileNotFoundError(f"changes of version {version} have been trimmed; start again from a snapshot")
                out += [_File(i.path) for i in infos if i.base_name.endswith(".parquet")]
        return out

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow.parquet as pq

        store, _ = _open(self.root)
        names = [column.split()[0] for column in LOG_TABLES["changes"].split(", ")]
        with store.open_input_file(partition.uri) as f:
            yield from pq.ParquetFile(f).iter_batches(columns=names)

    def commit(self, end: dict) -> None:
        pass


class ChangelogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return LOG_TABLES["changes"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))
