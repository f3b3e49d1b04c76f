"""A Python data source that lists what lies directly below a root: containers, shares, buckets."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ContainerSource(DataSource):
    """spark.read.format("containers").load(root): (name, kind, n_entries, owner), one task per container.

    The root is any address that Arrow's file systems know, such as file:///data or s3://bucket."""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return "name string, kind string, n_entries int, owner string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.owner = options["path"], options.get("owner")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def partitions(self):
        from pyarrow import fs

        f, p = self._open()
        found = sorted(f.get_file_info(fs.FileSelector(p)), key=lambda i: i.path)
        return [InputPartition((i.path, i.base_name, i.is_file)) for i in found] or [InputPartition(None)]

    def read(self, partition):
        from pyarrow import fs

        if partition.value is None:
            return
        path, name, is_file = partition.value
        f, _ = self._open()
        yield name, "file" if is_file else "container", 0 if is_file else len(f.get_file_info(fs.FileSelector(path))), self.owner
