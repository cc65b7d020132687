"""A folder of small JSON records and of tables, on a local path or on any file system that Hadoop reaches."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


class Folder:
    """Records are replaced whole: a reader sees the old one or the new one. On a cluster a ``file:`` folder is taken to be one that is mounted everywhere."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.uri = spark, root.rstrip("/")
        scheme, _, rest = root.partition("://")
        cluster = not spark.sparkContext.master.startswith("local")
        if cluster and ":" not in root.split("/")[0]:
            raise ValueError("on a cluster the folder must be one that all executors share: give it with its scheme")
        self.local = None if cluster or rest and scheme != "file" else Path(rest if scheme == "file" else root[5:] if root.startswith("file:") else root)
        if self.local is not None:
            self.local.mkdir(parents=True, exist_ok=True)
        else:
            jvm = spark.sparkContext._jvm
            self._fs = jvm.org.apache.hadoop.fs
            self._context = self._fs.FileContext.getFileContext(jvm.java.net.URI(self.uri), spark.sparkContext._jsc.hadoopConfiguration())
            self._context.mkdir(self._path(""), self._fs.permission.FsPermission.getDirDefault(), True)

    def _path(self, name: str):
        return self._fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def at(self, *names: str) -> str:
        """The path of a table, for Spark."""
        return "/".join([str(self.local) if self.local is not None else self.uri, *names])

    def exists(self, name: str) -> bool:
        return (self.local / name).exists() if self.local is not None else self._context.util().exists(self._path(name))

    def folders(self) -> list[str]:
        if self.local is not None:
            return sorted(p.name for p in self.local.iterdir() if p.is_dir())
        return sorted(s.getPath().getName() for s in self._context.util().listStatus(self._path("")) if s.isDirectory())

    def delete(self, name: str) -> None:
        if self.local is not None:
            path = self.local / name
            shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
        elif self.exists(name):
            self._context.delete(self._path(name), True)

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        if self.local is not None:
            return json.loads((self.local / name).read_text())
        stream = self._context.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        text, part = json.dumps(value, allow_nan=False), f"{name}.{uuid.uuid4().hex}"
        if self.local is not None:
            with (self.local / part).open("w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.replace(self.local / part, self.local / name)
            return
        jvm = self.spark.sparkContext._jvm
        flags = jvm.java.util.EnumSet.of(self._fs.CreateFlag.CREATE, self._fs.CreateFlag.OVERWRITE)
        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.CreateOpts, 0)
        stream = self._context.create(self._path(part), flags, none)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        over = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 1)
        over[0] = getattr(self._fs, "Options$Rename").OVERWRITE
        self._context.rename(self._path(part), self._path(name), over)
