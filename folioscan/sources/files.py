"""Small files of an index, such as its manifest and lock, on whatever storage the path names."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


class LocalFiles:
    """A folder of this machine, or one that all machines have mounted."""

    def __init__(self, root: str):
        self.root = Path(root.removeprefix("file://"))

    def path(self, name: str = "") -> str:
        return str(self.root / name if name else self.root)

    def make(self) -> None:
        self.root.mkdir(parents=True, exist_ok=True)

    def exists(self, name: str = "") -> bool:
        return (self.root / name).exists()

    def is_folder(self) -> bool:
        return self.root.is_dir()

    def read(self, name: str) -> str:
        return (self.root / name).read_text()

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet; false if it is."""
        try:
            handle = os.open(self.root / name, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as f:
            f.write(text)
        return True

    def replace(self, name: str, text: str) -> None:
        """Write a file; readers see the one before or this one."""
        new = self.root / f"{name}.{uuid.uuid4().hex}"
        new.write_text(text)
        os.replace(new, self.root / name)

    def delete(self, name: str) -> None:
        at = self.root / name
        if at.is_dir():
            shutil.rmtree(at, ignore_errors=True)
        else:
            at.unlink(missing_ok=True)


class HadoopFiles:
    """The same on any file system that Hadoop knows, such as HDFS or an object store."""

    def __init__(self, spark: SparkSession, root: str):
        self._fs_api = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._fs_api.Path(self.path(name))

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def make(self) -> None:
        self._fs.mkdirs(self._at(""))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def is_folder(self) -> bool:
        return self.exists() and self._fs.getFileStatus(self._at("")).isDirectory()

    def read(self, name: str) -> str:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.open(self._at(name))
        except Py4JJavaError as e:
            raise FileNotFoundError(name) if "FileNotFound" in str(e.java_exception) else OSError(str(e.java_exception)) from None
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, over: bool) -> None:
        stream = self._fs.create(self._at(name), over)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            self._write(name, text, False)
        except Py4JJavaError as e:
            if self.exists(name):
                return False
            raise OSError(str(e.java_exception)) from None
        return True

    def replace(self, name: str, text: str) -> None:
        new = f"{name}.{uuid.uuid4().hex}"
        self._write(new, text, False)
        how = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        how[0] = getattr(self._fs_api, "Options$Rename").OVERWRITE
        self._fs_api.FileContext.getFileContext(self._at("").toUri(), self._conf).rename(self._at(new), self._at(name), how)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def files_at(path: str, spark: SparkSession | None = None) -> LocalFiles | HadoopFiles:
    """Files under ``path``: by the operating system where the path has no scheme or that of files, else by Hadoop."""
    if "://" not in path or path.startswith("file://"):
        return LocalFiles(path)
    return HadoopFiles(spark or SparkSession.getActiveSession(), path)
