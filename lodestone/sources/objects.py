"""Objects under (bucket, key) in any store that Hadoop's file systems reach."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_BAD = re.compile(r'[<>:"\\|?*\x00-\x1f]')


def checked_location(bucket: str, key: str) -> str:
    """``bucket/key`` if both are relative and without reserved characters or ``..``."""
    for what, value, deep in (("bucket", bucket, False), ("key", key, True)):
        parts = value.split("/") if value else [""]
        if not deep and len(parts) > 1 or any(p in ("", ".", "..") for p in parts) or _BAD.search(value):
            raise ValueError(f"not a valid {what}: {value!r}")
    return f"{bucket}/{key}"


class ObjectStorage:
    """put (never overwrites), get, exists, delete. The scheme of ``root`` picks the store."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, bucket: str, key: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{checked_location(bucket, key)}")
        return path.getFileSystem(self._conf), path

    def path(self, bucket: str, key: str) -> str:
        """Where Spark's readers find the object."""
        return f"{self.root}/{checked_location(bucket, key)}"

    def put(self, bucket: str, key: str, data: bytes) -> None:
        """Written aside and renamed, so a reader never sees a part; an object that exists raises."""
        fs, path = self._at(bucket, key)
        if fs.exists(path):
            raise FileExistsError(f"{bucket}/{key}")
        aside = path.suffix(".writing")
        try:
            out = fs.create(aside, False)
            out.write(bytearray(data))
            out.hsync()
            out.close()
            if not fs.rename(aside, path):
                raise FileExistsError(f"{bucket}/{key}")
        except Exception:
            fs.delete(aside, False)
            raise

    def get(self, bucket: str, key: str) -> bytes:
        fs, path = self._at(bucket, key)
        if not fs.exists(path):
            raise FileNotFoundError(f"{bucket}/{key}")
        source = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def exists(self, bucket: str, key: str) -> bool:
        fs, path = self._at(bucket, key)
        return fs.exists(path)

    def delete(self, bucket: str, key: str) -> bool:
        """Also removes folders that become empty."""
        fs, path = self._at(bucket, key)
        done = fs.delete(path, False)
        root, up = self._jvm.org.apache.hadoop.fs.Path(self.root), path.getParent()
        while done and up.toUri().getPath() != root.toUri().getPath() and fs.exists(up) and not fs.listStatus(up):
            fs.delete(up, False)
            up = up.getParent()
        return done
