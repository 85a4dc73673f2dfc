"""Small files and folders of the file systems that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """Marks and folders below a path, through Spark's own Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What is in a folder, sorted; nothing where there is none."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def create(self, name: str, text: str) -> None:
        """A new small file that appears whole; an error if another writer was first."""
        self._fs.mkdirs(self._path(name).getParent())
        draft = f"{name}.{self.spark.sparkContext.applicationId}.draft"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name) or not self._fs.rename(self._path(draft), self._path(name)):
            self.delete(draft)
            raise FileExistsError(f"{self.path}/{name} is there already")

    def read(self, name: str) -> str:
        source = self._fs.open(self._path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def rename(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._path(to).getParent())
        if self.exists(to) or not self._fs.rename(self._path(name), self._path(to)):
            raise FileExistsError(f"{self.path}/{to} is there already")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)
