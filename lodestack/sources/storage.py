"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all run on this machine, else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        told = getattr(spark, "_engine_dir", None)
        if told is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            told = spark._engine_dir = "file://" + tempfile.mkdtemp(prefix="engine-")
    return told.rstrip("/") + "/engine"


class Folder:
    """A folder on whatever store Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, under: str) -> list[str]:
        at = self._path(f"{self.root}/{under}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, under: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{under}"))

    def delete(self, under: str) -> bool:
        return self._fs.delete(self._path(f"{self.root}/{under}"), True)

    def publish(self, draft: str, place: str) -> bool:
        """Moves a folder or file to a place that doesn't exist yet; False if it does."""
        to = self._path(f"{self.root}/{place}")
        self._fs.mkdirs(to.getParent())
        return not self._fs.exists(to) and self._fs.rename(self._path(f"{self.root}/{draft}"), to)

    def age_s(self, under: str) -> float:
        """Seconds since a file was last written."""
        return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/{under}")).getModificationTime() / 1000

    def _fresh(self, under: str, text: str = "") -> bool:
        """Writes a file in place; False if it exists."""
        at = self._path(f"{self.root}/{under}")
        self._fs.mkdirs(at.getParent())
        try:
            out = self._fs.create(at, False)
        except Exception:
            if self._fs.exists(at):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def create(self, under: str, text: str, claim_s: float = 600) -> bool:
        """Writes a small file that must not exist, seen whole or not at all; False if it exists or another writer is about to write
        it. The place is claimed by an exclusive marker and the text renamed into place; a claim of a writer that died holds
        for claim_s seconds."""
        claim, draft = f"claims/{under}", f"drafts/{uuid.uuid4().hex}"
        if self.exists(under):
            return False
        if not self._fresh(claim):
            if self.exists(claim) and self.age_s(claim) <= claim_s:
                return False
            self.delete(claim)
            if not self._fresh(claim):
                return False
        try:
            self._fresh(draft, text)
            return self.publish(draft, under)
        finally:
            self.delete(draft)
            self.delete(claim)

    def read(self, under: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{under}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
