"""Shared-folder staging and snapshot stores.

Everything written here goes to the folder named by ``spark.checkpoint.dir``, which all executors of a
cluster see, so work that is staged survives the loss of an executor. Only a local master without that
setting (tests) gets a temporary folder.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged data: ``spark.checkpoint.dir``, or a temporary one on a local master."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, folder, True)
        _LOCAL[sc.applicationId] = f"file://{folder}"
    return _LOCAL[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove what this application has staged. Results that still read it must have been made before."""
    delete(spark, f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, feeds several consumers."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


class SnapshotStore:
    """Named components made of Parquet folders, all replaced together by one manifest.

    A manifest is ``{"version": n, "parts": {component: {part: {"dir": ..., stats}}}, "meta": {...}}``.
    Writers put new folders beside the old ones and then publish the next manifest by a rename, so a
    reader sees either the state before a batch or the state after it, and a writer that dies between
    leaves the former. Folders that no manifest names any more can be removed by :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = self._latest()

    def _latest(self) -> dict:
        names = [n for n in children(self.spark, f"{self.path}/manifest") if n.endswith(".json") and n[0].isdigit()]
        if not names:
            return {"version": 0, "parts": {}, "meta": {}}
        p, fs = _fs(self.spark, f"{self.path}/manifest/{names[-1]}")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def parts(self, component: str) -> dict[str, dict]:
        return self.manifest["parts"].get(component, {})

    def next_dir(self, component: str) -> str:
        return f"{self.path}/{component}/v{self.version + 1:08d}-{uuid.uuid4().hex[:8]}"

    def read(self, component: str, schema: T.StructType, parts: list[str] | None = None) -> DataFrame:
        have = self.parts(component)
        dirs = [have[k]["dir"] for k in (have if parts is None else parts)]
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*dirs)

    def commit(self, parts: dict[str, dict[str, dict]], meta: dict | None = None) -> None:
        """Publish the next version. ``parts`` names each changed component's complete set of parts."""
        new = {
            "version": self.version + 1,
            "parts": {**self.manifest["parts"], **parts},
            "meta": {**self.manifest["meta"], **(meta or {})},
        }
        target = f"{self.path}/manifest/{new['version']:010d}.json"
        tmp, fs = _fs(self.spark, f"{target}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        final, _ = _fs(self.spark, target)
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise RuntimeError(f"version {new['version']} was published by another writer")
        self.manifest = new

    def vacuum(self) -> None:
        """Remove folders that the current manifest doesn't name."""
        keep = {d["dir"] for c in self.manifest["parts"].values() for d in c.values()}
        for component in self.manifest["parts"]:
            for name in children(self.spark, f"{self.path}/{component}"):
                folder = f"{self.path}/{component}/{name}"
                if not any(k == folder or k.startswith(folder + "/") for k in keep):
                    delete(self.spark, folder)
