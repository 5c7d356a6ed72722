"""Tables that change by whole commits.

A table is a folder of data folders that are written once, and of numbered manifests
that name those which count.  The manifest is written last, under a temporary name, and
then renamed: readers see all of a commit or nothing, and what an interrupted run left
behind is in no manifest.
"""

import json
import uuid

from pyspark.sql import functions as F

_MANIFESTS = "_manifests"


def file_system(spark, path):
    """The file system a path belongs to."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def hadoop_path(spark, path):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _versions(spark, path):
    """Numbers of the committed manifests, the last one first."""
    folder = hadoop_path(spark, f"{path}/{_MANIFESTS}")
    fs = file_system(spark, path)
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)


def read_manifest(spark, path):
    """(version, content) of the last commit; (-1, {}) before the first."""
    versions = _versions(spark, path)
    if not versions:
        return -1, {}
    stream = file_system(spark, path).open(hadoop_path(spark, f"{path}/{_MANIFESTS}/{versions[0]:020d}.json"))
    try:
        return versions[0], json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_manifest(spark, path, version, content):
    """Commit ``content`` as ``version``; False if another writer has that version already."""
    fs = file_system(spark, path)
    made = hadoop_path(spark, f"{path}/{_MANIFESTS}/{uuid.uuid4().hex}.tmp")
    target = hadoop_path(spark, f"{path}/{_MANIFESTS}/{version:020d}.json")
    stream = fs.create(made)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    if not fs.exists(target) and fs.rename(made, target):
        return True
    fs.delete(made, False)
    return False


def new_folder(kind):
    return f"{kind}-{uuid.uuid4().hex}"


class KeyedTable:
    """The latest row per key of a table that grows by numbered batches.

    A batch is one folder; after ``compact_every`` of them the latest rows go into one
    snapshot, so that reading takes one snapshot and a bounded number of newer batches.
    A batch number that is committed already is not written again.
    """

    def __init__(self, spark, path, schema, keys, order, compact_every=20):
        self.spark, self.path, self.schema, self.keys, self.order, self.compact_every = spark, path.rstrip("/"), schema, list(keys), order, compact_every

    def latest(self, rows):
        """The row with the greatest ``order`` of each key; combines before the shuffle."""
        values = [c for c in rows.columns if c not in (*self.keys, self.order)]
        last = [F.max_by(c, self.order).alias(c) for c in values]
        return rows.groupBy(*self.keys).agg(F.max(self.order).alias(self.order), *last).select(*rows.columns)

    def _read(self, folders):
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def folders(self):
        """The live snapshot, if there is one, and the batches after it."""
        _, content = read_manifest(self.spark, self.path)
        return content.get("folders", [])

    def state(self):
        """The latest rows as of the last commit."""
        return self.latest(self._read(self.folders()))

    def has(self, batch):
        return read_manifest(self.spark, self.path)[0] >= batch

    def commit(self, batch, rows):
        """Add a batch, and compact if there are many."""
        version, content = read_manifest(self.spark, self.path)
        if version >= batch:
            return
        folder = new_folder("batch")
        columns = self.spark.createDataFrame([], self.schema).columns
        rows.select(*columns).write.parquet(f"{self.path}/{folder}")
        folders = [*content.get("folders", []), folder]
        if len(folders) > self.compact_every:
            snapshot = new_folder("snapshot")
            self.latest(self._read(folders)).write.parquet(f"{self.path}/{snapshot}")
            folders = [snapshot]
        write_manifest(self.spark, self.path, batch, {"folders": folders})
