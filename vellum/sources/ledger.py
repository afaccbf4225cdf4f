"""Appending to a Parquet sink in batches that are whole or absent.

A batch goes through three steps in the sink's folder: its rows are *staged* in a
hidden folder; a file that lists the staged files is *recorded* by a rename; then
the files are *published*, each by a rename to a name of its own, and the record is
closed by one more.  Whoever opens the sink next finishes recorded batches and drops
staged ones without a record, so a job that stops anywhere adds nothing twice and
loses nothing.  A record also holds the batch's inputs (a Parquet table beside it),
its number of rows and free-form notes, such as the fingerprint of the data that the
sink belongs to.

One writer at a time; readers see a batch's files appear one by one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

LEDGER = "_ledger"   # Spark's readers skip names that begin with an underscore
STAGE = "_stage"


class Ledger:
    """The record of a sink's batches."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io = jvm.org.apache.hadoop.io.IOUtils
        self._bytes = jvm.java.io.ByteArrayOutputStream

    # files
    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def _read(self, name: str) -> dict:
        stream, out = self.fs.open(self._path(f"{self.out}/{LEDGER}/{name}")), self._bytes()
        self._io.copyBytes(stream, out, 4096, True)
        return json.loads(out.toString(self._utf8))

    def _write(self, name: str, value: dict) -> None:
        part = self._path(f"{self.out}/{LEDGER}/.{name}.part")
        stream = self.fs.create(part, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        self._move(part, self._path(f"{self.out}/{LEDGER}/{name}"))

    def _move(self, a, b) -> None:
        if not self.fs.rename(a, b):
            raise OSError(f"could not rename {a} to {b}")

    # records
    def exists(self) -> bool:
        return self.fs.exists(self._path(f"{self.out}/{LEDGER}"))

    def _open(self) -> list[str]:
        return [n for n in self._names(f"{self.out}/{LEDGER}") if n.endswith(".open.json")]

    def batches(self) -> list[dict]:
        """Records of the published batches, in order."""
        names = [n for n in self._names(f"{self.out}/{LEDGER}") if n.endswith(".done.json")]
        return [self._read(n) for n in names]

    def inputs(self) -> DataFrame | None:
        """The inputs of all published batches."""
        folders = [f"{self.out}/{LEDGER}/{b['batch']}.inputs" for b in self.batches() if b["inputs"]]
        return self.spark.read.parquet(*folders) if folders else None

    def recover(self) -> Ledger:
        """Finish recorded batches and drop those that were not recorded."""
        for name in self._open():
            self.publish(self._read(name))
        stage = self._path(f"{self.out}/{STAGE}")
        if self.fs.exists(stage):
            self.fs.delete(stage, True)
        names = self._names(f"{self.out}/{LEDGER}")
        for name in names:
            if name.endswith(".inputs") and f"{name.removesuffix('.inputs')}.done.json" not in names:
                self.fs.delete(self._path(f"{self.out}/{LEDGER}/{name}"), True)
        return self

    # steps
    def stage(self, df: DataFrame, inputs: DataFrame | None = None, notes: dict | None = None) -> dict:
        """Write a batch's rows where no reader looks; its record, not yet written."""
        batch = f"{len(self.batches()):08d}-{uuid.uuid4().hex}"
        folder = f"{self.out}/{STAGE}/{batch}"
        df.write.parquet(folder)
        if inputs is not None:
            inputs.write.parquet(f"{self.out}/{LEDGER}/{batch}.inputs")
        files = [n for n in self._names(folder) if n.endswith(".parquet")]
        return {"batch": batch, "files": files, "rows": self.spark.read.schema(df.schema).parquet(folder).count(),
                "inputs": inputs is not None, "notes": notes or {}}

    def record(self, entry: dict) -> None:
        self._write(f"{entry['batch']}.open.json", entry)

    def publish(self, entry: dict) -> None:
        """Move what is still staged, then close the record."""
        batch = entry["batch"]
        for i, name in enumerate(entry["files"]):
            staged = self._path(f"{self.out}/{STAGE}/{batch}/{name}")
            if self.fs.exists(staged):
                self._move(staged, self._path(f"{self.out}/part-{batch}-{i:05d}.parquet"))
        at = f"{self.out}/{LEDGER}/{batch}"
        self._move(self._path(f"{at}.open.json"), self._path(f"{at}.done.json"))
        self.fs.delete(self._path(f"{self.out}/{STAGE}/{batch}"), True)

    def append(self, df: DataFrame, inputs: DataFrame | None = None, notes: dict | None = None) -> int:
        """All three steps; the number of rows.  A batch without rows or inputs leaves
        no trace."""
        entry = self.stage(df, inputs, notes)
        if entry["rows"] or entry["inputs"]:
            self.record(entry)
            self.publish(entry)
        else:
            self.fs.delete(self._path(f"{self.out}/{STAGE}/{entry['batch']}"), True)
        return entry["rows"]

    def rows(self) -> DataFrame | None:
        """What is published, or None."""
        shown = [n for n in self._names(self.out) if not n.startswith(("_", "."))]
        return self.spark.read.parquet(self.out) if shown else None
