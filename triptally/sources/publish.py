"""Tables published by a manifest: readers see the whole of a run or nothing of it.

A run writes its rows beside those already there and then publishes one small file that names every
folder the table now consists of. What fails before that file is in place has changed nothing; what
it no longer names stays readable as an older version until `vacuum`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triptally.sources.writers import conform, delete

ROWS = "rows"


class ConflictError(RuntimeError):
    """Another run has published since this one began."""


class PublishedTable:
    """A table partitioned by month under `path`, in versions.

    `data/write_id=.../<month>=...` holds the rows of each write, `manifests/00000001.json` and so on
    name the writes and months of each version. Manifests have one entry per write and month, so the
    driver reads and writes a few kilobytes whatever the size of the table.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, month: str = "month_date",
        further: Sequence[str] = (),
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.month, self.further = month, tuple(further)

    # Reading

    def versions(self) -> list[int]:
        """The numbers of all published versions, ascending."""
        names = [name for name in self._names("manifests") if re.fullmatch(r"\d{8}\.json", name)]
        return sorted(int(name[:8]) for name in names)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "note", "writes": [{"id", "run", "months", "live", "counts"}]}; the newest by default."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "note": {}, "writes": []}
        wanted = known[-1] if version is None else version
        text = self.spark.read.text(self._manifest_path(wanted), wholetext=True)
        return json.loads(text.first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; the month is a partition column, so filters on it leave out files."""
        folders = []
        for write in self.manifest(version)["writes"]:
            base = f"{self.path}/data/write_id={write['id']}"
            whole = write["live"] == write["months"]
            folders += [base] if whole else [f"{base}/{self.month}={m}" for m in write["live"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data")
        return rows.parquet(*folders).select(*self.schema.names)

    def months(self, version: int | None = None) -> list[str]:
        """The months that have rows, as text."""
        return sorted({m for w in self.manifest(version)["writes"] for m in w["live"]})

    def runs(self, version: int | None = None) -> dict[str, dict]:
        """What each run counted while it wrote."""
        return {w["run"]: w["counts"] for w in self.manifest(version)["writes"]}

    # Writing

    def append(
        self, frame: DataFrame, run: str, metrics: Mapping[str, Column] | None = None
    ) -> dict:
        """Adds the rows of a run. A run that is there already is replaced, so that a repeated append
        gives its rows once. Returns what was counted while writing."""
        before = self.manifest()
        new = self._store(frame, run, metrics)
        others = [w for w in before["writes"] if w["run"] != run]
        self._publish([*others, new], before, before["note"])
        return new["counts"]

    def replace_months(
        self, frame: DataFrame, period: tuple[date, date] | None = None, run: str | None = None,
        metrics: Mapping[str, Column] | None = None, months: Sequence[str] = (),
        note: Mapping[str, int] | None = None,
    ) -> dict:
        """Writes months in place of those already there and leaves all others alone.

        `period` (from which to which month) or `months` (as text) say what was processed: such months
        that have no rows now lose those they had. The frame runs once. `note` is kept with the
        version. Returns what was counted while writing.
        """
        before = self.manifest()
        new = self._store(frame, run or uuid.uuid4().hex, metrics)
        gone = {*new["months"], *months}
        if period is not None:
            first, last = (f"{day.replace(day=1):%Y-%m-%d}" for day in period)
            gone |= {m for w in before["writes"] for m in w["live"] if first <= m <= last}
        kept = []
        for write in before["writes"]:
            live = [m for m in write["live"] if m not in gone]
            if live:
                kept.append(write | {"live": live})
        self._publish([*kept, new], before, before["note"] if note is None else dict(note))
        return new["counts"]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the newest `keep` versions and the writes none of the rest names. For times
        without writers: what a running write has stored is not named yet."""
        if keep < 1:
            raise ValueError("at least one version stays")
        known = self.versions()
        named = {w["id"] for v in known[-keep:] for w in self.manifest(v)["writes"]}
        for version in known[:-keep]:
            delete(self.spark, self._manifest_path(version))
        stored = [n.removeprefix("write_id=") for n in self._names("data") if n.startswith("write_id=")]
        old = [write for write in stored if write not in named]
        for write in old:
            delete(self.spark, f"{self.path}/data/write_id={write}")
        return old

    def _store(self, frame: DataFrame, run: str, metrics: Mapping[str, Column] | None) -> dict:
        """Writes rows to a folder of their own. Counts are metrics of the writing job itself."""
        write = uuid.uuid4().hex
        folder = f"{self.path}/data/write_id={write}"
        rows, found = conform(frame, self.schema), Observation()
        counts = {ROWS: F.count(F.lit(1))} | dict(metrics or {})
        rows = rows.observe(found, *[value.alias(name) for name, value in counts.items()])
        rows.write.partitionBy(self.month, *self.further).parquet(folder)
        prefix = f"{self.month}="
        months = [n.removeprefix(prefix) for n in self._names(f"data/write_id={write}") if n.startswith(prefix)]
        # A plan that turns out empty counts nothing.
        told = found.get if months else {name: 0 if name == ROWS else None for name in counts}
        return {"id": write, "run": run, "months": sorted(months), "live": sorted(months),
                "counts": {name: _plain(told.get(name)) for name in counts}}

    def _publish(self, writes: list[dict], before: dict, note: dict) -> None:
        """Puts the next manifest in place in one step: complete, or not at all. It fails if another
        run has taken the number meanwhile; what this run stored is then never named."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        version = before["version"] + 1
        live = [w for w in writes if w["live"]]
        text = json.dumps({"version": version, "note": note, "writes": live}, indent=1)
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp")
        final = jvm.org.apache.hadoop.fs.Path(self._manifest_path(version))
        out = draft.getFileSystem(conf).create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            files.rename(draft, final, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as error:
            draft.getFileSystem(conf).delete(draft, False)
            if version in self.versions():
                raise ConflictError(f"version {version} of {self.path} exists already") from error
            raise

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:08d}.json"

    def _names(self, folder: str) -> list[str]:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(target):
            return []
        return [status.getPath().getName() for status in system.listStatus(target)]


def _plain(value):
    return value.isoformat() if isinstance(value, date) else value


def append_to_catalog(
    frame: DataFrame, name: str, schema: T.StructType, run: str, location: str | None = None,
    run_column: str = "run_id",
) -> None:
    """Adds the rows of a run to a table of the session's catalog, made at the first append.

    The table is partitioned by run, and a run writes its own partition only: repeating it replaces
    its rows. Readers use the table's name.
    """
    if not re.fullmatch(r"[\w.:-]+", run):
        raise ValueError(f"a run is named by letters, digits and . : _ -, not {run!r}")
    spark = frame.sparkSession
    if not spark.catalog.tableExists(name):
        full = T.StructType([*schema.fields, T.StructField(run_column, T.StringType(), False)])
        empty = spark.createDataFrame([], full).write.partitionBy(run_column).format("parquet")
        empty = empty.option("path", location) if location else empty
        empty.mode("ignore").saveAsTable(name)
    columns = ", ".join(f"`{column}`" for column in schema.names)
    target = f"{name} PARTITION (`{run_column}` = '{run}')"
    spark.sql(f"INSERT OVERWRITE {target} SELECT {columns} FROM {{rows}}", rows=conform(frame, schema))


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a table holds more than once, with how often."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
