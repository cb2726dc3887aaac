"""Result tables to storage, partitioned by run."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(table: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "csv"), by: str | None = "run_id") -> None:
    """Write ``path/<format>`` for each format, one directory per run.

    Rebalancing brings the rows of a run together, so a run has few files, and splits a run that is
    larger than a task should hold.
    """
    partitioned = bool(by) and by in table.columns
    rows = table.hint("rebalance", by) if partitioned else table
    for fmt in formats:
        writer = rows.write.mode("overwrite")
        if partitioned:
            writer = writer.partitionBy(by)
        if fmt == "csv":
            writer.csv(f"{path}/csv", header=True)
        elif fmt == "parquet":
            writer.parquet(f"{path}/parquet")
        else:
            raise ValueError(f"unsupported table format: {fmt}")


def write_records(table: DataFrame, path: str) -> None:
    """One JSON record per row (summaries, scenario metadata)."""
    table.write.mode("overwrite").json(path)


MANIFEST = "MANIFEST.json"


def write_bundle(
    tables: Mapping[str, DataFrame], summary: DataFrame, metadata: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "csv")
) -> dict[str, str]:
    """All tables of a set of runs, their summary and their scenario records; returns the locations.

    Everything is written to a new folder ``version-<id>`` first. Then the manifest, which names the tables of the bundle, is
    replaced in one step, so readers see the old bundle or the new one, and a job that stops halfway changes nothing.
    The version before stays, for those who are reading it; older ones, and what stopped jobs have left, are removed.
    """
    spark = summary.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    for name, table in tables.items():
        write_table(table, f"{path}/{version}/{name}", formats)
    write_records(summary, f"{path}/{version}/summary")
    write_records(metadata, f"{path}/{version}/scenarios")
    names = (*tables, "summary", "scenarios")
    before = _manifest(spark, path)
    kinds = {name: list(formats) if name in tables else ["json"] for name in names}
    _replace_file(spark, f"{path}/{MANIFEST}", json.dumps({"version": version, "tables": kinds}))
    _remove_versions(spark, path, {version, (before or {}).get("version")})
    return {name: f"{path}/{version}/{name}" for name in names}


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the bundle that was written last, by name."""
    found = _manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"no bundle under {path}")
    out = {}
    for name, formats in found["tables"].items():
        place, fmt = f"{path}/{found['version']}/{name}", "parquet" if "parquet" in formats else formats[0]
        out[name] = spark.read.json(place) if fmt == "json" else spark.read.options(header=True, inferSchema=True).format(fmt).load(f"{place}/{fmt}")
    return out


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _manifest(spark: SparkSession, path: str) -> dict | None:
    system, place = _file_system(spark, f"{path}/{MANIFEST}")
    return json.loads(spark.read.text(place.toString(), wholetext=True).first()[0]) if system.exists(place) else None


def _replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then rename over it: one step of the file system."""
    jvm = spark._jvm
    system, place = _file_system(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = system.makeQualified(place)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), system.getConf()).rename(system.makeQualified(staged), whole, options)


def _remove_versions(spark: SparkSession, path: str, kept: set) -> None:
    system, place = _file_system(spark, path)
    for status in system.listStatus(place):
        if status.isDirectory() and status.getPath().getName().startswith("version-") and status.getPath().getName() not in kept:
            system.delete(status.getPath(), True)


#: Folder of intermediates of each Spark application.
_FOLDERS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the session's shared ``spark.checkpoint.dir``, in one folder per application.

    A folder of this machine is used only where no shared one is set and the master is local.  :func:`release` removes
    the folder; the end of the driver's process does so too.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            shared = tempfile.gettempdir()
        _FOLDERS[app] = f"{shared.rstrip('/')}/{app}-{uuid.uuid4().hex}"
        atexit.register(_release, app, spark._jvm, spark._jsc.hadoopConfiguration())
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove the intermediates of this application; tables that read them can't be read again."""
    _release(spark.sparkContext.applicationId, spark._jvm, spark._jsc.hadoopConfiguration())


def _release(app: str, jvm, conf) -> None:
    folder = _FOLDERS.pop(app, None)
    if folder is not None:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table and read it back: cuts a long lineage and survives lost executors."""
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def summary_records(summary: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The summary of each run with its configuration hash, ready for :func:`write_records`."""
    return summary.join(scenarios.select("run_id", F.col("config_hash")), "run_id")
