"""The registry in versions, for any number of companies and more than one writer.

A version is a folder of sorted entries, written by many tasks under another name and then renamed to the next number:
readers take the highest number, so they see a whole version or the one before it.
"""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck import schemas as S

_VERSION = re.compile(r"version-(\d{8})$")


class RegistryConflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


def _files(spark: SparkSession, address: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def registry_versions(spark: SparkSession, address: str) -> list[int]:
    """Numbers of the versions at an address, in ascending order."""
    system, path = _files(spark, address)
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(m[1]) for n in names if (m := _VERSION.match(n)))


def _with_places(registry: DataFrame) -> DataFrame:
    """Entries with one place: those that an upsert appended follow the others, in their order."""
    fields = S.REGISTRY_FILE["companies"].dataType.elementType.names
    if "appended" not in registry.columns:
        return registry.select(F.col("pos").cast("long").alias("pos"), *fields)
    last, least = registry.agg(F.max(F.when(~F.col("appended"), F.col("pos"))), F.min(F.when(F.col("appended"), F.col("pos")))).first()
    moved = (0 if last is None else last + 1) - (least or 0)
    place = F.when(F.col("appended"), F.col("pos") + moved).otherwise(F.col("pos"))
    return registry.select(place.cast("long").alias("pos"), *fields)


def commit_registry(registry: DataFrame, address: str, after: int | None = None) -> int:
    """Writes the next version; its number. ``registry`` may have been read from the same address.

    ``after`` is the version that the change is based on (by default the highest there is when the writing begins): if there is a
    later one by the end, nothing is changed and the writer is told.
    """
    spark = registry.sparkSession
    system, _ = _files(spark, address)
    based_on = max(registry_versions(spark, address), default=0) if after is None else after
    staged, target = f"{address}/_staged-{uuid.uuid4().hex}", f"{address}/version-{based_on + 1:08d}"
    of = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    try:
        _with_places(registry).repartitionByRange("pos").sortWithinPartitions("pos").write.json(staged)
        if system.exists(of(target)) or not system.rename(of(staged), of(target)):
            raise RegistryConflict(f"version {based_on + 1} is there already")
    finally:
        if system.exists(of(staged)):
            system.delete(of(staged), True)
    return based_on + 1


def read_registry_version(spark: SparkSession, address: str, version: int | None = None) -> DataFrame:
    """The entries of a version (by default the highest) with their places, as ``sources.documents.read_registry`` has them."""
    versions = registry_versions(spark, address)
    if version is None and not versions or version is not None and version not in versions:
        raise FileNotFoundError(f"no version {version or ''} at {address}")
    schema = S.T.StructType([S.T.StructField("pos", S.T.LongType()), *S.REGISTRY_ENTRY.fields])
    return spark.read.schema(schema).json(f"{address}/version-{version or versions[-1]:08d}")
