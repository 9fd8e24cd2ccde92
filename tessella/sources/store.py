"""Versioned tables of model parameters.

Each version is a folder of rows (name, shape, values, digest) and counts once all of it is there: the digests must match, and a row named COMMIT tells
how many others there are. A version that is damaged or unfinished is passed over, so its predecessor stays in use.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "#commit"
#: Bytes of parameters that are sent to every task at most.
LIMIT = 256 << 20


def _digest(name: str, values: np.ndarray) -> str:
    return hashlib.sha256(name.encode() + np.ascontiguousarray(values, float).tobytes()).hexdigest()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that are there, whole or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"version=(\d+)", n)))


def save(spark: SparkSession, root: str, parameters: dict[str, np.ndarray]) -> int:
    """Write a new version and return its number; the versions before it are left as they are."""
    version = max(versions(spark, root), default=0) + 1
    rows = [(k, list(np.shape(v)), np.ravel(v).astype(float).tolist(), _digest(k, np.ravel(v))) for k, v in parameters.items()]
    rows.append((COMMIT, [len(rows)], [], _digest(COMMIT, np.array([len(rows)]))))
    spark.createDataFrame(rows, "name string, shape array<long>, values array<double>, digest string").coalesce(1).write.parquet(f"{root}/version={version}")
    return version


def read(spark: SparkSession, root: str, version: int) -> dict[str, np.ndarray]:
    """The parameters of one version; ValueError if it is not whole or too large to send."""
    rows = spark.read.parquet(f"{root}/version={version}")
    size = rows.agg(F.sum(8 * F.size("values"))).first()[0] or 0
    if size > LIMIT:
        raise ValueError(f"version {version} holds {size} bytes of parameters")
    out, commit = {}, None
    for r in rows.collect():
        if r.name == COMMIT:
            commit = r.shape[0]
            continue
        values = np.array(r["values"], float)
        if r.digest != _digest(r.name, values):
            raise ValueError(f"version {version}: {r.name} is damaged")
        out[r.name] = values.reshape(r.shape)
    if commit != len(out):
        raise ValueError(f"version {version} is not whole")
    return out


def load(spark: SparkSession, root: str) -> tuple[int, dict[str, np.ndarray]] | None:
    """(version, parameters) of the newest version that is whole; None if there is none."""
    for version in reversed(versions(spark, root)):
        try:
            return version, read(spark, root, version)
        except Exception:  # a damaged file fails in the reader, in ways that depend on the damage
            continue
    return None


def parameter_table(spark: SparkSession, parameters: dict[str, np.ndarray]) -> DataFrame:
    """(name, pos, value) of all parameters."""
    rows = pa.table({"name": np.concatenate([[k] * np.size(v) for k, v in parameters.items()]), "pos": np.concatenate([np.arange(np.size(v)) for v in parameters.values()]), "value": np.concatenate([np.ravel(v) for v in parameters.values()]).astype(float)})
    return spark.createDataFrame(rows)
