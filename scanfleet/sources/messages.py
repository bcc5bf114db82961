"""Recorded message logs: merging, topic routing, payload decoding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Little-endian record layouts of the supported payloads.
IMU_LAYOUT = [("t", "<f8"), ("gx", "<f8"), ("gy", "<f8"), ("gz", "<f8"), ("ax", "<f8"), ("ay", "<f8"), ("az", "<f8")]
POINT_LAYOUTS = {
    "velodyne": [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4"), ("time", "<f4"), ("ring", "<u2")],
    "ouster": [
        ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4"), ("t", "<u4"), ("reflectivity", "<u2"),
        ("ring", "<u1"), ("ambient", "<u2"), ("range", "<u4"),
    ],
    "livox": [
        ("offset_time", "<u4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("reflectivity", "<u1"), ("tag", "<u1"), ("line", "<u1"),
    ],
}
_SQL_TYPES = {"f4": "double", "f8": "double", "u1": "int", "u2": "int", "u4": "bigint"}


def merge_logs(logs: Sequence[DataFrame]) -> DataFrame:
    """All messages of several recordings in caller's order, with ``log_id`` 0, 1, …"""
    out = None
    for i, df in enumerate(logs):
        one = df.withColumn("log_id", F.lit(i).cast("bigint"))
        out = one if out is None else out.unionByName(one)
    return out


def topic_catalogue(messages: DataFrame) -> DataFrame:
    """Topic name with the first type seen for it (lowest log, then earliest message)."""
    first = F.struct("log_id", "t_ns", "seq")
    return messages.groupBy("topic").agg(F.min_by("type", first).alias("type"), F.count(F.lit(1)).alias("messages"))


def discover_logs(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under ``root`` (recursively) with name, path, size and extension; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(F.instr(name, ".") > 0, F.element_at(F.split(name, "\\."), -1)).otherwise("")
    return files.select(name.alias("name"), "path", F.col("length").alias("size"), kind.alias("type"))


def route_topics(messages: DataFrame, routes: Sequence[tuple[str, str, str]], dataset: str | None = None) -> DataFrame:
    """Subscribed messages labelled with their role, from (dataset, role, topic) rows.

    The routing table is a constant of the program, so it is matched as a map expression and the
    topic filter reaches the scan.
    """
    wanted = [(r, t) for d, r, t in routes if dataset is None or d == dataset]
    role = F.create_map(*(F.lit(v) for r, t in dict((t, r) for r, t in wanted).items() for v in (r, t)))
    return messages.filter(F.col("topic").isin([t for _, t in wanted])).withColumn("role", role[F.col("topic")])


def decode_imu(messages: DataFrame) -> DataFrame:
    """IMU payloads as typed rows; accelerations keep their unit."""
    return decode_records(messages, IMU_LAYOUT)


def decode_points(messages: DataFrame, layout: str) -> DataFrame:
    """Point payloads of a vendor layout as rows, numbered by ``idx`` inside their message."""
    return decode_records(messages, POINT_LAYOUTS[layout], "idx")


def decode_records(messages: DataFrame, layout: Sequence[tuple[str, str]], index: str | None = None) -> DataFrame:
    """Fixed-size binary records to rows. Each task decodes its own Arrow batches."""
    dtype = np.dtype(list(layout))
    keys = [c for c in messages.columns if c != "payload"]
    types = dict(messages.dtypes)
    fields = [f"`{k}` {types[k]}" for k in keys] + ([f"{index} bigint"] if index else [])
    fields += [f"`{n}` {_SQL_TYPES[f[1:]]}" for n, f in layout]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start : start + 256]
                records = [np.frombuffer(p, dtype=dtype) for p in part["payload"]]
                sizes = [len(r) for r in records]
                if not sum(sizes):
                    continue
                rows = np.concatenate(records)
                out = {k: np.repeat(part[k].to_numpy(), sizes) for k in keys}
                if index:
                    out[index] = np.concatenate([np.arange(n) for n in sizes])
                for n, f in layout:
                    out[n] = rows[n].astype("f8" if "f" in f else "i8")
                yield pd.DataFrame(out)

    return messages.mapInPandas(run, ", ".join(fields))


def encode_records(
    rows: DataFrame, layout: Sequence[tuple[str, str]], by: Sequence[str], order: str, per_message: int = 65536
) -> DataFrame:
    """Rows packed into binary payloads of at most ``per_message`` records, ``part`` numbering them.

    ``order`` must count 0, 1, … inside each key; it decides the payload a row goes to.
    """
    dtype = np.dtype(list(layout))
    names = [n for n, _ in layout]
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in by), "part bigint", "payload binary"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rec = np.zeros(len(pdf), dtype=dtype)
        for n in names:
            rec[n] = pdf[n].to_numpy()
        return pd.DataFrame([[*key, rec.tobytes()]], columns=[*by, "part", "payload"])

    cut = rows.withColumn("part", F.floor(F.col(order) / per_message).cast("bigint"))
    return cut.groupBy(*by, "part").applyInPandas(run, schema)
