"""Caches of frames by name: of this process, of a folder that outlives it, or of any key-value store."""

from __future__ import annotations

import base64
import pickle
import re
import zlib
from collections.abc import MutableMapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .session import shared_folder


class Serializer(Protocol):
    def dump(self, value: object) -> bytes: ...

    def load(self, data: bytes) -> object: ...


class NativeSerializer:
    def dump(self, value: object) -> bytes:
        return pickle.dumps(value)

    def load(self, data: bytes) -> object:
        return pickle.loads(data)


class CompressingSerializer:
    def __init__(self, inner: Serializer | None = None, level: int = 6) -> None:
        self.inner, self.level = inner or NativeSerializer(), level

    def dump(self, value: object) -> bytes:
        return zlib.compress(self.inner.dump(value), self.level)

    def load(self, data: bytes) -> object:
        return self.inner.load(zlib.decompress(data))


class Base64Serializer:
    def __init__(self, inner: Serializer | None = None) -> None:
        self.inner = inner or NativeSerializer()

    def dump(self, value: object) -> bytes:
        return base64.b64encode(self.inner.dump(value))

    def load(self, data: bytes) -> object:
        return self.inner.load(base64.b64decode(data))


class MemoryCache:
    """Persisted in the executors of this session."""

    def __init__(self) -> None:
        self.held: dict[str, DataFrame] = {}

    def set(self, name: str, df: DataFrame) -> DataFrame:
        self.held[name] = df.persist()
        return self.held[name]

    def get(self, spark: SparkSession, name: str) -> DataFrame | None:
        return self.held.get(name)

    def delete(self, spark: SparkSession, name: str) -> None:
        if (df := self.held.pop(name, None)) is not None:
            df.unpersist()


class FilesystemCache:
    """Parquet in a folder that driver and executors share; later sessions find it again."""

    def __init__(self, folder: str | None = None) -> None:
        self.folder = folder

    def _path(self, spark: SparkSession, name: str):
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith("."):
            raise ValueError("a cache's name has letters, digits, _, - and dots")
        return spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder or shared_folder(spark) + '/cache'}/{name}")

    def set(self, name: str, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = self._path(spark, name).toString()
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def get(self, spark: SparkSession, name: str) -> DataFrame | None:
        path = self._path(spark, name)
        done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return spark.read.parquet(path.toString()) if fs.exists(done) else None

    def delete(self, spark: SparkSession, name: str) -> None:
        path = self._path(spark, name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class KeyValueCache:
    """Any mapping of texts to bytes (a client of a cache service, say). Rows pass through the driver: for small results, of ``most`` rows at most."""

    def __init__(self, store: MutableMapping[str, bytes], serializer: Serializer | None = None, most: int = 100_000) -> None:
        self.store, self.serializer, self.most = store, serializer or CompressingSerializer(), most

    def set(self, name: str, df: DataFrame) -> DataFrame:
        table = df.limit(self.most + 1).toArrow()
        if table.num_rows > self.most:
            raise ValueError(f"more than {self.most} rows are too many for a key-value cache")
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.store[name] = self.serializer.dump((df.schema.json(), out.getvalue().to_pybytes()))
        return df

    def get(self, spark: SparkSession, name: str) -> DataFrame | None:
        import json

        from pyspark.sql import types as T

        data = self.store.get(name)
        if data is None:
            return None
        schema, rows = self.serializer.load(data)
        return spark.createDataFrame(pa.ipc.open_stream(rows).read_all(), T.StructType.fromJson(json.loads(schema)))

    def delete(self, spark: SparkSession, name: str) -> None:
        self.store.pop(name, None)


#: The cache that frames use where none is named.
DEFAULT = MemoryCache()
