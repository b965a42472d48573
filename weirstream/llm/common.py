"""Helpers that several operators share: table reading, shared folders, Arrow slices, broadcast files."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Characters of text that one slice of an Arrow batch holds, unless a single text is longer.
SLICE_CHARS = 1_000_000


class Lexicon(dict):
    """Numbers words, so equal numbers mean equal words; ``hashes`` has 64 bits of blake2b for each."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.known = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        """By number."""
        if self.fresh:
            new = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in self.fresh]), np.uint64)
            self.known, self.fresh = np.concatenate([self.known, new]), []
        return self.known


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, the place that driver and executors share.

    Where the setting is absent, one machine (tests, a local master) takes a folder of its own; a cluster has no
    place that could be guessed, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors.

    ``folder`` gathers what can go together by ``discard``; else the table has a place of its own.
    """
    path = f"{folder}/{label}-{uuid.uuid4().hex}" if folder else shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables that no result reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Schemes of Spark's paths that pyarrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs", "abfs": "abfss"}


def file_system(path: str):
    """A pyarrow file system for a path as Spark names it, and the path in it."""
    from pyarrow import fs

    scheme, sep, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if sep else path)


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int, list]]:
    """(first row, length, texts) of pieces of a batch that hold about ``chars`` characters of text."""
    values = batch.column(batch.schema.get_field_index(column))
    lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > chars:
            yield start, i - start, values.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths) - start, values.slice(start, len(lengths) - start).to_pylist()


def with_columns(batch: pa.RecordBatch, keep: list[str], start: int, length: int, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of some rows of a batch, followed by new ones."""
    old = {name: batch.column(batch.schema.get_field_index(name)).slice(start, length) for name in keep}
    return pa.RecordBatch.from_pydict(old | new)


def output_schema(df: DataFrame, keep: list[str], new: dict[str, str]) -> T.StructType:
    """Fields of the kept columns, then the new ones given as name -> DDL type."""
    if clash := set(keep) & set(new):
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    added = T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in new.items())).fields if new else []
    return T.StructType([df.schema[name] for name in keep] + added)


def broadcast_file(spark: SparkSession, path: str, max_bytes: int = 32_000_000):
    """Broadcast a vocabulary file; its size is checked, so it can't grow with the data."""
    with open(path, "rb") as f:
        data = f.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    return spark.sparkContext.broadcast(data)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    """The pattern by which the rank files' library cuts texts; read on the driver."""
    import public_tokenizers

    return public_tokenizers.PATTERN
