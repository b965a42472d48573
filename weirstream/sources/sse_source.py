"""Landed server-sent events as a stream source: files that grow by lines, read on from the byte where a batch ended."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from weirstream.sources.sse import PAYLOAD

#: Bytes at the end of a file in which its last line end is looked for, at a time.
TAIL = 65_536
#: Schemes that Spark's paths have and pyarrow's don't, by what pyarrow calls them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "viewfs": "hdfs"}


def file_system(path: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    scheme, sep, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}") if sep else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class LandedLines(DataSourceStreamReader):
    """An offset is the end of the last whole line of each file; a line without its end waits for the next batch."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs as arrow

        fs, root = file_system(self.path)
        found = {}
        for info in fs.get_file_info(arrow.FileSelector(root)):
            if info.is_file and not info.base_name.startswith(("_", ".")):
                end = info.size
                with fs.open_input_file(info.path) as file:
                    while end:
                        begin = max(0, end - TAIL)
                        cut = file.read_at(end - begin, begin).rfind(b"\n")
                        if cut >= 0:
                            found[info.base_name] = begin + cut + 1
                            break
                        end = begin
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(name, start.get(name, 0), at) for name, at in sorted(end.items()) if at > start.get(name, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        fs, root = file_system(self.path)
        with fs.open_input_file(f"{root.rstrip('/')}/{partition.path}") as file:
            file.seek(partition.begin)
            at = partition.begin
            while at < partition.end:
                data = file.read(min(1 << 20, partition.end - at))
                while not data.endswith(b"\n"):  # a range ends with a line
                    data += file.read(min(1 << 16, partition.end - at - len(data)))
                for line in data[:-1].split(b"\n"):
                    yield partition.path.rpartition(".")[0] or partition.path, at, at + len(line) + 1, line.decode("utf-8", "replace").rstrip("\r")
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class SseLines(DataSource):
    """``spark.readStream.format("sse_lines").option("path", folder)``: stream_id (the file's name), seq and next_seq (bytes
    at which a line begins and ends) and line."""

    @classmethod
    def name(cls) -> str:
        return "sse_lines"

    def schema(self) -> str:
        return "stream_id string, seq long, next_seq long, line string"

    def streamReader(self, schema) -> LandedLines:
        return LandedLines(self.options["path"])


def delta_stream(spark: SparkSession, path: str) -> DataFrame:
    """Chunks for the live guard from a folder of event files: stream_id, seq, next_seq, chunk, last.

    Each line is a row, so the bytes of a file are one chain without gaps; comments, broken data and events without text
    have empty chunks, and the end mark is the last. What stands behind it is passed over.
    """
    spark.dataSource.register(SseLines)
    lines = spark.readStream.format("sse_lines").option("path", path).load()
    data = F.when(F.ltrim("line").startswith("data:"), F.trim(F.substring(F.ltrim("line"), F.lit(6), F.length("line"))))
    event = F.from_json(data, PAYLOAD)
    chunk = F.coalesce(F.get(event["choices"], F.lit(0))["delta"]["content"], F.lit(""))
    return lines.select("stream_id", "seq", "next_seq", chunk.alias("chunk"), F.coalesce(data == "[DONE]", F.lit(False)).alias("last"))
