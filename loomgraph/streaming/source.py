"""The run log as a data source with exact offsets: format "runlog".

A log is a folder of Parquet files with run_id and seq, gapless from 0 in each run, as the sinks here write
it.  As a stream it follows one run: the offset is the run's last seq that was read, a query starts behind
the option `after`, and a batch of it is dealt to tasks by ranges of seq.  A checkpoint holds the offsets,
so each event is read once, in whatever number of files it comes.  As a batch it gives the events behind
`after` of one run, or of all, a task for each file's row groups.

The folder must be one that pyarrow's file systems open: a mount, HDFS, S3, GS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

COLUMNS = "run_id bigint, seq bigint, type string, node_id string, payload string"
#: Events of a run in one task.
EACH = 100_000


def _dataset(path: str):
    """The Parquet files of a folder; what a writer has not finished starts with an underscore and is passed over."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    files, plain = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = files.get_file_info(fs.FileSelector(plain, recursive=True, allow_not_found=True))
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(plain) :].split("/"))
    paths = sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not hidden(f.path))
    return ds.dataset(paths, filesystem=files, format="parquet", schema=pa.schema([("run_id", pa.int64()), ("seq", pa.int64()), ("type", pa.string()), ("node_id", pa.string()), ("payload", pa.string())]))


def _condition(run: int | None, after: int, upto: int | None):
    import pyarrow.compute as pc

    own = pc.field("seq") > after
    if upto is not None:
        own &= pc.field("seq") <= upto
    return own if run is None else own & (pc.field("run_id") == run)


@dataclass
class Range(InputPartition):
    """Events of a run, or of all, behind after and up to upto; of one row group of a file if named."""

    run: int | None
    after: int
    upto: int | None = None
    file: str | None = None
    group: int | None = None


class _Reader:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.run = int(options["run"]) if options.get("run") else None
        self.after = int(options.get("after", -1))
        self.each = int(options.get("each", EACH))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        data = _dataset(self.path)
        if part.file is not None:
            for fragment in data.get_fragments():
                if fragment.path == part.file:
                    own = fragment.subset(row_group_ids=[part.group])
                    yield from own.scanner(schema=data.schema, filter=_condition(part.run, part.after, part.upto)).to_batches()
        else:
            yield from data.scanner(filter=_condition(part.run, part.after, part.upto)).to_batches()


class BatchReader(_Reader, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes run_id = and seq > and >= into the scan; Spark applies the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("run_id",) and self.run in (None, f.value):
                self.run = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("seq",):
                self.after = max(self.after, f.value - isinstance(f, GreaterThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for fragment in _dataset(self.path).get_fragments(filter=_condition(self.run, self.after, None)):
            out += [Range(self.run, self.after, None, fragment.path, g.id) for g in fragment.subset(filter=_condition(self.run, self.after, None), schema=None).row_groups] if fragment.num_row_groups else []
        return out or [Range(self.run, self.after, self.after)]


class StreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        if self.run is None:
            raise ValueError("a stream of the log follows one run: set the option run")
        self.last = self.after

    def initialOffset(self) -> dict[str, int]:
        return {"run": self.run, "seq": self.after}

    def latestOffset(self) -> dict[str, int]:
        """The end of the gapless numbers from the last offset on; only the run's later events are looked at."""
        for batch in _dataset(self.path).scanner(columns=["seq"], filter=_condition(self.run, self.last, None)).to_batches():
            if len(batch):
                self.last = max(self.last, pa.compute.max(batch.column("seq")).as_py())
        return {"run": self.run, "seq": self.last}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        cuts = [*range(start["seq"], end["seq"], self.each), end["seq"]]
        return [Range(self.run, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def commit(self, end: dict[str, int]) -> None:
        self.last = max(self.last, end["seq"])


class RunLogSource(DataSource):
    """spark.read and spark.readStream.format("runlog") with options path, run, after and each."""

    @classmethod
    def name(cls) -> str:
        return "runlog"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: object) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema: object) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; filters on run_id and seq then reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunLogSource)
