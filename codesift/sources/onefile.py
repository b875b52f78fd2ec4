"""One file written by many tasks: a Spark data source with a commit step.

A file is a row of sections between fixed texts, its layout.  Each task writes
the rows of a section to a part file beside the target; the commit lays the
parts end to end, in the order of the partitions, a block at a time, and gives
the whole its name.  Before that the target is as it was: a job that fails
leaves no file, and what an attempt wrote counts only if that attempt did commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from codesift.session import cleaned
from codesift.sources.members import MemberStream, member
from codesift.sources.tree import opened

NAME = "codesift_onefile"
#: Bytes that the commit copies at a time.
BLOCK = 8 << 20


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: the file of each section."""

    partition: int
    files: dict[int, str] = field(default_factory=dict)


class OneFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.target = options["path"]
        self.layout: list[str] = json.loads(options["layout"])
        self.separator, self.terminator = options.get("separator", ""), options.get("terminator", "")
        self.compressed = options.get("compressed") == "true"
        self.folder = f"{self.target.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        part = Part(context.partitionId())
        system, base = opened(self.folder)
        streams: dict[int, fs.NativeFile | MemberStream] = {}
        try:
            for batch in iterator:
                sections, values = batch.column("section"), batch.column("value")
                for section in pc.unique(sections).to_pylist():
                    if section is None or not 0 <= section < len(self.layout) - 1:
                        raise ValueError(f"the layout has no section {section}")
                    texts = values.filter(pc.equal(sections, section)).drop_null().to_pylist()
                    if not texts:
                        continue
                    if section not in streams:
                        system.create_dir(base, recursive=True)
                        part.files[section] = f"{section}-{part.partition}-{context.taskAttemptId()}"
                        stream = system.open_output_stream(f"{base}/{part.files[section]}")
                        streams[section] = MemberStream(stream) if self.compressed else stream
                    elif self.separator:
                        streams[section].write(self.separator.encode())
                    streams[section].write((self.terminator + self.separator).join(texts).encode())
                    streams[section].write(self.terminator.encode())
        finally:
            for stream in streams.values():
                stream.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        system, base = opened(self.folder)
        system.create_dir(base, recursive=True)
        packed = lambda text: member(text.encode()) if self.compressed and text else text.encode()
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        with system.open_output_stream(f"{base}/whole") as out:
            out.write(packed(self.layout[0]))
            for section, text in enumerate(self.layout[1:]):
                for k, name in enumerate(m.files[section] for m in parts if section in m.files):
                    if k:
                        out.write(packed(self.separator))
                    with system.open_input_stream(f"{base}/{name}") as stream:
                        while block := stream.read(BLOCK):
                            out.write(block)
                    # The report is on disk once, not twice.
                    system.delete_file(f"{base}/{name}")
                out.write(packed(text))
        system.move(f"{base}/whole", opened(self.target)[1])
        system.delete_dir(base)

    def abort(self, messages: list[Part | None]) -> None:
        system, base = opened(self.folder)
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


class OneFile(DataSource):
    """Options: path; layout (n + 1 texts around n sections, as JSON); separator (between rows of a section); terminator (after each row); compressed (as gzip members, if true)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        options = {k.lower(): v for k, v in self.options.items()}
        system, path = opened(options["path"])
        if not overwrite and system.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(options["path"])
        return OneFileWriter(options)


def write_one(sections: Sequence[DataFrame], path: str, layout: Sequence[str], separator: str = "", terminator: str = "", overwrite: bool = False) -> None:
    """Writes one file: ``layout[0]``, the values of the first section, ``layout[1]`` and so on.

    Each section has a text column ``value``, other columns are left; its rows
    come in the order of the table where that is sorted.  Null values are left
    out, a section without rows writes nothing.  All machines must see the
    folder of the target.  Only the commit runs in one place; it copies blocks.
    A path that ends in .gz is compressed where the rows are written.
    """
    if len(layout) != len(sections) + 1:
        raise ValueError("a layout has a text more than there are sections")
    spark = sections[0].sparkSession
    spark.dataSource.register(OneFile)
    rows = None
    for k, section in enumerate(sections):
        part = section.select(F.lit(k).alias("section"), F.col("value").cast("string").alias("value"))
        rows = part if rows is None else rows.unionAll(part)
    options = {"layout": json.dumps(list(layout)), "separator": separator, "terminator": terminator, "compressed": str(path.lower().endswith(".gz")).lower()}
    with cleaned(spark):
        rows.write.format(NAME).options(**options).mode("overwrite" if overwrite else "append").save(path)
