"""A bounded queue of frames as a streaming source, which drops its oldest.

Producers put each frame as a file ``<stream>/<number>.<ending>`` into a spool that all machines share, numbers rising.
A micro-batch takes what has come since the last one, but at most ``depth`` frames of each stream: of more, the oldest
are dropped, and the first frame taken tells how many. What a batch holds is fixed by its offsets and the files that were
there, so a batch that runs again is the same; nothing is sorted.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id int, frame_id long, dropped long, content binary"
#: Frames that a queue of a pipeline holds where nothing else is asked for.
DEPTH = 20


class Spool:
    """The frames in the shared folder, by any file system that Arrow knows."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def frames(self, stream: int, after: int, upto: int | None = None) -> list[int]:
        """Numbers of a stream's frames after one and up to another, rising."""
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/{stream}", allow_not_found=True))
        numbers = {int(posixpath.splitext(x.base_name)[0]) for x in found if x.is_file and posixpath.splitext(x.base_name)[0].isdigit()}
        return sorted(n for n in numbers if n > after and (upto is None or n <= upto))

    def streams(self) -> list[int]:
        from pyarrow import fs

        return sorted(int(x.base_name) for x in self.system.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if not x.is_file and x.base_name.isdigit())

    def content(self, stream: int, frame: int, ending: str) -> bytes:
        with self.system.open_input_stream(f"{self.root}/{stream}/{frame}{ending}") as f:
            return f.read()

    def remove(self, stream: int, frame: int, ending: str) -> None:
        self.system.delete_file(f"{self.root}/{stream}/{frame}{ending}")


class Taken(InputPartition):
    """Frames of one stream that one task reads."""

    def __init__(self, stream: int, frames: list[int], dropped: int):
        self.stream, self.frames, self.dropped = stream, frames, dropped


class QueueReader(DataSourceStreamReader):
    """Offsets are the last frame's number by stream."""

    def __init__(self, options: dict):
        self.spool = Spool(options["path"])
        self.depth = int(options.get("depth", DEPTH))
        self.each = int(options.get("framesPerTask", 64))
        self.ending = options.get("ending", ".bin")
        self.clean = str(options.get("clean", "false")).lower() == "true"
        if self.depth < 1 or self.each < 1:
            raise ValueError("depth and framesPerTask must be positive")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        return {str(s): f[-1] for s in self.spool.streams() if (f := self.spool.frames(s, -1))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for stream, last in sorted(end.items()):
            came = self.spool.frames(int(stream), int(start.get(stream, -1)), int(last))
            kept, dropped = came[-self.depth :], max(0, len(came) - self.depth)
            for i in range(0, len(kept), self.each):
                out.append(Taken(int(stream), kept[i : i + self.each], 0 if i else dropped))
        return out

    def read(self, partition: Taken) -> Iterator[tuple]:
        for k, frame in enumerate(partition.frames):
            yield partition.stream, frame, 0 if k else partition.dropped, self.spool.content(partition.stream, frame, self.ending)

    def commit(self, end: dict) -> None:
        """With ``clean`` the frames up to here are deleted: the batch that had them is done."""
        if self.clean:
            for stream, last in end.items():
                for frame in self.spool.frames(int(stream), -1, int(last)):
                    self.spool.remove(int(stream), frame, self.ending)


class QueueSource(DataSource):
    """format("frame_queue") with options path, depth, ending, framesPerTask and clean."""

    @classmethod
    def name(cls) -> str:
        return "frame_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return QueueReader(dict(self.options))


def put(path: str, stream: int, frame: int, content: bytes, ending: str = ".bin") -> None:
    """A producer's frame, whole or not at all."""
    spool = Spool(path)
    spool.system.create_dir(f"{spool.root}/{stream}", recursive=True)
    with spool.system.open_output_stream(f"{spool.root}/{stream}/.{frame}{ending}") as f:
        f.write(content)
    spool.system.move(f"{spool.root}/{stream}/.{frame}{ending}", f"{spool.root}/{stream}/{frame}{ending}")


def register(spark) -> None:
    spark.dataSource.register(QueueSource)
