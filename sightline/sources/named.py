"""Files of names of their own: a data source writer for rows (filename, content), and what it does in tasks and at the end.

Spark's own writers name part files themselves, so an output of a given name would be a folder.  Here a task writes each of its rows as a
file, under a name that no reader lists; when all tasks are done the files get their names, and if one fails none does.  A task's names stay
in a file of its own, so that the driver holds eight bytes a file, and the names of one task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Renames at a time, files that are handed out to them at a time, and what a task's list of names is called.
RENAMES, HANDED, NAMES = 16, 4096, "names"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def _sound(name: str | None) -> bool:
    """A file's name, or one in folders; no part of it begins with a sign that readers skip."""
    return bool(name) and all(part and part[0] not in "._" for part in name.split("/"))


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, or None if it has written nothing: the files by their number, and their names in the file NAMES."""

    folder: str | None


class NamedFilesWriter(DataSourceArrowWriter):
    """Tasks write below a folder of the job, which readers skip as its name begins with an underscore."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.path)
        folder, names = f"{root}/{self.job}/{uuid.uuid4().hex}", []  # an attempt's own, so one that runs again leaves nothing in another's way
        for batch in iterator:
            for name, content in zip(batch.column("filename").to_pylist(), batch.column("content"), strict=True):
                if not _sound(name):
                    raise ValueError(f"not the name of a file: {name!r}")
                if not names:
                    system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{len(names)}") as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                names.append(name)
        if not names:
            return Written(None)
        with system.open_output_stream(f"{folder}/{NAMES}") as out:
            out.write(json.dumps(names).encode())
        return Written(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """All files get their names; two of one name are an error, and none of the files appears."""
        system, root = located(self.path)
        folders = [m.folder for m in messages if m and m.folder]

        def names(folder: str) -> list[str]:
            with system.open_input_stream(f"{folder}/{NAMES}") as f:
                return json.loads(f.read())

        try:
            self._once(names, folders)
            if self.overwrite:
                for found in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                    if found.type == fs.FileType.File:
                        system.delete_file(found.path)
                    elif found.base_name[0] not in "._":
                        system.delete_dir(found.path)
            made = set()
            with ThreadPoolExecutor(RENAMES) as pool:
                for folder in folders:
                    own = names(folder)
                    for below in {n.rpartition("/")[0] for n in own if "/" in n} - made:
                        system.create_dir(f"{root}/{below}", recursive=True)
                        made.add(below)
                    for low in range(0, len(own), HANDED):
                        list(pool.map(lambda i: system.move(f"{folder}/{i}", f"{root}/{own[i]}"), range(low, min(low + HANDED, len(own)))))
        finally:
            self.abort(messages)

    @staticmethod
    def _once(names, folders: list[str]) -> None:
        """An error if a name occurs twice: sums of eight bytes tell which names may, and only those are compared."""
        total = lambda n: np.frombuffer(hashlib.blake2b(n.encode(), digest_size=8).digest(), np.uint64)[0]
        sums = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.array([total(n) for n in names(f)], np.uint64) for f in folders)]))
        twice = set(sums[1:][sums[1:] == sums[:-1]].tolist())
        met = set()
        for folder in folders if twice else []:
            for name in names(folder):
                if int(total(name)) in twice:
                    if name in met:
                        raise ValueError(f"several rows have one file name, as {name!r}")
                    met.add(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    """``df.write.format("named-files").mode("append").save(path)`` for rows (filename string, content string or binary)."""

    @classmethod
    def name(cls) -> str:
        return "named-files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if "path" not in self.options or {"filename", "content"} - set(schema.names):
            raise ValueError("named-files needs a path, and columns filename and content")
        return NamedFilesWriter(self.options["path"], overwrite)


def in_folders(name: Column, files: int, together: int = 1000) -> Column:
    """Names of so many files, in folders of about ``together`` files where they are more, so that nobody has to list all of them at once."""
    if files <= together:
        return name
    return F.concat(F.lpad(F.pmod(F.xxhash64(name), F.lit(-(-files // together))).cast("string"), 9, "0"), F.lit("/"), name)


def write_named(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows (filename, content) as files of those names in a folder; a name may go through folders below it."""
    rows.sparkSession.dataSource.register(NamedFiles)
    system, root = located(path)
    system.create_dir(root, recursive=True)
    rows.select("filename", "content").write.format("named-files").mode(mode).save(path)
