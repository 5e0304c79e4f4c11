"""Files that other tools read: one named text file per recording, and vector archives with their index.

Both sinks are data sources with a two-phase commit: tasks write into a folder of the run beside the target,
the commit moves what successful tasks wrote into place, and an abort leaves nothing.  Paths may be of any
store that ``pyarrow.fs`` reaches; executors and driver must see the same one.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def file_system(path: str):
    """File system and inner path of a path or URI."""
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), path


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Files and sizes of a file, a folder, or a pattern in the last part of the path, by name; hidden ones are left out."""
    from pyarrow import fs

    folder, _, last = path.rstrip("/").rpartition("/")
    system, inner = file_system(folder + "/" if re.search(r"[*?\[]", last) else path)
    if re.search(r"[*?\[]", last):
        found = [i for i in system.get_file_info(fs.FileSelector(inner.rstrip("/") or "/")) if fnmatch.fnmatch(i.base_name, last)]
    else:
        one = system.get_file_info(inner)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name.endswith(suffix) and i.base_name[0] not in "._")


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written: where they are, and what they are to be called."""

    files: list = field(default_factory=list)


class Staged(DataSourceWriter):
    """Tasks write below ``<path>/_run-<id>``; the commit moves their files up."""

    def __init__(self, path: str, suffixes: tuple[str, ...], overwrite: bool):
        self.path, self.suffixes, self.overwrite = path.rstrip("/"), suffixes, overwrite
        self.run = f"_run-{uuid.uuid4().hex}"

    def task_folder(self):
        """The file system and a folder of this attempt alone."""
        task = TaskContext.get()
        system, inner = file_system(self.path)
        folder = f"{inner}/{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(folder)
        return system, folder

    def commit(self, messages):
        system, inner = file_system(self.path)
        system.create_dir(inner)
        names = set()
        for message in messages:
            for at, name in message.files if message else ():
                if name in names:
                    raise ValueError(f"two tasks wrote {name}")
                names.add(name)
                system.move(at, f"{inner}/{name}")
        if self.overwrite:
            for old, _ in listed(self.path):
                if old.rpartition("/")[2] not in names and old.endswith(self.suffixes):
                    system.delete_file(old)
        self.sweep()

    def abort(self, messages):
        self.sweep()

    def sweep(self):
        from pyarrow import fs

        system, inner = file_system(self.path)
        if system.get_file_info(f"{inner}/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{inner}/{self.run}")


class LineWriter(Staged):
    def __init__(self, path, suffix, overwrite):
        super().__init__(path, (suffix,), overwrite)
        self.suffix = suffix

    def write(self, iterator):
        system, folder = self.task_folder()
        done, name, out = Written(), None, None
        try:
            for row in iterator:
                if row.name != name or out is None:
                    if out:
                        out.close()
                    name = row.name
                    if name is None or "/" in name or name[:1] in ("", ".", "_"):
                        raise ValueError(f"{name!r} cannot name a file")
                    file = f"{name}{self.suffix}"
                    out = system.open_output_stream(f"{folder}/{file}")
                    done.files.append((f"{folder}/{file}", file))
                out.write((row.value + "\n").encode())
        finally:
            if out:
                out.close()
        return done


class NamedLines(DataSource):
    """``df.write.format("named_lines")``: lines ``name, value``, sorted by ``name``, as ``<path>/<name><suffix>``."""

    @classmethod
    def name(cls):
        return "named_lines"

    def schema(self):
        return "name string, value string"

    def writer(self, schema, overwrite):
        return LineWriter(self.options["path"], self.options.get("suffix", ""), overwrite)
