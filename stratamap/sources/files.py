"""Files of extracts on local disks and on whatever file systems Arrow knows (HDFS, object stores)."""

from __future__ import annotations

import fnmatch
import io
import os
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyarrow import fs

#: Bytes read ahead on remote files, so that a scan of small headers takes few requests.
READ_AHEAD = 1 << 16


def local_path(path: str) -> str | None:
    """The plain path of a local file, None for a remote one."""
    u = urlparse(path)
    if u.scheme == "file":
        return unquote(u.path)
    return path if "://" not in path else None


def open_file(path: str) -> BinaryIO:
    """A seekable, buffered reader."""
    p = local_path(path)
    if p is not None:
        return open(p, "rb")
    system, p = fs.FileSystem.from_uri(path)
    return io.BufferedReader(system.open_input_file(p), READ_AHEAD)


def file_size(path: str) -> int:
    p = local_path(path)
    if p is not None:
        return os.path.getsize(p)
    system, p = fs.FileSystem.from_uri(path)
    return system.get_file_info(p).size


def _remote(part: str) -> list[str]:
    scheme = part.split("://", 1)[0]
    fixed = part
    while any(c in fixed for c in "*?["):
        fixed = fixed.rsplit("/", 1)[0]
    system, root = fs.FileSystem.from_uri(fixed)
    authority = fixed[: len(fixed) - len(root)] if fixed.endswith(root) else f"{scheme}://"
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(part)
    if info.type == fs.FileType.File:
        return [part]
    names = [authority + f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    return names if fixed == part else [n for n in names if fnmatch.fnmatch(n, part)]


def _local(p: str) -> list[str]:
    import glob

    if os.path.isdir(p):
        return [os.path.join(d, f) for d, _, names in os.walk(p) for f in names]
    if any(c in p for c in "*?["):
        return [f for f in glob.glob(p) if os.path.isfile(f)]
    if os.path.exists(p):
        return [p]
    raise FileNotFoundError(p)


def list_files(spec: str) -> list[str]:
    """Files of a comma-separated list of files, folders and patterns, sorted; hidden files and markers are left out."""
    out: list[str] = []
    for part in filter(None, (x.strip() for x in spec.split(","))):
        p = local_path(part)
        out += [f for f in (_local(p) if p is not None else _remote(part)) if f.rsplit("/", 1)[-1][0] not in "._"]
    return sorted(set(out))


class Folder:
    """A folder that files are written to under hidden names and then given their own."""

    def __init__(self, path: str):
        p = local_path(path)
        self.fs, self.root = (fs.LocalFileSystem(), os.path.abspath(p)) if p is not None else fs.FileSystem.from_uri(path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(self.at(name))

    def names(self) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return [f.base_name for f in found if f.type == fs.FileType.File]

    def tree(self, name: str) -> list[str]:
        """All files below a folder in it, none where there is no such folder; hidden files and markers are left out."""
        found = self.fs.get_file_info(fs.FileSelector(self.at(name), allow_not_found=True, recursive=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")

    @classmethod
    def remove(cls, path: str) -> None:
        """Delete a folder with all in it, if it is there and can be deleted."""
        try:
            folder = cls(path)
            folder.fs.delete_dir(folder.root)
        except OSError:
            pass

    def delete(self, name: str) -> None:
        self.fs.delete_file(self.at(name))

    def rename(self, old: str, new: str) -> None:
        self.fs.move(self.at(old), self.at(new))
