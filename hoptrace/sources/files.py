"""Bytes of files on any file system that a URI names, for formats that Spark has no reader of."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there. Paths without a scheme are local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def opened(path: str):
    """(file, size): random access to a file's bytes; only the ranges that are read are fetched."""
    system, inner = located(path)
    return system.open_input_file(inner), system.get_file_info(inner).size


def parts(path: str, ending: str) -> list[str]:
    """The files of a folder that end so, in order of their names, or the one file itself."""
    system, inner = located(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name.endswith(ending))
    return [f"{path.rstrip('/')}/{n}" for n in names]
