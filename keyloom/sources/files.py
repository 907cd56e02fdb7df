"""Files by URI for drivers and workers alike: local paths, and whatever pyarrow can reach (hdfs, s3, gs)."""

from __future__ import annotations

import fnmatch
import os

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def size_of(path: str) -> int:
    system, own = located(path)
    info = system.get_file_info(own)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def read_range(path: str, begin: int, end: int) -> bytes:
    """The bytes [begin, end) of a file, fewer at its end."""
    system, own = located(path)
    with system.open_input_file(own) as f:
        f.seek(begin)
        return f.read(max(0, end - begin))


def write_file(path: str, parts: object) -> None:
    """Write byte strings one after the other under a name of its own, and then give the file its name."""
    system, own = located(path)
    system.create_dir(os.path.dirname(own), recursive=True)
    with system.open_output_stream(f"{own}.part") as f:
        for part in parts:
            f.write(part)
    system.move(f"{own}.part", own)


def matching(pattern: str) -> list[str]:
    """The files that a path with wildcards in its last part, or several by commas, stands for; in order of name."""
    out: list[str] = []
    for part in pattern.split(","):
        folder, _, name = part.rpartition("/")
        if not any(c in name for c in "*?["):
            out.append(part)
            continue
        system, own = located(folder or ".")
        found = system.get_file_info(fs.FileSelector(own, allow_not_found=True))
        out += [f"{folder or '.'}/{i.base_name}" for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, name)]
    return sorted(out)
