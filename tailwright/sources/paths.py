"""Files of a path, and opening them, in any store that Arrow reads."""

from __future__ import annotations

import io


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str | list[str], suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files in a folder with that ending and without a leading dot or underscore."""
    if not isinstance(path, str):
        return [x for p in path for x in files_of(p, suffix)]
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_")) and x.path.endswith(suffix)]
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return [(prefix + x.path, x.size) for x in sorted(found, key=lambda x: x.path)]


def opened(path: str):
    """A file to be read at any place, buffered."""
    system, root = _system(path)
    return io.BufferedReader(system.open_input_file(root), 1 << 16)


def streamed(path: str):
    """A file to be read from its beginning, as it is."""
    system, root = _system(path)
    return system.open_input_stream(root, compression=None)
