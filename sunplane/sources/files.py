"""Files of any store that pyarrow knows, opened where they are read."""

from __future__ import annotations

from urllib.parse import urlsplit


def open_file(uri: str):
    """A seekable binary file."""
    import pyarrow.fs as fs

    system, path = fs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)


def list_files(uri: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file itself, or the files with one of the suffixes under a folder, in order."""
    import pyarrow.fs as fs

    scheme = urlsplit(uri).scheme
    system, path = fs.FileSystem.from_uri(uri) if scheme else (fs.LocalFileSystem(), uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.is_file:
        return [uri]
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.lower().endswith(suffixes))
    return [f"{scheme}://{p}" if scheme else p for p in found]


def suffix(uri: str) -> str:
    """The lower-case suffix, query string left out."""
    name = uri.split("?")[0].rpartition("/")[2]
    return "." + name.rpartition(".")[2].lower() if "." in name else ""
