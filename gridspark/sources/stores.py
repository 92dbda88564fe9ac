"""Key-to-bytes stores. All can be pickled, so that executors open what the driver has planned.

A key that does not exist gives None; every other failure raises, so that a refused or broken read
is never taken for a chunk that was not written."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request

from ..errors import ZarrError

REMOTE = ("http://", "https://", "s3://", "gs://", "gcs://", "az://", "abfs://", "hdfs://", "viewfs://")


def is_remote(path: str) -> bool:
    return path.lower().startswith(REMOTE)


class LocalStore:
    def __init__(self, root: str):
        self.root = root

    def get(self, key: str) -> bytes | None:
        try:
            with open(os.path.join(self.root, *key.split("/")), "rb") as f:
                return f.read()
        except (FileNotFoundError, NotADirectoryError):
            return None

    def get_range(self, key: str, start: int, length: int) -> bytes | None:
        """Bytes start to start + length of a key; from the end if start is negative."""
        try:
            with open(os.path.join(self.root, *key.split("/")), "rb") as f:
                f.seek(max(start, -os.fstat(f.fileno()).st_size), os.SEEK_END if start < 0 else os.SEEK_SET)
                return f.read(length)
        except (FileNotFoundError, NotADirectoryError):
            return None

    def array_names(self) -> list[str]:
        """Arrays at any depth, by name. Arrays end the descent; links to folders are not followed."""
        if not os.path.isdir(self.root):
            raise ZarrError(f"no store at '{self.root}'")
        found, todo = [], [""]
        while todo:
            at = todo.pop()
            with os.scandir(os.path.join(self.root, at) if at else self.root) as entries:
                folders = [e.name for e in entries if e.is_dir(follow_symlinks=False)]
            for name in folders:
                path = f"{at}/{name}" if at else name
                node = self.get(f"{path}/zarr.json")
                if node is not None:
                    (todo if json.loads(node).get("node_type") == "group" else found).append(path)
                elif self.get(f"{path}/.zarray") is not None:
                    found.append(path)
                else:
                    todo.append(path)
        return sorted(found)


_DOCUMENTS = ("zarr.json", ".zarray", ".zattrs", ".zgroup")


class _Listed:
    """A store that can't be walked: its arrays come from consolidated metadata, which is read once.
    From then on no array's own metadata is asked for."""

    where = ""
    _documents: dict[str, bytes] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_documents"}

    def fetch(self, key: str, start: int = 0, length: int | None = None) -> bytes | None:
        """The bytes of a key, or of a part of it."""
        raise NotImplementedError

    def get(self, key: str) -> bytes | None:
        if self._documents is not None and key.rsplit("/", 1)[-1] in _DOCUMENTS:
            return self._documents.get(key)
        return self.fetch(key)

    def get_range(self, key: str, start: int, length: int) -> bytes | None:
        """Bytes start to start + length of a key; from the end if start is negative."""
        return self.fetch(key, start, length)

    def consolidated(self) -> dict[str, bytes]:
        """Key -> metadata document, of all arrays."""
        root = self.fetch("zarr.json")
        if root is not None:
            inner = (json.loads(root).get("consolidated_metadata") or {}).get("metadata")
            if inner is not None:
                return {f"{k.strip('/')}/zarr.json": json.dumps(v).encode() for k, v in inner.items() if v.get("node_type") == "array"}
        flat = self.fetch(".zmetadata")
        if flat is not None:
            return {k: json.dumps(v).encode() for k, v in json.loads(flat).get("metadata", {}).items()}
        raise ZarrError(f"remote store '{self.where}' has no consolidated metadata in zarr.json or .zmetadata; write it again with consolidated metadata")

    def array_names(self) -> list[str]:
        if self._documents is None:
            self._documents = self.consolidated()
        return sorted(k.rsplit("/", 1)[0] for k in self._documents if k.endswith(("/zarr.json", "/.zarray")))


class HttpStore(_Listed):
    def __init__(self, root: str, timeout: float = 60.0):
        self.where, self.timeout = root.rstrip("/"), timeout

    def fetch(self, key: str, start: int = 0, length: int | None = None) -> bytes | None:
        ask = urllib.request.Request(f"{self.where}/{urllib.parse.quote(key)}")
        if length is not None:
            ask.add_header("Range", f"bytes={start}" if start < 0 else f"bytes={start}-{start + length - 1}")
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
                data = answer.read()
                if length is None or answer.status == 206:
                    return data
                return data[start:][:length]  # the server doesn't know ranges
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return None
            raise ZarrError(f"reading '{self.where}/{key}' failed: HTTP {e.code}") from e


class FileSystemStore(_Listed):
    """Object stores and HDFS by pyarrow; credentials come from its environment or from options."""

    def __init__(self, uri: str, options: dict[str, str] | None = None):
        self.where, self.options = uri.rstrip("/"), dict(options or {})
        self._open = None

    def __getstate__(self) -> dict:
        return {**super().__getstate__(), "_open": None}

    def _files(self):  # noqa: ANN202
        if self._open is None:
            from pyarrow import fs

            scheme, _, rest = self.where.partition("://")
            if scheme == "s3" and self.options:
                self._open = fs.S3FileSystem(**self.options), rest
            elif scheme in ("gs", "gcs") and self.options:
                self._open = fs.GcsFileSystem(**self.options), rest
            elif scheme == "az":
                self._open = fs.AzureFileSystem(**self.options), rest
            else:
                self._open = fs.FileSystem.from_uri(self.where)
        return self._open

    def fetch(self, key: str, start: int = 0, length: int | None = None) -> bytes | None:
        files, root = self._files()
        try:
            if length is None:
                with files.open_input_stream(f"{root}/{key}") as f:
                    return f.read()
            with files.open_input_file(f"{root}/{key}") as f:
                f.seek(max(0, f.size() + start) if start < 0 else start)
                return f.read(length)
        except FileNotFoundError:
            return None


def open_store(path: str, options: dict[str, str] | None = None) -> LocalStore | HttpStore | FileSystemStore:
    low = path.lower()
    if low.startswith(("http://", "https://")):
        return HttpStore(path)
    if is_remote(path):
        return FileSystemStore(path, options)
    if low.startswith("file://"):
        path = urllib.parse.unquote(urllib.parse.urlparse(path).path)
    elif low.startswith("file:"):
        path = path[5:]
    return LocalStore(path)
