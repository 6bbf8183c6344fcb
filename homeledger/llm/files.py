"""Files written by executors: temporary names, then a rename, on any store that pyarrow reaches."""

from __future__ import annotations

import posixpath
import uuid
from functools import lru_cache

from pyarrow import fs as pafs


#: Schemes of Hadoop's connectors that pyarrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def resolved(spark, root: str) -> str:
    """root with its scheme, as Spark would resolve it: without one it is a path of the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


@lru_cache(maxsize=16)
def _store(root: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, path = root.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + path.lstrip("/")
    if not path.startswith("//"):
        raise ValueError(f"{root} has no scheme: executors cannot tell which file system is meant")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{path}")


def write(root: str, name: str, data: bytes) -> None:
    """Writes root/name whole or not at all; attempts that write the same name write the same bytes."""
    store, at = _store(root)
    store.create_dir(at, recursive=True)
    temporary = posixpath.join(at, f".{name}.{uuid.uuid4().hex}.tmp")
    with store.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    final = posixpath.join(at, name)
    store.move(temporary, final)


def read(root: str, name: str, offset: int = 0, size: int | None = None) -> bytes:
    store, at = _store(root)
    with store.open_input_file(posixpath.join(at, name)) as f:
        if offset < 0:
            offset += f.size()
        f.seek(offset)
        return f.read() if size is None else f.read(size)
