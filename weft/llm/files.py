"""Files that tasks read and write by themselves, by Hadoop-style URIs."""

from __future__ import annotations


def filesystem(uri: str):
    """pyarrow's file system for a URI, and the path in it.  Plain paths and ``file:`` are local to
    the machine, so for writing they must lie in a folder that all machines share."""
    from pyarrow import fs

    for ours in ("s3a://", "s3n://"):
        uri = "s3://" + uri[len(ours):] if uri.startswith(ours) else uri
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
