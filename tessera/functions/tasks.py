"""What functions that tasks run have in common."""

from __future__ import annotations


def lean(run):
    """A task's function that takes Arrow's buffers from the C heap and gives the heap's free pages back at its end, so a reused worker stays small."""

    def task(batches):
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return task


# Names that Hadoop's and Arrow's file systems have for the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(uri: str) -> str:
    """A Hadoop path as Arrow's file systems name it."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return f"file://{uri}"
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def file_system(uri: str):
    """(Arrow file system, path in it) of a file on whatever store the shared folder is on."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))
