"""Files that are read in blocks where their paths are: size, digest, NUL and control bytes, and failures as rows.

The inventory is a table of paths, so any number of files is dealt to the tasks like other rows, and a task holds one block
of one file at a time. A file that is not there, or that cannot be opened or read to its end, is a row with an error; it
stops nothing. The root may be any address that Arrow's file systems know; executors must reach it.

Edge cases: an empty file has no bytes and the digest of nothing; a folder is no file (FILE_STAT_FAILED); a null path has
the error FILE_STAT_FAILED; paths that come twice are read twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of a block; the share in percent of control bytes from which on a file is binary.
BLOCK, CONTROL = 64 << 10, 30
FACTS = "path string, length long, sha256 string, nul long, control long, binary boolean, error string"
_CONTROL = np.zeros(256, bool)
_CONTROL[:32] = True
_CONTROL[[9, 10, 12, 13]] = False


def _facts(files: fs.FileSystem, path: str | None, at: str) -> tuple:
    """The row of one file."""
    try:
        if path is None or files.get_file_info(at).type != fs.FileType.File:
            return path, None, None, None, None, None, "FILE_STAT_FAILED"
    except OSError:
        return path, None, None, None, None, None, "FILE_STAT_FAILED"
    digest, size, nul, control = hashlib.sha256(), 0, 0, 0
    try:
        with files.open_input_stream(at, buffer_size=0) as stream:
            while block := stream.read(BLOCK):
                digest.update(block)
                counts = np.bincount(np.frombuffer(block, np.uint8), minlength=256)
                size, nul, control = size + len(block), nul + int(counts[0]), control + int(counts[_CONTROL].sum())
    except OSError:
        return path, None, None, None, None, None, "FILE_READ_FAILED"
    return path, size, digest.hexdigest(), nul, control, nul > 0 or 100 * control > CONTROL * size, None


def facts(paths: DataFrame, root: str) -> DataFrame:
    """FACTS of the files path, relative to root, of a table of paths."""
    ship(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = [_facts(files, p, f"{base.rstrip('/')}/{p}") for p in batch.column(0).to_pylist()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in FACTS.split(", ")])

    return paths.select(F.col("path").cast("string").alias("path")).mapInArrow(run, FACTS)


def written(rows: DataFrame, root: str) -> DataFrame:
    """Writes content (binary) to path below root, each file as a whole under a name of its own first; (path, length).

    The result is a plan: the files are written when it is run, and again if a task is run again.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            lengths = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{base.rstrip('/')}/{path}"
                files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(f"{at}.part") as out:
                    out.write(content or b"")
                files.move(f"{at}.part", at)
                lengths.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["path", "length"])

    return rows.select("path", "content").mapInArrow(run, "path string, length long")
