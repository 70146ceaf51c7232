"""Publishing a folder with a commit protocol: copies first, then their digests, the receipt last."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .digests import CHUNK, chunks, content_digest, list_files, open_store, stream_digest
from .jsonl import _path, exists, read_document, write_document
from .tables import stage_boundary

#: A published folder without this document isn't complete.
RECEIPT = "upload.json"


def copy_file(source: str, target: str, size: int = CHUNK) -> tuple[int, str, str]:
    """(bytes, SHA-256 of the source, what was done): a file with the same bytes and digest is kept; else it is copied beside its place and moved there."""
    n, digest = stream_digest(source, size)
    store, place = open_store(target)
    from pyarrow import fs

    if store.get_file_info(place).type == fs.FileType.File and stream_digest(target, size) == (n, digest):
        return n, digest, "kept"
    store.create_dir(posixpath.dirname(place), recursive=True)
    beside = f"{posixpath.dirname(place)}/.{posixpath.basename(place)}.part"
    with store.open_output_stream(beside) as out:
        for block in chunks(source, size):
            out.write(block)
    store.move(beside, place)
    return n, digest, "copied"


def _absolute(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    return fs.makeQualified(p).toString()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path) of a folder's files, but its receipt; names are below the folder."""
    root = _absolute(spark, folder)
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    files = list_files(spark, folder).select("path", F.substring(plain(F.col("path")), len(_plain(root)) + 2, 1 << 20).alias("name"))
    return files.where(F.col("name") != RECEIPT)


def _plain(path: str) -> str:
    rest = path.removeprefix("file:")
    return "/" + rest.lstrip("/").rstrip("/") if rest != path else path.rstrip("/")


def copy_folder(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(name, bytes, sha256, done) of all files of a folder, copied by the executors, a file a task at a time; safe to repeat."""
    goal = _absolute(spark, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, digest, done = copy_file(path, f"{goal}/{name}")
                yield pa.RecordBatch.from_pydict({"name": [name], "bytes": [n], "sha256": [digest], "done": [done]})

    return stage_boundary(_files(spark, source).select("name", "path").mapInArrow(run, "name string, bytes long, sha256 string, done string"))


def folder_digest(spark: SparkSession, files: DataFrame) -> str:
    """A digest of (name, sha256), whatever their order."""
    return content_digest(files, "name", "sha256").first().digest


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of a folder's files as they are now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, digest = stream_digest(path)
                yield pa.RecordBatch.from_pydict({"name": [name], "bytes": [n], "sha256": [digest]})

    return _files(spark, folder).select("name", "path").mapInArrow(run, "name string, bytes long, sha256 string")


def _verified(spark: SparkSession, copied: DataFrame, target: str) -> None:
    now = read_back(spark, target).select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    wrong = copied.join(now, "name", "left").where("_sha IS NULL OR _sha <> sha256 OR _bytes <> bytes")
    n, first = wrong.agg(F.count("*"), F.min("name")).first()
    if n:
        raise OSError(f"{target}: {n} files differ from their source, the first is {first}")


def publish(spark: SparkSession, source: str, target: str) -> dict[str, Any]:
    """Copy a folder, read the copies back, and write the receipt last; returns it.

    Until the receipt is there the target isn't complete.  A run that was stopped anywhere is repeated: files whose bytes are there already are kept, a
    receipt of other content is taken away first.  Files of the target that the source hasn't are not part of what is published.
    """
    if not exists(spark, source):
        raise FileNotFoundError(source)
    receipt = f"{target}/{RECEIPT}"
    if exists(spark, receipt):
        own = folder_digest(spark, read_back(spark, source))
        if read_document(spark, receipt)["digest"] != own:
            p, fs = _path(spark, receipt)
            fs.delete(p, False)
    copied = copy_folder(spark, source, target)
    _verified(spark, copied, target)
    n, size, kept = copied.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.count_if(F.col("done") == "kept")).first()
    out = {"status": "complete", "target": target, "files": n, "bytes": size, "digest": folder_digest(spark, copied)}
    write_document(spark, receipt, out)
    return out | {"kept": kept, "copied": n - kept}


def is_published(spark: SparkSession, target: str) -> bool:
    return exists(spark, f"{target}/{RECEIPT}") and read_document(spark, f"{target}/{RECEIPT}").get("status") == "complete"


def pull(spark: SparkSession, published: str, target: str, digests: bool = True) -> dict[str, Any]:
    """Copy a published folder to a target; one without a receipt is refused.  The copies' digest must be the receipt's, unless digests are left out."""
    if not is_published(spark, published):
        raise FileNotFoundError(f"{published} has no receipt")
    receipt = read_document(spark, f"{published}/{RECEIPT}")
    copied = copy_folder(spark, published, target)
    if digests:
        _verified(spark, copied, target)
        if folder_digest(spark, copied) != receipt["digest"]:
            raise OSError(f"{published} isn't what its receipt says")
    write_document(spark, f"{target}/{RECEIPT}", receipt)
    return receipt


def code_digests(package: str = "granary", parts: tuple[str, ...] = ("functions", "operators", "sources", "plans")) -> dict[str, str]:
    """SHA-256 of each of the package's modules that a run can use, also where it was shipped as an archive."""
    from importlib.resources import files

    out = {}
    for part in parts:
        for f in sorted(files(package).joinpath(part).iterdir(), key=lambda f: f.name):
            if f.name.endswith(".py"):
                out[f"{part}/{f.name}"] = hashlib.sha256(f.read_bytes()).hexdigest()
    return out
