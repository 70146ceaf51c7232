"""Run options, their checks, digests and guards."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import SparkSession

from ..functions.buckets import BUCKETS, normalized_buckets
from ..functions.text import two_parts
from ..sources.digests import content_digest
from ..sources.jsonl import exists, json_digest, read_document, read_lines, remove, write_document
from ..sources.publish import code_digests

MODES = ("replicated", "spmd_fsdp")
VIEWS = ("full", "first_sentence")
DTYPES = ("float32", "bfloat16")
#: Options that don't change what a run makes.
FREE = ("overwrite", "resume", "debug_single_process", "parallel_load", "expected_slots")


@dataclass(frozen=True)
class RunConfig:
    """Options of an extraction run."""

    input: str
    output: str
    model: str = "stub"
    revision: str = "main"
    text_column: str = "text"
    answer_column: str = "best_answer"
    view: str = "full"
    start_index: int = 0
    max_samples: int | None = None
    batch_size: int = 1
    shard_size: int = 64
    buckets: tuple[int, ...] = BUCKETS
    world_size: int = 8
    mode: str = "spmd_fsdp"
    width: int = 64
    layers: int | None = None
    dtype: str = "float32"
    norm: tuple[float, ...] | None = None
    vocabulary: str | None = None
    pad_id: int = 0
    push_to: str | None = None
    store: str | None = None
    prefix: str | None = None
    expected_slots: int | None = None
    overwrite: bool = False
    resume: bool = False
    debug_single_process: bool = False
    parallel_load: bool = False
    semantics: dict[str, str] = field(default_factory=lambda: {"0..30": "after the block, before the final norm", "31": "after the last block and the final norm"})

    @property
    def writers(self) -> int:
        return 1 if self.mode == "spmd_fsdp" else self.world_size

    @property
    def effective_batch(self) -> int:
        return self.batch_size * (self.world_size if self.mode == "spmd_fsdp" else 1)

    def checked(self, spark: SparkSession | None = None) -> RunConfig:
        """With normal buckets; ValueError for options that are out of range or don't go together."""
        if self.batch_size < 1 or self.shard_size < 1 or self.world_size < 1:
            raise ValueError("batch, shard and world sizes must be positive")
        if self.mode not in MODES or self.view not in VIEWS:
            raise ValueError(f"unknown mode {self.mode!r} or view {self.view!r}")
        if self.mode == "spmd_fsdp" and (self.debug_single_process or self.parallel_load):
            raise ValueError("single-process debugging and parallel loading are for replicated runs")
        if self.dtype not in DTYPES or self.width < 1 or (self.layers is not None and self.layers < 1):
            raise ValueError(f"unknown type {self.dtype!r}, or a width or number of layers below 1")
        if self.norm is not None and (self.layers is None or len(self.norm) != self.width):
            raise ValueError("a norm has a weight per place of the last layer")
        if self.push_to is not None:
            two_parts(self.push_to)
            if self.store is None:
                raise ValueError("push_to needs the store's folder")
        if spark is not None and not exists(spark, self.input):
            raise FileNotFoundError(self.input)
        return replace(self, buckets=normalized_buckets(self.buckets))

    @property
    def published(self) -> str | None:
        """Where the artifact is published: the store's folder, OWNER/NAME and the prefix, by default the output's name."""
        if self.push_to is None:
            return None
        prefix = (self.prefix or self.output.rstrip("/").rpartition("/")[2]).strip("/")
        if not prefix:
            raise ValueError("the prefix is empty")
        return f"{self.store.rstrip('/')}/{'/'.join(two_parts(self.push_to))}/{prefix}"

    def planned(self, spark: SparkSession) -> dict[str, Any]:
        """What identifies a run, with its digest: the options, the input's content, the vocabulary's, and the code's.

        The input is read once, by the executors; its digest is the same however the file is cut, and another one for another content.
        """
        own = {k: v for k, v in asdict(self).items() if k not in FREE}
        own |= {"schema_version": 3, "buckets": list(self.buckets), "norm": None if self.norm is None else list(self.norm), "code": code_digests()}
        for name in ("input", "vocabulary"):
            path = getattr(self, name)
            if path is not None:
                own[f"{name}_content"] = content_digest(read_lines(spark, path)).first().asDict()
        return own | {"config_sha256": json_digest(own)}


def guard_output(spark: SparkSession, config: RunConfig, planned: dict[str, Any] | None = None) -> None:
    """Prepare an output folder: never one that holds the home or working folder, cleared on overwrite, reused only by the same run that resumes.

    The same run has the same options, code and content of its input.
    """
    scheme, _, rest = config.output.rpartition(":")
    if scheme in ("", "file"):
        own = os.path.realpath(os.path.expanduser("/" + rest.lstrip("/") if scheme else rest))
        if any(os.path.commonpath((own, os.path.realpath(x))) == own for x in (os.getcwd(), os.path.expanduser("~"))):
            raise ValueError(f"refusing the broad output folder {own}")
    place = f"{config.output}/run_config.json"
    if config.overwrite and exists(spark, config.output):
        remove(spark, config.output)
    planned = planned or config.planned(spark)
    if not exists(spark, place):
        write_document(spark, place, planned)
        return
    before = read_document(spark, place)
    if before != planned:
        other = sorted(k for k in before.keys() | planned.keys() if k != "config_sha256" and before.get(k) != planned.get(k))
        raise ValueError(f"{config.output} holds what other options, content or code made: {', '.join(other)}")
    if not config.resume:
        raise FileExistsError(f"{config.output} has a run; resume or overwrite it")


def completed_and_valid(spark: SparkSession, output: str, expected: int, planned: dict[str, Any] | None = None) -> bool:
    """Whether an artifact's manifest and validation say that all its records are there, made by the planned run if one is given; unreadable ones say no."""
    try:
        manifest, validation = (read_document(spark, f"{output}/{n}.json") for n in ("manifest", "validation"))
        same = planned is None or manifest.get("config_sha256") == planned["config_sha256"]
        return same and manifest.get("status") == "complete" and validation.get("valid") is True and int(manifest.get("records", -1)) == expected == int(validation.get("records", -1))
    except (FileNotFoundError, ValueError, AttributeError, TypeError):
        return False
