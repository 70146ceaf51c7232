"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stage_boundary
from ._arrow import map_batches
from ._kernel import LOWER, class_table, string_column, text_blocks, words
from .jaccard_join import join_few

# The base kinds, in their order.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same runs as [0-9a-f]+ of 32 characters or more
KINDS = ("assign", "access", "hex", "live", "copied")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_HEX_BYTES = class_table([(0x30, 0x39), (0x61, 0x66)])


def base_spans(text: str, assign: bool = True, access: bool = True, hexa: bool = True) -> list[tuple[int, int, int, int]]:
    """(start, kind's number, end, start of the secret itself) of all base places, in order."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if access:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hexa:
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def live_looking(value: str) -> bool:
    """No placeholder: digits beside letters, and 3 bits or more of entropy a character."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    p = np.unique(np.frombuffer(value.encode(), np.uint8), return_counts=True)[1] / len(value)
    return float(-(p * np.log2(p)).sum()) >= 3.0


def _hits(data: np.ndarray, offsets: np.ndarray, needles: tuple[bytes, ...]) -> np.ndarray:
    """Which documents hold one of the needles; a needle across two documents only costs a look."""
    raw, found = data.tobytes(), np.zeros(len(offsets) - 1, bool)
    for needle in needles:
        at = raw.find(needle)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, side="right")) - 1
            found[d] = True
            at = raw.find(needle, int(offsets[d + 1]) if offsets[d + 1] > at else at + 1)
    return found


def find_candidates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "source", owner: str = "lang") -> DataFrame:
    """One row per input row: its base counts and spans, and each secret's place, digest and look.

    Whole texts are read; only those with a keyword, AKIA or 32 hex digits in a row come to Python's regular expressions.
    """

    def batch(b):
        n = b.num_rows
        column = string_column(b.column(1))
        look = np.zeros((3, n), bool)
        for i, j, data, offs in text_blocks(column):
            look[0, i:j] = _hits(LOWER[data], offs, KEYWORDS)
            look[1, i:j] = _hits(data, offs, (b"AKIA",))
            starts, ends = words(data, offs, _HEX_BYTES)
            long = starts[ends - starts >= 32]
            look[2, i + np.searchsorted(offs, long, side="right") - 1] = True
        counts, base, found = [[0] * n for _ in range(3)], [""] * n, [[] for _ in range(n)]
        for d in np.flatnonzero(look.any(axis=0)):
            t = column[int(d)].as_py()
            spans = base_spans(t, *look[:, d])
            for s, k, e, v in spans:
                counts[k][d] += 1
                value = t[v:e]
                found[d].append({"h": hashlib.sha256(value.encode()).hexdigest()[:32], "s": v, "e": e, "live": live_looking(value)})
            base[d] = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)
        yield {
            "doc_id": b.column(0), "repo": b.column(2), "owner": b.column(3),
            "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base": base,
            "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in base], "found": found,
        }

    schema = "doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base string, base_sha256 string, found array<struct<h: string, s: long, e: long, live: boolean>>"
    return map_batches(df, schema, batch, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(repository).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"))


def ownership_frequency(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each secret: (h, n_repos, n_owners, n_places).

    The counts are of distinct (secret, repository, owner) triples, summed map-side first,
    so a secret that a third of all rows hold reaches the second step as few rows.
    """
    triples = candidates.select("repo", "owner", F.explode("found").alias("c")).groupBy(F.col("c.h").alias("h"), "repo", "owner").agg(F.count("*").alias("n"))
    return triples.groupBy("h").agg(
        F.countDistinct(F.coalesce(F.col("repo"), F.lit("\0"))).alias("n_repos"),
        F.countDistinct(F.coalesce(F.col("owner"), F.lit("\0"))).alias("n_owners"),
        F.sum("n").alias("n_places"),
    )


def scan_secrets(df: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "source", owner: str = "lang", copied_repos: int = 3) -> DataFrame:
    """Secrets of each document; live and copied ones told apart by how many repositories and owners hold them.

    A secret held by ``copied_repos`` repositories or more, or by several owners, is widely copied: an example, documentation, a vendored file ("copied").
    One that fewer hold and that looks random is owner-specific ("live"); others keep only their base kind.
    Live and copied spans cover the secret's own characters; places are code points, ends exclusive.
    One row per input row; null or empty texts have no spans; a null repository or owner counts as one of its own.
    Identical rows are each returned; further columns are ignored; an empty table gives no rows.
    """
    found = stage_boundary(find_candidates(df, text, doc_id, repository, owner).withColumn("row", F.monotonically_increasing_id()))
    frequency = stage_boundary(ownership_frequency(found))
    places = found.select("row", F.explode("found").alias("c")).select("row", "c.*")
    verdict = F.when((F.col("n_repos") >= copied_repos) | (F.col("n_owners") > 1), F.lit("copied")).when(F.col("live"), F.lit("live"))
    judged = join_few(places, frequency, "h", "row").withColumn("kind", verdict).where("kind is not null")
    added = judged.groupBy("row").agg(
        F.collect_set(F.struct("s", F.when(F.col("kind") == "live", 3).otherwise(4).alias("k"), "e")).alias("added"),
        F.count_distinct(F.when(F.col("kind") == "live", F.col("h"))).alias("n_live"),
        F.count_distinct(F.when(F.col("kind") == "copied", F.col("h"))).alias("n_copied"),
    )
    parts = F.expr("transform(filter(split(base, ','), x -> x <> ''), x -> struct(cast(split(x, ':')[1] as long) as s, array_position(array('assign', 'access', 'hex'), split(x, ':')[0]) - 1 as k, cast(split(x, ':')[2] as long) as e))")
    every = F.array_sort(F.concat(parts.cast("array<struct<s: long, k: int, e: long>>"), F.coalesce(F.col("added").cast("array<struct<s: long, k: int, e: long>>"), F.expr("cast(array() as array<struct<s: long, k: int, e: long>>)"))))
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.join(added, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied")
    )
