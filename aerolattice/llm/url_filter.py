"""URL filter over a sorted array of digests.

The rules' keys (host and path prefix) are hashed with 64-bit xxHash and sorted; the full strings are stored in the same
order. Executors memory-map both files, which Spark distributes, probe them by vectorised binary search, and confirm
each hit against the stored string, so a collision of digests can't decide.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The contract's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The verdict where no rule fits: the index is a list of exceptions, so what it doesn't hold may pass.
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Index:
    """Sorted digests, with the rules' strings in the same order as one run of bytes and its offsets."""

    PARTS = ("keys", "offsets", "strings", "lengths")

    def __init__(self, paths: Sequence[str]):
        """``paths`` of the files of ``PARTS``, in that order."""
        self.keys, self.offsets, self.strings = (np.load(p, mmap_mode="r") for p in paths[:3])
        self.lengths = [int(x) for x in np.load(paths[3])]

    @staticmethod
    def digests(keys: Sequence[str]) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))

    @classmethod
    def write(cls, rules: Sequence[tuple[str, str, str]], paths: Sequence[str]) -> None:
        """Rules are (host, path prefix, verdict). A key's later verdict replaces an earlier one."""
        table = {h.translate(str.maketrans(UPPER, LOWER)) + "\0" + p: v for h, p, v in rules}
        names = list(table)
        keys = cls.digests(names)
        order = np.lexsort((np.array(names, dtype=object).astype(str), keys)) if names else np.array([], dtype=int)
        lines = [f"{names[i]}\0{table[names[i]]}".encode() for i in order]
        parts = [keys[order], np.cumsum([0, *map(len, lines)]), np.frombuffer(b"".join(lines), dtype=np.uint8), np.array(sorted({len(p) for _, p, _ in rules}), dtype=np.int64)]
        for path, part in zip(paths, parts):
            np.save(path, part)

    def probe(self, names: Sequence[str]) -> list[str | None]:
        """The verdict of each key, or None."""
        wanted = self.digests(names)
        first = np.searchsorted(self.keys, wanted, side="left")
        last = np.searchsorted(self.keys, wanted, side="right")
        out: list[str | None] = [None] * len(names)
        for k in np.flatnonzero(last > first):
            for at in range(first[k], last[k]):  # several only where digests collide
                key, _, verdict = self.strings[self.offsets[at] : self.offsets[at + 1]].tobytes().decode().rpartition("\0")
                if key == names[k]:
                    out[k] = verdict
        return out

    def judge(self, hosts: Sequence[str], paths: Sequence[str]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of the longest rule that fits; of two as long, the one with the longer host."""
        names: list[str] = []
        owner: list[int] = []
        for k, (host, path) in enumerate(zip(hosts, paths)):
            ends = [host] + [host[i + 1 :] for i, c in enumerate(host) if c == "."]
            here = [f"{h}\0{path[:n]}" for h in ends if h for n in self.lengths if n <= len(path)]
            names += here
            owner += [k] * len(here)
        best: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        length = [(-1, -1)] * len(hosts)
        for k, name, verdict in zip(owner, names, self.probe(names)):
            if verdict is not None and (size := (len(name) - 1, name.index("\0"))) > length[k]:
                length[k], best[k] = size, (name.replace("\0", "", 1), verdict)
        return best


def distribute(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> list[str]:
    """Write the index's files and hand them to Spark's file distribution (which takes files, not folders, on a cluster);
    it also serves executors that start later. Gives the files' names."""
    folder, run = tempfile.mkdtemp(prefix="aerolattice-"), uuid.uuid4().hex
    names = [f"urlindex-{run}-{part}.npy" for part in Index.PARTS]
    paths = [os.path.join(folder, n) for n in names]
    Index.write(rules, paths)
    for path in paths:
        spark.sparkContext.addFile(path)
    return names


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each input row: ``page_id, host, path, rule`` (host and prefix, null where none fits), ``verdict``.

    A rule fits its host and all subdomains where the path starts with the rule's. A null url, or one without ``://``,
    has an empty host and path, which no rule fits. Row-local: no shuffle; only the id and the url are read.
    """
    index = distribute(pages.sparkSession, rules)
    schema = f"page_id {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string"

    def run(batches):
        found = Index([SparkFiles.get(name) for name in index])
        for batch in batches:
            hosts, paths = batch.column("host"), batch.column("path")
            best = found.judge(hosts.to_pylist(), paths.to_pylist())
            rule, verdict = pa.array([r for r, _ in best], pa.string()), pa.array([v or default for _, v in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), hosts, paths, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    url = F.col(url_col)
    return pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(run, schema)


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> str:
    ordered = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), reverse=True)
    fit = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = " ".join(f"when {fit(h, p)} then '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"when {fit(h, p)} then '{v}'" for h, p, v in ordered)
    return rf"""
with r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path, case {rule} end as rule, case {verdict} else '{default}' end as verdict from h
"""
