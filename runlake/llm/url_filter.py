"""URL filter over a sorted digest array.

Patterns are ``host`` + start of path; one fits its host and all subdomains if
the URL's path starts with the pattern's.  The patterns are sorted by their
64-bit xxhash and written to three flat files in the shared folder: digests,
string offsets and the strings themselves.  Spark ships the files to every
executor, tasks map them into memory, and a batch of URLs is probed with one
vectorised binary search over all its candidate patterns (every host suffix
with every path length that occurs).  A digest hit only counts if the stored
string equals the candidate, so collisions cannot match.

The files are at most ``MAX_PATTERNS`` patterns (checked); tasks read only the
pages of them that a probe touches.  Among fitting patterns the longest wins,
then the one with the longer host.

A null URL, or one without ``://``, has empty host and path and fits nothing.
Repeated rows are judged each; only the key and URL columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.session import ensure_checkpoint_dir

MAX_PATTERNS = 20_000_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII-lower-cased) and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class DigestIndex:
    """Sorted digests, offsets and strings of patterns, in files that Spark ships to executors."""

    def __init__(self, names: dict[str, str], path_lengths: list[int], longest_host: int):
        self.names, self.path_lengths, self.longest_host = names, path_lengths, longest_host

    @classmethod
    def build(cls, spark: SparkSession, patterns: DataFrame) -> DigestIndex:
        """From a column ``pattern``; repeated and null patterns count once and not at all."""
        patterns = patterns.select("pattern").where("pattern is not null").distinct()
        n = patterns.count()
        if n > MAX_PATTERNS:
            raise ValueError(f"{n} patterns; the index ships at most {MAX_PATTERNS}")

        @F.pandas_udf("long")
        def digest(p: pd.Series) -> pd.Series:
            return pd.Series([xxhash.xxh64_intdigest(x.encode()) - (1 << 63) for x in p], dtype="int64")

        tag, base = uuid.uuid4().hex, ensure_checkpoint_dir(spark).rstrip("/")
        names = {k: f"url-{k}-{tag}" for k in ("digests", "offsets", "strings")}
        hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        out = {}
        for k, name in names.items():
            path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
            out[k] = path.getFileSystem(hadoop).create(path)
        end, lengths, longest, part = 0, set(), 0, {k: bytearray() for k in names}

        def flush() -> None:
            for k in names:
                out[k].write(part[k])
                part[k].clear()

        for row in patterns.select(digest("pattern").alias("d"), "pattern").orderBy("d", "pattern").toLocalIterator():
            text = row["pattern"].encode()
            part["digests"] += np.uint64(row["d"] + (1 << 63)).tobytes()
            part["offsets"] += np.uint64(end).tobytes()
            part["strings"] += text
            end += len(text)
            host = len(row["pattern"].partition("/")[0])
            lengths.add(len(row["pattern"]) - host)
            longest = max(longest, host)
            if len(part["strings"]) > 1 << 20:
                flush()
        part["offsets"] += np.uint64(end).tobytes()
        part["strings"] += b"\0"                      # an empty file cannot be mapped
        part["digests"] += b"\0" * 8 * (n == 0)
        flush()
        for k, name in names.items():
            out[k].close()
            spark.sparkContext.addFile(f"{base}/{name}")
        return cls(names, sorted(lengths), longest)

    def open(self) -> _OpenIndex:
        return _OpenIndex(self)


class _OpenIndex:
    def __init__(self, index: DigestIndex):
        def mapped(k: str, kind: str) -> np.memmap:
            return np.memmap(SparkFiles.get(index.names[k]), dtype=kind, mode="r")

        self.offsets, self.strings = mapped("offsets", "<u8"), mapped("strings", "u1")
        self.digests = mapped("digests", "<u8")[:len(self.offsets) - 1]
        self.path_lengths, self.longest_host = index.path_lengths, index.longest_host

    def candidates(self, host: str, path: str) -> list[str]:
        """Patterns that would fit, best first; host suffixes longer than any stored host cannot."""
        if not host:
            return []
        first = max(len(host) - self.longest_host, 0)
        starts = [0] * (first == 0) + [k + 1 for k in range(max(first - 1, 0), len(host)) if host[k] == "."]
        found = [(len(host) - k + n, len(host) - k, host[k:] + path[:n])
                 for k in starts for n in self.path_lengths if n <= len(path)]
        return [c[2] for c in sorted(found, reverse=True)]

    def holds(self, candidates: list[str]) -> np.ndarray:
        """Which candidates are stored patterns."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass")) for c in candidates),
                             dtype=np.uint64, count=len(candidates))
        at = np.searchsorted(self.digests, hashes)
        found = np.zeros(len(candidates), dtype=bool)
        inside = at < len(self.digests)
        for i in np.flatnonzero(inside)[self.digests[at[inside]] == hashes[inside]]:
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == hashes[i]:      # equal digests stand together
                if self.strings[int(self.offsets[k]):int(self.offsets[k + 1])].tobytes() == candidates[i].encode():
                    found[i] = True
                    break
                k += 1
        return found


def matched(urls: DataFrame, index: DigestIndex, host: str = "host", path: str = "path", name: str = "pattern") -> DataFrame:
    """Adds the best fitting pattern (null: none)."""
    @F.pandas_udf("string")
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        opened = index.open()
        for hosts, paths in batches:
            lists = [opened.candidates(h, p) for h, p in zip(hosts, paths)]
            flat = [c for row in lists for c in row]
            hit = opened.holds(flat)
            at, out = 0, []
            for row in lists:
                k = np.flatnonzero(hit[at:at + len(row)])
                out.append(row[int(k[0])] if len(k) else None)
                at += len(row)
            yield pd.Series(out, dtype=object)

    return urls.withColumn(name, best(host, path))


def judged(pages: DataFrame, rules: dict[str, str], blocked: list[str]) -> DataFrame:
    """page_id, host, path, rule, verdict, listed: the longest rule decides, else whether a blocked pattern fits."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    for name, patterns in (("rule", list(rules)), ("listed", blocked)):
        index = DigestIndex.build(spark, spark.createDataFrame([(p,) for p in patterns], "pattern string"))
        urls = matched(urls, index, name=name)
    verdict = F.when(F.col("listed").isNotNull(), "block").otherwise("allow")
    for rule, decision in rules.items():
        verdict = F.when(F.col("rule") == rule, decision).otherwise(verdict)
    return urls.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
