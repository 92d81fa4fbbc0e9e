"""URL filters from sorted digest arrays.

Building: every rule, and every host that rules name, is one entry (key, value). Entries are dealt by their 64-bit xxhash
key over parts of about a million, and the task of a part writes one file: the sorted keys, the offsets of the full
strings, and the strings. Nothing but the names of the files goes through the driver, so the list may be of any length.

Judging: workers map the files into memory and probe all keys of a batch at once by vectorised binary search. A key that is found
is confirmed by its full string, and equal keys beside it are tried until the string is the same, so collisions never show. A
url's host suffixes are probed first; a suffix that is a rule's host tells the lengths of its rules' paths, and only those
prefixes of the path are probed. The longest fitting rule wins (then the one with the longest host).

Defined results: a url that is null or has no ``://`` has an empty host and path and fits no rule; A-Z of hosts are
lower-cased, in rules too; rules with a null or empty host are left out, a null path is empty; of rules that repeat a host and
path, `block` wins over `allow`; an url that no rule fits gets the default verdict and a null rule; very long urls are judged
whole; repeated rows repeat their result; an empty table gives an empty table, an empty list of rules the default everywhere. Other
columns than page_id and url are not read, so their names can't clash.
"""

from __future__ import annotations

import functools
import string
import struct
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import files_at, shared_dir

#: Entries of one file, about.
PART = 1_000_000
ALLOW, BLOCK = "allow", "block"


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def rule_key(host: str, path: str) -> bytes:
    """The host's length parts it from the path; a host alone has a key without a length."""
    return f"{len(host)}:{host}{path}".encode()


def host_key(host: str) -> bytes:
    return f":{host}".encode()


class SortedDigests:
    """One file of sorted keys with their full strings and values, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        (n,) = struct.unpack("<q", raw[:8].tobytes())
        self.n, at = n, 8
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = raw[at : at + 8 * (2 * n + 1)].view(np.int64)  # of string, value, string, ..., end
        self.strings = raw[at + 8 * (2 * n + 1) :]

    @staticmethod
    def to_bytes(entries: list[tuple[bytes, bytes]], digest: Callable[[bytes], int]) -> bytes:
        keys = np.array([digest(k) for k, _ in entries], np.uint64)
        order = np.argsort(keys, kind="stable")
        strings = [s for i in order for s in entries[i]]
        offsets = np.zeros(len(strings) + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=offsets[1:])
        return struct.pack("<q", len(entries)) + keys[order].tobytes() + offsets.tobytes() + b"".join(strings)

    def find(self, keys: list[bytes], digests: np.ndarray) -> dict[bytes, bytes]:
        """Values of those keys that are there."""
        found, at = {}, np.searchsorted(self.keys, digests, "left")
        tried = np.arange(len(keys))
        while len(tried):
            here = at[tried]
            tried = tried[here < self.n]
            tried = tried[self.keys[at[tried]] == digests[tried]]
            left = []
            for i in tried:
                j = 2 * at[i]
                a, b, c = self.offsets[j : j + 3]
                if self.strings[a:b].tobytes() == keys[i]:
                    found[keys[i]] = self.strings[b:c].tobytes()
                else:
                    left.append(i)
            tried = np.array(left, np.int64)
            at[tried] += 1  # another string with the same digest may follow
        return found


@functools.lru_cache(maxsize=64)
def _mapped(uri: str) -> SortedDigests:
    files, path = files_at(uri)
    return SortedDigests(path if isinstance(files, fs.LocalFileSystem) else SparkFiles.get(uri.rsplit("/", 1)[1]))


class Rules:
    """Files of rules, by part; a part without entries has none."""

    def __init__(self, files: dict[int, str], parts: int, digest: Callable[[bytes], int] = digest):
        self.files, self.parts, self.digest = files, parts, digest

    def find(self, keys: Iterable[bytes]) -> dict[bytes, bytes]:
        keys = list(dict.fromkeys(keys))
        digests = np.array([self.digest(k) for k in keys], np.uint64)
        part, out = (digests % np.uint64(self.parts)).astype(np.int64), {}
        for p in np.unique(part):
            if int(p) in self.files:
                at = np.flatnonzero(part == p)
                out |= _mapped(self.files[int(p)]).find([keys[i] for i in at], digests[at])
        return out

    def best(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """Rule and verdict of each url, both None where no rule fits."""
        suffixes = {h: _suffixes(h) for h in set(hosts)}
        named = {k: [int(n) for n in v.split(b",")] for k, v in self.find(host_key(s) for own in suffixes.values() for s in own).items()}
        tried = [[(s, p[:n]) for s in suffixes[h] for n in named.get(host_key(s), ()) if n <= len(p)] for h, p in zip(hosts, paths, strict=True)]
        verdicts = self.find(rule_key(*r) for own in tried for r in own)
        fits = [[r for r in own if rule_key(*r) in verdicts] for own in tried]
        longest = [max(own, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None) for own in fits]
        return [(r[0] + r[1], verdicts[rule_key(*r)].decode()) if r else (None, None) for r in longest]


def _suffixes(host: str) -> list[str]:
    """The host and the hosts that it is a subdomain of."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    part = lambda i: F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def build_rules(rules: DataFrame, folder: str | None = None, part: int = PART, digest: Callable[[bytes], int] = digest) -> Rules:
    """Files of the rules (host, path, verdict), written by Spark's tasks to the shared folder."""
    spark = rules.sparkSession
    folder = folder or shared_dir(spark)
    clean = rules.select(lower_ascii(F.col("host").cast("string")).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    clean = clean.filter("host <> '' AND verdict IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    of_rule = clean.select(F.concat(F.char_length("host").cast("string"), F.lit(":"), "host", "path").alias("key"), F.col("verdict").alias("value"))
    lengths = F.array_join(F.sort_array(F.collect_set(F.char_length("path"))), ",")  # as many as there are lengths, not rules
    of_host = clean.groupBy("host").agg(lengths.alias("value")).select(F.concat(F.lit(":"), "host").alias("key"), "value")
    entries = of_rule.union(of_host)
    parts = max(1, -(-entries.count() // part))

    @F.arrow_udf("long")
    def dealt(keys: pa.Array) -> pa.Array:
        return pa.array([digest(k.encode()) % parts for k in keys.to_pylist()], pa.int64())

    def write(entries: pa.Table) -> pa.Table:
        rows = [(k.encode(), v.encode()) for k, v in zip(entries["key"].to_pylist(), entries["value"].to_pylist(), strict=True)]
        files, root = files_at(folder)
        files.create_dir(root, recursive=True)
        name = f"urls-{uuid.uuid4().hex}.bin"  # a task that runs again writes a file of its own
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(SortedDigests.to_bytes(rows, digest))
        return pa.table({"part": entries["part"].slice(0, 1), "file": [f"{folder}/{name}"]})

    written = entries.withColumn("part", dealt("key")).groupBy("part").applyInArrow(write, "part long, file string").collect()  # a row for each file
    if not isinstance(files_at(folder)[0], fs.LocalFileSystem):  # workers map files of their own file system only
        for r in written:
            spark.sparkContext.addFile(r["file"].replace("s3://", "s3a://", 1))
    return Rules({r["part"]: r["file"] for r in written}, parts, digest)


def judge(pages: DataFrame, rules: Rules, otherwise: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages`."""
    host, path = host_and_path(F.col("url").cast("string"))

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def best(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = rules.best(hosts.to_pylist(), paths.to_pylist())
        return pa.StructArray.from_arrays([pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["rule", "verdict"])

    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = parted.select("*", best("host", "path").alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
