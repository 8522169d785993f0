"""URL filters by a sorted digest array.

Rules are host and path prefixes. Their 64-bit xxhash keys lie in one sorted array that workers map into
memory, next to the numbers of the rules. A url is probed for every suffix of its host at a label boundary
and every length that a rule's path has: all candidates of a batch in one vectorised binary search per
length. Equal keys are only candidates; the stored full string confirms each.

The rules are broadcast while their strings take at most BROADCAST bytes; a larger set is dealt over the
cluster by key and joined with the candidates' keys, with the same result.

Defined results: a null url, or one without `://`, has an empty host and path and no rule; a null page_id
stays null; repeated rules are one, and where one string is both allowed and blocked it is blocked; repeated
urls are repeated in the result; of rules of one length the one with the longer host wins; empty tables give empty ones; without rules every url has the method's
verdict; other columns are not read.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_counted, map_batches, staged

BROADCAST = 64 << 20
#: What a url gets that no rule fits: it isn't on the list.
DEFAULT = "allow"


def lowered(host: str) -> str:
    """A-Z lower-cased, other letters as they are."""
    return host.lower() if host.isascii() else host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for sign in "#?":
        rest = rest.partition(sign)[0]
    host, slash, path = rest.partition("/")
    return lowered(host), slash + path


class DigestArray:
    """Sorted 64-bit keys of strings in mapped memory, with the strings for confirmation."""

    def __init__(self, strings: list[str]):
        keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.strings = [strings[i] for i in order]
        self.memory = mmap.mmap(-1, max(1, keys.nbytes))
        self.memory.write(keys[order].tobytes())
        self.keys = np.frombuffer(self.memory, np.uint64, len(strings))

    def find(self, candidates: list[str]) -> np.ndarray:
        """Place of each candidate in the array, -1 where it isn't one of the strings."""
        out = np.full(len(candidates), -1)
        if not len(self.keys) or not candidates:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            k = at[i]
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.strings[k] == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out


def rule_key(host: str, path: str) -> str:
    return f"{host}\n{path}"


class Rules:
    def __init__(self, rules: list[tuple[str, str, str]]):
        verdicts: dict[str, str] = {}
        for verdict, host, path in rules:
            key = rule_key(lowered(host), path)
            verdicts[key] = "block" if "block" in (verdict, verdicts.get(key)) else verdict
        self.array = DigestArray(list(verdicts))
        self.verdicts = [verdicts[s] for s in self.array.strings]
        self.lengths = sorted({len(s.partition("\n")[2]) for s in verdicts}, reverse=True)

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """Rule and verdict of each (host, path); longest rule (host and path together) wins, on ties the longer host."""
        owner, text = [], []
        for i, (host, path) in enumerate(urls):
            for suffix in suffixes(host):
                for n in self.lengths:
                    if n <= len(path):
                        owner.append(i)
                        text.append(rule_key(suffix, path[:n]))
        best: list = [(None, None)] * len(urls)
        size = [-1] * len(urls)
        at = self.array.find(text)
        for c in np.flatnonzero(at >= 0):
            i = owner[c]
            if len(text[c]) > size[i]:
                size[i] = len(text[c])
                best[i] = (text[c].replace("\n", "", 1), self.verdicts[at[c]])
        return best


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


_RESULT = "page_id long, host string, path string, rule string, verdict string"


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, *, default: str = DEFAULT) -> DataFrame:
    """Per page page_id, host, path, rule (null if none fits) and verdict.

    rules: (verdict, host, path) each, as a list or as a table with these columns.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", "host", "path").where("verdict is not null and host is not null and path is not null")
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
        if size > BROADCAST:
            return _joined(pages, rules, default)
        rules = [tuple(r) for r in rules.distinct().collect()]
    known = spark.sparkContext.broadcast(rules)
    held: list[Rules] = []

    def rows(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(Rules(known.value))
        split = [parts(u) for u in batch.column(1).to_pylist()]
        found = held[0].judge(split)
        return {"page_id": batch.column(0), "host": [h for h, _ in split], "path": [p for _, p in split], "rule": [r for r, _ in found], "verdict": [v or default for _, v in found]}

    return map_batches(pages, rows, _RESULT)


def _joined(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rules of any number: candidates of distinct urls meet the rules by key in the cluster."""
    rules = rules.select(F.expr("case when verdict = 'block' then 1 else 0 end").alias("block"), F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("rule_host"), F.col("path").alias("rule_path"))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("block").alias("block"))
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]  # as many as a path has lengths

    def split(batch: pa.RecordBatch) -> dict:
        found = [parts(u) for u in batch.column(0).to_pylist()]
        return {"url": batch.column(0), "host": [h for h, _ in found], "path": [p for _, p in found]}

    counts = pages.select(F.coalesce("url", F.lit("")).alias("url")).groupBy("url").agg(F.count("*").alias("many"))
    urls = staged(map_batches(counts, lambda batch: split(batch) | {"many": batch.column("many")}, "url string, host string, path string, many long"), "urls")
    labels = F.split("host", "[.]")
    tries = (
        urls.where("host <> ''")
        .select("url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
        .select("url", "path", "rule_host", F.explode(F.lit(lengths)).alias("n"))
        .where(F.col("n") <= F.length("path"))
        .select("url", "rule_host", F.expr("substring(path, 1, n)").alias("rule_path"))
    )
    # the longest; of several the one with the longest host (two of one host and one length are the same)
    size, host = F.length("rule_host"), F.concat("rule_host", "rule_path")
    best = tries.join(rules, ["rule_host", "rule_path"]).groupBy("url").agg(F.max(F.struct(F.length(host).alias("n"), size.alias("h"), host.alias("rule"), "block")).alias("best"))
    verdict = F.when(F.col("best.block") == 1, "block").when(F.col("best.block") == 0, "allow").otherwise(default)
    judged = urls.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "many")
    rows = join_counted(pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")), staged(judged, "judged"), ["url"])
    return rows.select("page_id", "host", "path", "rule", "verdict")
