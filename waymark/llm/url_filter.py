"""URL filter: rules by host and path, and for other URLs the ratio of two character language models.

URLs that a rule allows or blocks train one smoothed variable-order Markov model each: counts of characters after
contexts of 0 to ORDER characters, backed off from the longest context seen by Witten-Bell weights. Counts are exact: a
gram is a byte with the ORDER bytes before it, and grams are counted in a table of Spark's, which isn't collected. URLs
are cut into blocks; the distinct grams of a block are joined with the table and meet the block's URLs again. The
log-likelihood difference for each character is calibrated: the threshold is the one that errs least, in balanced terms,
on the labelled URLs that the models weren't trained on, one in CALIBRATES by a checksum of the URL.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import map_rows, read_table, written

#: (verdict, host, path): fixed values of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
CALIBRATES = 5
#: A block of URLs ends beyond so many bytes, and a partition's counts are passed on beyond so many grams.
BLOCK_BYTES = 200_000
COUNTED_GRAMS = 500_000
#: Bins of the calibration histogram, over scores from -SPAN to SPAN.
BINS, SPAN = 400, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """host and path; both empty if the URL is null or has no ``://``."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(after, "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and rule_verdict (null where no rule fits); of the rules that fit the longest counts."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("__waymark_url"))
    host, path = url_parts(F.col("__waymark_url"))
    rows = rows.withColumns({"host": host, "path": path})
    best: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    rows = rows.withColumn("best", best)
    return rows.select("page_id", F.col("__waymark_url").alias("url"), "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def grams(url: str) -> np.ndarray:
    """For each byte a number of ORDER + 1 bytes: the ORDER bytes before it and the byte, the lowest."""
    data = np.frombuffer(b"\x02" * ORDER + url.encode(), dtype=np.uint8).astype(np.int64)
    n = len(data) - ORDER
    out = np.zeros(n, dtype=np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | data[k : k + n]
    return out


class Counts:
    """Exact counts of one class by order: of contexts, of contexts with a following byte, and of distinct following bytes."""

    def __init__(self, counted: np.ndarray, n: np.ndarray, orders: Iterable[int]):
        self.levels = {}
        for order in orders:
            pairs, at = np.unique(counted & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            seen = np.bincount(at, weights=n, minlength=len(pairs))
            contexts, first = np.unique(pairs >> 8, return_index=True)  # pairs are sorted, so a context's are in a row
            self.levels[order] = pairs, seen, contexts, np.add.reduceat(seen, first) if len(first) else seen, np.diff(np.r_[first, len(pairs)])

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0)

    def probabilities(self, wanted: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        """Of the last byte of each gram after the ones before it; p: those by the orders under these."""
        p = np.full(len(wanted), 1 / 256) if p is None else p
        for order, (pairs, seen, contexts, totals, kinds) in self.levels.items():
            pair = wanted & ((1 << 8 * (order + 1)) - 1)
            total, kind = (self._found(contexts, x, pair >> 8) for x in (totals, kinds))
            p = np.where(total > 0, (self._found(pairs, seen, pair) + kind * p) / np.maximum(total + kind, 1), p)
        return p


class Models:
    """The counts of both classes as a table (which, gram, n), and its lowest orders, which have a proven size, in memory."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.near: tuple = (None, None)
        low = table.groupBy("which", F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).toPandas()  # 2 * 65,536 rows at most
        self.low = [Counts(own["pair"].to_numpy(np.int64), own["n"].to_numpy(np.int64), (0, 1)) for own in (low[low["which"] == w] for w in range(2))]

    def ratios(self, wanted: DataFrame) -> DataFrame:
        """(gram, ratio) of the distinct grams of wanted: the log-probability in an accepted URL less that in a rejected one.

        Contexts of two bytes or more, and what follows them, share the two bytes before the gram's last one: the groups.
        """
        shared = wanted.sparkSession.sparkContext.broadcast(self.low)
        rows = self.table.unionByName(wanted.select(F.lit(-1).cast("bigint").alias("which"), "gram", F.lit(0).cast("bigint").alias("n")).distinct())

        def run(group: pd.DataFrame) -> pd.DataFrame:
            which, gram, n = (group[c].to_numpy(np.int64) for c in ("which", "gram", "n"))
            own = gram[which == -1]
            logs = [np.log(Counts(gram[which == w], n[which == w], range(2, ORDER + 1)).probabilities(own, shared.value[w].probabilities(own))) for w in range(2)]
            return pd.DataFrame({"gram": own, "ratio": logs[0] - logs[1]})

        return rows.withColumn("pair", F.shiftright("gram", 8).bitwiseAND(0xFFFF)).groupBy("pair").applyInPandas(run, "gram bigint, ratio double")

    def log_likelihood(self, url: str, which: int) -> float:
        """Of one URL, for looking at single URLs: the counts of its grams' contexts are collected, and kept for the next one."""
        if not url:
            return 0.0
        own = grams(url)
        pairs = sorted(set((own >> 8 & 0xFFFF).tolist()))
        if self.near[0] != (which, pairs):
            near = self.table.filter(F.col("which") == which).filter(F.shiftright("gram", 8).bitwiseAND(0xFFFF).isin(pairs)).toPandas()
            self.near = (which, pairs), Counts(near["gram"].to_numpy(np.int64), near["n"].to_numpy(np.int64), range(2, ORDER + 1))
        high = self.near[1]
        return float(np.log(high.probabilities(own, self.low[which].probabilities(own))).sum())

    def score(self, url: str | None) -> float:
        """Log-likelihood of an accepted URL less that of a rejected one, for each byte; 0 without any."""
        url = url or ""
        return (self.log_likelihood(url, 0) - self.log_likelihood(url, 1)) / len(url.encode()) if url else 0.0


def train(labelled: DataFrame) -> Models:
    """Models of all rows (url, rule_verdict): every gram is counted."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            for which, own in enumerate(counts):
                yield pa.record_batch([pa.array([which] * len(own), pa.int64()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], ["which", "gram", "n"])
                own.clear()

        for batch in batches:
            found: tuple[list, list] = ([], [])
            for url, verdict in zip(batch.column("url").to_pylist(), batch.column("rule_verdict").to_pylist(), strict=True):
                if url:
                    found[int(verdict == "block")].append(grams(url))
            for own, more in zip(counts, found, strict=True):
                if more:
                    own.update(dict(zip(*(x.tolist() for x in np.unique(np.concatenate(more), return_counts=True)), strict=True)))
            if sum(map(len, counts)) > COUNTED_GRAMS:
                yield from out()
        yield from out()

    cells = map_rows(labelled.select("url", "rule_verdict"), run, "which bigint, gram bigint, n bigint")
    return Models(written(cells.groupBy("which", "gram").agg(F.sum("n").alias("n")), "grams"))


def scored(rows: DataFrame, models: Models) -> DataFrame:
    """rows with score."""
    columns = ["page_id", "url", "host", "path", "rule", "rule_verdict"]
    schema = "page_id bigint, url string, host string, path string, rule string, rule_verdict string"

    def cut(batches: Iterator[pa.RecordBatch]):
        block, size = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            blocks = []
            for url in batch.column("url").to_pylist():
                if size > BLOCK_BYTES:
                    block, size = block + 1, 0
                blocks.append(block)
                size += len((url or "").encode())
            yield batch.append_column("block", pa.array(blocks, pa.int64()))

    def own_grams(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            held: dict[int, list[np.ndarray]] = {}
            for block, url in zip(batch.column("block").to_pylist(), batch.column("url").to_pylist(), strict=True):
                if url:
                    held.setdefault(block, []).append(grams(url))
            for block, own in held.items():
                found = np.unique(np.concatenate(own))
                yield pa.record_batch([pa.array(np.full(len(found), block)), pa.array(found)], ["block", "gram"])

    def judge(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("gram")
        keys, ratios = known["gram"].to_numpy(np.int64), known["ratio"].to_numpy()
        group = group[columns].copy()
        group["score"] = [float(ratios[np.searchsorted(keys, own := grams(u))].sum() / len(own)) if u else 0.0 for u in group["url"]]
        return group

    blocks = written(map_rows(rows.select(*columns), cut, f"{schema}, block bigint"), "blocks")
    held = map_rows(blocks.select("block", "url"), own_grams, "block bigint, gram bigint").distinct()
    known = held.join(models.ratios(held.select("gram")), "gram")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(judge, f"{schema}, score double")


def threshold(labelled: DataFrame) -> float:
    """The score under which a URL is rejected: least balanced error over all labelled rows, by a histogram of BINS bins."""
    bin_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS))).cast("int")
    found = labelled.groupBy((F.col("rule_verdict") == "block").alias("blocked"), bin_of.alias("bin")).count().collect()  # 2 * BINS rows at most
    counts = np.zeros((2, BINS))
    for r in found:
        counts[int(r["blocked"]), r["bin"]] += r["count"]
    if not counts.sum(axis=1).all():  # one class only: nothing to tell apart
        return -np.inf if counts[0].sum() or not counts.sum() else np.inf
    accepted_below, rejected_above = np.r_[0, np.cumsum(counts[0])] / counts[0].sum(), 1 - np.r_[0, np.cumsum(counts[1])] / counts[1].sum()
    errors = accepted_below + rejected_above
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 * SPAN - SPAN)


def calibrates(url: Column) -> Column:
    """Whether a labelled URL is left out of training; equal URLs are alike in this."""
    return F.crc32(F.coalesce(url, F.lit("")).cast("binary")) % CALIBRATES == 0


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the models' score of every row of pages.

    A URL that is null or without ``://`` has an empty host and path and no rule; a null or empty URL scores 0 and is
    allowed unless the threshold is above 0. Repeated rows each give a row, and train as often as they are there. Where the
    rows left out of training lack a class, all labelled rows calibrate; without labelled rows of both classes the models
    don't judge: the one class's verdict holds, or allow if there's none. Of equally good thresholds the middle is taken. A
    very long URL is a block of its own.
    """
    rows = with_rules(pages, rules)
    models = train(rows.filter("rule IS NOT NULL").filter(~calibrates(F.col("url"))))
    judged = written(scored(rows, models), "judged")
    labelled = judged.filter("rule IS NOT NULL")
    apart = labelled.filter(calibrates(F.col("url")))
    cut = threshold(apart if apart.select("rule_verdict").distinct().count() == 2 else labelled)
    method = F.when(F.col("score") < F.lit(cut), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), F.round("score", 9).alias("score"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE_SQL: dict[str, str] = {}
