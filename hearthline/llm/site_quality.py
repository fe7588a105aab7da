"""Document quality by hierarchical empirical Bayes.

A classifier on the document's own text gives its evidence: boosted trees over a few rates,
calibrated, read as log odds against the overall share of good documents. Documents stand
on hosts and under paths of hosts. Grouped sums give each host's and path's share of good
documents, where a labelled document counts by its label and any other by its chance. A
host's share is drawn towards the overall one and a path's towards its host's, the more the
fewer documents they have; how much follows from how far hosts, and paths within hosts,
differ beyond chance (method of moments). A document's score adds its evidence to the log
odds of its path without itself.

Sums per path combine on the map side, so one host with a third of all documents costs as
much as any other; single rows of sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import chunked, column_set, texts_of
from hearthline.llm.toxicity import HELD_OUT, Trees, boosted, fold, isotonic
from hearthline.session import staged

FIT_ROWS = 20_000
CALIBRATION_FOLD = 3
KEEP_FROM = 0.5
SURE = 1e-4
STRENGTH = (1.0, 1e6)
NAMES = (
    "bytes words word_length variety repeats upper digits exclaimed piped signs stops commas lines repeated_lines ended wide".split()
)


def _features(data: bytes) -> list[float]:
    words, size = data.split(), max(1, len(data))
    n = max(1, len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]

    def share(signs: bytes) -> int:
        return len(data) - len(data.translate(None, signs))

    repeats = sum(map(bytes.__eq__, words, words[1:]))
    ended = sum(line.rstrip()[-1:] in b".!?" for line in lines)
    wide = size - len(data.translate(None, bytes(range(128, 256)))) if data else 0
    return [
        math.log1p(len(data)), math.log1p(len(words)), size / n, len(set(words)) / n, repeats / n,
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, share(b"0123456789") / size, share(b"!") / n, share(b"|") / n,
        share(b"#$%&*@^~_=+<>{}[]\\") / n, share(b".") / n, share(b",;:") / n, math.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), ended / max(1, len(lines)), wide / size,
    ]


def features(texts: Iterable[bytes]) -> np.ndarray:
    rows = [_features(t) for t in texts]
    return np.array(rows, np.float64).reshape(len(rows), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Calibrated classifier of the text alone, from at most about ``FIT_ROWS`` labelled rows picked by hash."""
    known = _labels(labels, id_col).where(F.col("fold") != HELD_OUT)
    share = FIT_ROWS / max(1, known.count())
    draw = F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 30)) / (1 << 30)
    # About FIT_ROWS rows of three numbers, whatever the table's size.
    sample = column_set(docs, id_col, text_col).toDF("_id", "_text").join(F.broadcast(known.where(draw < share)), "_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            x = features(texts_of(batch, "_text"))
            lists = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, dtype=np.int32) * len(NAMES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("fold"), batch.column("good"), lists], ["_id", "fold", "good", "x"])

    rows = sample.select("_id", "_text", "fold", "good").mapInArrow(run, "_id long, fold int, good int, x array<double>").toPandas()
    rows = rows.assign(key=rows["x"].map(tuple)).sort_values(["_id", "key"], kind="stable")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.empty((0, len(NAMES)))
    y, held = rows["good"].to_numpy(np.float64), rows["fold"].to_numpy() == CALIBRATION_FOLD
    trees = boosted(x[~held], y[~held])
    if len(trees.feature):
        trees.low, trees.high = isotonic(trees.margins(x[held]), y[held])
    return trees


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    """(_id, good, fold); of several labels of an id the lowest counts."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").cast("int").alias("good"))
    return known.withColumn("fold", fold(F.col("_id")))


def strength(total: float, squares: float, groups: int, within: float, share: float) -> float:
    """Rows that a prior is worth: small where groups differ, large where they differ by chance only.

    squares: sum over groups of rows * (share - parent's share) ** 2; within: rows less the
    groups' part of them, the divisor of the moment estimate.
    """
    chance = share * (1 - share)
    between = (squares - groups * chance) / within if within > 0 else 0.0
    return float(min(max(chance / between - 1, STRENGTH[0]), STRENGTH[1])) if between > 0 and chance > 0 else STRENGTH[1]


def _log_odds(share: Column) -> Column:
    held = F.greatest(F.least(share, F.lit(1 - SURE)), F.lit(SURE))
    return F.ln(held / (1 - held))


def scored(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, host, path, held_out, chance, host_share, path_share, score, keep) per row of docs.

    ``chance`` is the classifier's alone, ``keep`` is 1 for scores of ``KEEP_FROM`` and more.
    Null texts count as empty; a null host or path is a host or path of its own. Repeated
    rows count as often as they occur. Without labels of both kinds the classifier says
    nothing and the shares of labels decide.
    """
    trees = train(docs, labels, id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            chance = trees.scores(features(texts_of(batch, "_text")))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("host"), batch.column("path"), pa.array(chance)], ["_id", "host", "path", "chance"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    rows = source.mapInArrow(run, "_id long, host string, path string, chance double")
    learnt = _labels(labels, id_col).where(F.col("fold") != HELD_OUT).select("_id", "good")
    rows = rows.join(learnt, "_id", "left").withColumn("counted", F.coalesce(F.col("good").cast("double"), "chance")).drop("good")
    rows = staged(rows, "chances")

    paths = staged(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("counted").alias("s")), "paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("parts"), F.sum(F.col("n") * F.col("n")).alias("squared"), F.count(F.lit(1)).alias("paths")), "hosts")
    sums = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("of_hosts"),
        F.sum("parts").alias("of_paths"), F.sum(F.col("hn").cast("double") * F.col("hn")).alias("host_squares"),
        F.sum(F.col("squared").cast("double") / F.col("hn")).alias("path_squares"), F.count(F.lit(1)).alias("hosts"), F.sum("paths").alias("paths"),
    ).first()
    n = float(sums["n"] or 0)
    share = min(max((sums["s"] or 0.0) / n if n else 0.5, SURE), 1 - SURE)
    of_hosts, of_paths = float(sums["of_hosts"] or 0), float(sums["of_paths"] or 0)
    host_strength = strength(n, of_hosts - n * share**2, sums["hosts"] - 1, n - float(sums["host_squares"] or 0) / max(n, 1), share)
    path_strength = strength(n, of_paths - of_hosts, (sums["paths"] or 0) - sums["hosts"], n - float(sums["path_squares"] or 0), share)

    sites = paths.join(hosts.select(F.col("host").alias("_host"), "hn", "hs"), F.col("host").eqNullSafe(F.col("_host")))
    sites = sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "s", "hn", "hs")
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    own = F.col("counted")
    host_share = (F.lit(host_strength * share) + F.col("hs") - own) / (F.lit(host_strength) + F.col("hn") - 1)
    path_share = (F.lit(path_strength) * F.col("host_share") + F.col("s") - own) / (F.lit(path_strength) + F.col("n") - 1)
    evidence = _log_odds(F.col("chance")) - F.lit(math.log(share / (1 - share)))
    return (
        rows.join(sites, same)
        .withColumn("host_share", host_share)
        .withColumn("path_share", path_share)
        .withColumn("score", 1 / (1 + F.exp(-(evidence + _log_odds(F.col("path_share"))))))
        .select(
            F.col("_id").alias(id_col), "host", "path", F.coalesce(fold(F.col("_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
            "chance", "host_share", "path_share", "score", (F.col("score") >= KEEP_FROM).cast("int").alias("keep"),
        )
    )


def host_of(url: Column) -> Column:
    """Host of a URL without a leading www., for tables that have URLs."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def path_of(url: Column) -> Column:
    """First part of a URL's path."""
    return F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/([^/]*)", 1)
