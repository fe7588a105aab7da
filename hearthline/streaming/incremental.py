"""An index that is kept up to date as pairs arrive.

All that a least-squares fit needs of its pairs are sums per group and period combination, and
such sums add up. A batch is reduced to its own cells, which are appended to a store, and only the
groups that it touches are solved again, from the cells of all batches so far. The
work of a batch grows with the batch and the cells of its groups, not with the pairs seen before.
Batches may come in any order and in parts of any size; the result is that of one fit over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthline.config import FitOptions
from hearthline.operators.regression import FIT_FIELDS, index_series, period_cells, solve_cells
from hearthline.session import staged
from hearthline.sources.snapshots import SnapshotTable

CELL_FIELDS = "first_period int, second_period int, n bigint, mean_change double, spread double, all_pairs bigint"


def _joined(total: Column, cell: Column) -> Column:
    """Count, mean and spread of two sets of numbers together, from those of each."""
    n = total.n + cell.n
    gap = cell.mean_change - total.mean_change
    return F.when(cell.n == 0, total).when(total.n == 0, cell).otherwise(
        F.struct(
            n.alias("n"),
            (total.mean_change + gap * cell.n / n).alias("mean_change"),
            (total.spread + cell.spread + gap * gap * total.n * cell.n / n).alias("spread"),
        )
    )


def merged_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One cell per group and period combination out of those of several batches.

    As many cells meet as the store has folders, which folding bounds. Means are combined by
    their differences, so that nothing cancels; sorting makes the order of batches irrelevant.
    """
    one = F.struct("n", "mean_change", "spread")
    nothing = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean_change"), F.lit(0.0).alias("spread"))
    lists = cells.groupBy(*keys, "first_period", "second_period").agg(
        F.sort_array(F.collect_list(one)).alias("cells"), F.sum("all_pairs").alias("all_pairs")
    )
    return lists.withColumn("c", F.aggregate("cells", nothing, _joined)).select(
        *keys, "first_period", "second_period", "c.n", "c.mean_change", "c.spread", "all_pairs"
    )


class IndexStore:
    """Cells and fits of an index below ``root``; ``keys`` are the columns that name a group."""

    def __init__(
        self, spark: SparkSession, root: str, keys: list[str], options: FitOptions = FitOptions(),
        key_type: str = "string", fold_at: int = 16,
    ) -> None:
        self.keys, self.options, self.fold_at = keys, options, fold_at
        names = ", ".join(f"`{k}` {key_type}" for k in keys)
        self.cells = SnapshotTable(spark, f"{root}/cells", f"{names}, {CELL_FIELDS}")
        self.solved = SnapshotTable(spark, f"{root}/fits", f"{names}, {FIT_FIELDS}, as_of bigint")

    def absorb(self, pairs: DataFrame, mark: tuple[str, int] | None = None) -> None:
        """Take in a batch of pairs and solve its groups again.

        With a mark, the name and number of a stream's batch, a batch that is sent again changes
        nothing; if it was cut off between its two steps, the second is made up for.
        """
        batch = staged(period_cells(pairs, self.keys, self.options.period), "batch")
        version = self.cells.append(batch, mark)
        if not self.solved.version().holds(mark):
            touched = batch.select(*self.keys).distinct()
            known = merged_cells(self.cells.read(version).join(touched, self.keys, "left_semi"), self.keys)
            fits = solve_cells(known, self.keys, self.options)
            self.solved.append(fits.withColumn("as_of", F.lit(version.number).cast("bigint")), mark)
        if len(version.folders) >= self.fold_at:
            self.fold()

    def fold(self) -> None:
        """Merge the cells of all batches into one folder, and keep the newest fit of each group."""
        self.cells.fold(lambda cells: merged_cells(cells, self.keys))
        self.solved.fold(self._newest)

    def _newest(self, solved: DataFrame) -> DataFrame:
        row = F.max_by(F.struct(*solved.columns), "as_of").alias("row")
        return solved.groupBy(*self.keys).agg(row).select("row.*")

    def fits(self) -> DataFrame:
        """The newest fit of every group, in the shape of fit_repeat_sales."""
        solved = self.solved.read()
        if solved is None:
            raise FileNotFoundError(f"no batch in {self.solved.root}")
        return self._newest(solved).drop("as_of")

    def series(self) -> DataFrame:
        return index_series(self.fits(), self.keys, self.options)


def follow(arriving: DataFrame, store: IndexStore, progress: str, name: str = "pairs") -> StreamingQuery:
    """Absorb a stream of valid pairs batch by batch, up to the files present now.

    ``progress`` is the stream's checkpoint folder; ``name`` tells streams into one store apart.
    """
    return (
        arriving.writeStream.foreachBatch(lambda pairs, number: store.absorb(pairs, (name, number)))
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
