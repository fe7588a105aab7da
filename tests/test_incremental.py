import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline import schemas, session
from hearthline.config import FitOptions
from hearthline.operators import regression
from hearthline.plans import service
from hearthline.sources import files
from hearthline.sources.snapshots import SnapshotTable, Version
from hearthline.streaming.incremental import IndexStore, follow, merged_cells
from hearthline.streaming.uploads import append_valid_pairs, arriving_pairs

AREA = ["cbsa_id"]


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="hearthline-inc-")


def by_group(fits):
    return {r.cbsa_id: r for r in fits.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for name, fit in want.items():
        assert np.allclose(got[name].log_returns, fit.log_returns, atol=1e-10)
        assert np.allclose(np.array(got[name].standard_errors, float), np.array(fit.standard_errors, float), rtol=1e-8, equal_nan=True)
        for field in ("first_period", "num_periods", "num_observations", "all_pairs", "rank", "identified"):
            assert got[name][field] == fit[field]
        assert got[name].residual_sum == pytest.approx(fit.residual_sum, rel=1e-9)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_batches_in_any_order_equal_one_fit(spark, pairs_table, random_pairs, folder, order):
    rows = random_pairs(400, months=12, groups=("A", "B", "C"))
    store = IndexStore(spark, folder, AREA, fold_at=3)
    for i in order:
        store.absorb(pairs_table(rows[i::4]))
    same(by_group(store.fits()), by_group(regression.fit_repeat_sales(pairs_table(rows), AREA)))
    assert len(store.cells.version().folders) < 3


def test_only_groups_of_the_batch_are_solved_again(spark, pairs_table, random_pairs, folder):
    rows = random_pairs(200, months=8, groups=("A", "B"))
    store = IndexStore(spark, folder, AREA, FitOptions(min_pairs=60))
    late = [r for r in rows if r[2] == "B"]
    store.absorb(pairs_table([r for r in rows if r[2] == "A"] + late[:50]))
    assert set(by_group(store.fits())) == {"A"}  # B has too few pairs so far
    store.absorb(pairs_table(late[50:]))
    newest = store.solved.read().where(F.col("as_of") == 2)
    assert {r.cbsa_id for r in newest.collect()} == {"B"}
    same(by_group(store.fits()), by_group(regression.fit_repeat_sales(pairs_table(rows), AREA, FitOptions(min_pairs=60))))


def test_a_batch_sent_again_changes_nothing_and_a_cut_off_one_is_finished(spark, pairs_table, random_pairs, folder):
    rows = random_pairs(120, months=8)
    store = IndexStore(spark, folder, AREA)
    first, second = pairs_table(rows[:60]), pairs_table(rows[60:])
    store.absorb(first, ("s", 0))
    store.absorb(first, ("s", 0))
    # The second batch got as far as its cells.
    store.cells.append(regression.period_cells(second, AREA), ("s", 1))
    store.absorb(second, ("s", 1))
    assert store.cells.version().marks == store.solved.version().marks == {"s": 1}
    same(by_group(store.fits()), by_group(regression.fit_repeat_sales(pairs_table(rows), AREA)))


def test_a_stream_of_files(spark, pairs_table, random_pairs, folder):
    rows = random_pairs(150, months=8)
    store = IndexStore(spark, f"{folder}/store", AREA)
    for part in (rows[:100], rows[100:]):
        pairs_table(part).repartition(3).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(schemas.PAIRS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        follow(arriving, store, f"{folder}/progress").awaitTermination()
    assert store.cells.version().number >= 4
    same(by_group(store.fits()), by_group(regression.fit_repeat_sales(pairs_table(rows), AREA)))


def test_cells_without_pairs_in_range_and_empty_batches(spark, pairs_table, random_pairs, folder):
    rows = random_pairs(80, months=6, groups=("A",))
    cells = regression.period_cells(pairs_table(rows), AREA)
    none = cells.withColumns({"n": F.lit(0).cast("bigint"), "mean_change": F.lit(None).cast("double"), "spread": F.lit(None).cast("double")})
    merged = {(r.first_period, r.second_period): r for r in merged_cells(cells.unionByName(none), AREA).collect()}
    for r in cells.collect():
        m = merged[r.first_period, r.second_period]
        assert (m.n, m.all_pairs) == (r.n, 2 * r.all_pairs) and m.mean_change == pytest.approx(r.mean_change)
    store = IndexStore(spark, folder, AREA)
    with pytest.raises(FileNotFoundError):
        store.fits()
    store.absorb(pairs_table([]))
    assert store.fits().count() == 0


def test_versions_change_at_once(spark, folder):
    table = SnapshotTable(spark, folder, "id bigint")
    assert table.read() is None and table.version() == Version()
    table.append(spark.range(3))
    table.append(spark.range(2))
    before = table.version()
    opened = table.read()
    table.replace(spark.range(7))
    assert (opened.count(), table.read(before).count(), table.read().count()) == (5, 5, 7)
    # A manifest that its writer has not finished is passed over, and its number is not used again.
    with open(f"{folder}/_manifests/{4:012d}.json", "w") as unfinished:
        unfinished.write('{"folders": [')
    assert table.read().count() == 7
    assert table.append(spark.range(1)).number == 5 and table.read().count() == 8
    assert table.clean() > 0 and table.read().count() == 8
    assert table.clean() == 0


def test_a_slower_writer_builds_on_the_faster_one(spark, folder, monkeypatch):
    table, other = SnapshotTable(spark, folder, "id bigint"), SnapshotTable(spark, folder, "id bigint")
    table.append(spark.range(2))
    publish, raced = table._publish, []

    def late(version):
        if not raced:
            raced.append(other.append(spark.range(5)))
        return publish(version)

    monkeypatch.setattr(table, "_publish", late)
    table.append(spark.range(10))
    assert raced and table.read().count() == 17
    # Folding leaves alone what was appended meanwhile, and gives up if the table was replaced.
    raced.clear()
    table.fold(lambda df: df.distinct())
    assert table.read().count() == 10 + 5
    monkeypatch.setattr(table, "_publish", lambda v: publish(v))

    def replaced(df):
        other.replace(spark.range(1))
        return df

    table.fold(replaced)
    assert table.read().count() == 1


HEADER = "property_id,tract_id,cbsa_id,first_sale_date,first_sale_price,second_sale_date,second_sale_price\n"


def test_uploads_and_streams_share_one_version(spark, folder):
    os.makedirs(f"{folder}/in")
    line = "01,10000,2019-01-01,100000,2020-01-01,105000\n"
    for name, count in (("a", 2), ("b", 3)):
        with open(f"{folder}/{'in/' if name == 'a' else ''}{name}.csv", "w") as target:
            target.write(HEADER + "".join(f"{name}{i},{line}" for i in range(count)))
    store = f"{folder}/store"
    append_valid_pairs(arriving_pairs(spark, f"{folder}/in"), store, f"{folder}/progress").awaitTermination()
    old = files.load_pairs_between(spark, store)
    upload = service.UploadRequest("transactions", "csv", replace_existing=True)
    assert service.upload(spark, store, f"{folder}/b.csv", upload).status == "success"
    # Streamed pairs are replaced too, and a reader of the old version still sees it whole.
    assert {r.property_id[0] for r in files.load_pairs_between(spark, store).collect()} == {"b"}
    assert {r.property_id for r in old.collect()} == {"a0", "a1"}


def test_plain_folders_are_where_a_store_starts(spark, pairs_table, random_pairs, folder):
    pairs_table(random_pairs(40)).write.parquet(f"{folder}/transactions")
    assert files.load_pairs_between(spark, folder).count() == 40
    files.stored_pairs(spark, folder).append(pairs_table(random_pairs(10)))
    assert files.load_pairs_between(spark, folder).count() == 50
    files.stored_pairs(spark, folder).replace(pairs_table(random_pairs(5)))
    assert files.load_pairs_between(spark, folder).count() == 5


def test_what_was_staged_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_handed_out", [])
    folder = session.scratch(spark, "place")
    spark.range(3).write.parquet(folder)
    assert session.staged(spark.range(4)).count() == 4 and spark.read.parquet(folder).count() == 3
    assert session.drop_staged(spark) == 2 and session.drop_staged(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder).count()
