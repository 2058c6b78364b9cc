"""Sharding against a plain model of the tiers, with several writers, and by version."""

import random
from collections import Counter

import pytest

from siltstone.llm import sharding
from siltstone.llm.common import new_dir


def table(spark, n, at=0):
    return spark.createDataFrame([(at + i if i % 9 else None, f"text {at + i} " * (i % 5), None) for i in range(n)], "doc_id long, text string, arrival_ string")


def rows(df):
    return Counter(map(str, df.collect()))


def test_two_loads_by_arrival_keep_every_row(spark):
    first, second = table(spark, 300), table(spark, 200, 1000)
    store = sharding.shard(first, new_dir(spark, "t"), target_bytes=20_000)
    assert rows(store.read()) == rows(first)
    store.append(second.withColumn("by", sharding.arrival(second.doc_id)), by="by")
    before = store.version()
    store.compact(everything=True)
    both = rows(first) + rows(second)
    assert store.version() > before and rows(store.read()) == both and rows(store.read(before)) == both
    names = [r["run"] for r in store.manifest(before)["runs"]]
    assert len(names) > len(set(names)) or len(names) >= 13  # labels repeat, ids do not
    assert sharding.placed(store).count() == 500


def test_a_writer_between_write_and_commit(spark):
    store = sharding.shard(table(spark, 100), new_dir(spark, "t"), target_bytes=20_000)
    late = table(spark, 50, 500)
    folder = "data/a-late"
    late.write.parquet(f"{store.root}/{folder}")  # another writer, not yet committed
    base = store.manifest()
    store.append(table(spark, 30, 900))
    assert store.vacuum() == []
    store.compact(everything=True)
    run = store._runs("late", folder, 0)
    with pytest.raises(sharding.Conflict):
        store.commit(base | {"runs": [*base["runs"], *run]}, base["version"])
    store._added(run, base["schema"])
    assert store.read().count() == 180


def test_a_merge_that_lost_its_runs_is_given_up(spark):
    root = new_dir(spark, "t")
    store, other = (sharding.ShardStore(spark, root, target_bytes=20_000) for _ in range(2))
    for i in range(4):
        store.append(table(spark, 10, 100 * i))
    gone = store.manifest()["runs"]
    other.compact()
    assert not store._swapped(gone, [gone[0] | {"id": "x"}])
    store.compact()
    assert store.read().count() == 40


def test_vacuum_keeps_recent_versions(spark):
    store = sharding.ShardStore(spark, new_dir(spark, "t"), target_bytes=20_000)
    for i in range(4):
        store.append(table(spark, 10, 100 * i))
    store.compact()
    last = store.version()
    assert len(store.vacuum(versions=1, older_than_s=3600)) == 0
    assert store.read(last - 1).count() == 40
    assert len(store.vacuum(versions=1, older_than_s=-60)) == 4
    assert store.read().count() == 40
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        store.read(last - 1).count()


def test_other_file_systems_are_refused(spark):
    class Other(sharding.ShardStore):
        pass

    with pytest.raises(Exception, match="atomic|scheme|FileSystem"):
        Other(spark, "ftp://nowhere/x")


@pytest.mark.parametrize("seed", range(4))
def test_tiers_against_a_plain_model(seed):
    """Runs of many shards; a merge packs whole files, largest first, up to the target."""
    rng = random.Random(seed)
    target, fanout = 1000, 4
    store = sharding.ShardStore.__new__(sharding.ShardStore)
    store.target, store.fanout = target, fanout
    files, total = {}, 0

    def level(size):  # 0 below target / 64, then a tier for each factor of four
        return -1 if size >= target else next(t for t in range(9) if size * fanout**3 < target * fanout**t)

    def listed(name, sizes):
        for full in (True, False):
            if some := [x for x in sizes if (2 * x >= target) == full]:
                files[name, full] = some
                yield {"id": (name, full), "bytes": sum(some), "shards": len(some), "level": 0, "full": full}

    def packed(sizes):
        bins = [0]
        for x in sorted(sizes, reverse=True):
            if bins[-1] and bins[-1] + x > target:
                bins.append(0)
            bins[-1] += x
        return bins

    def settle(everything=False):
        nonlocal runs
        while due := store._due(runs, everything):
            small = [r for r in runs if not r["full"]]
            tiers = Counter(level(r["bytes"]) for r in small)
            if any(r["bytes"] >= target and r["shards"] > 1 for r in small):
                assert due == [r for r in small if r["bytes"] >= target]
            elif any(t >= 0 and c >= fanout for t, c in tiers.items()):
                least = min(t for t, c in tiers.items() if t >= 0 and c >= fanout)
                assert due == [r for r in small if level(r["bytes"]) == least]
            else:
                assert everything
            before = [x for r in due for x in files[r["id"]]]
            after = packed(before)
            assert len(after) < len(before) and all(2 * x > target for x in after[:-1])
            runs = [r for r in runs if r not in due] + list(listed(f"m{len(files)}", after))

    runs = []
    for i in range(60):
        sizes = [rng.choice([1, 5, 30, 90, 400, 700, 1200]) for _ in range(rng.choice([1, 1, 3, 40]))]
        total += sum(sizes)
        runs += listed(i, sizes)
        settle()
        small = [r for r in runs if not r["full"]]
        assert all(c < fanout for c in Counter(level(r["bytes"]) for r in small).values()) and all(r["bytes"] < target for r in small)
        assert sum(r["bytes"] for r in runs) == total
    settle(everything=True)
    assert sum(r["shards"] for r in runs if not r["full"]) <= 1 and sum(r["bytes"] for r in runs) == total


def test_arrivals_of_many_small_shards_become_files_of_the_target_size(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefghijklmnop ", k=900))) for i in range(3000)], "doc_id long, text string").repartition(40)
    target = 200_000
    store = sharding.shard(docs, new_dir(spark, "t"), target_bytes=target)
    first = [r for r in store.manifest(1)["runs"]]
    assert first[0]["shards"] > 20
    sizes = [r.shard_bytes for r in store.shards().collect()]
    assert len(sizes) > 4 and sum(2 * x < target for x in sizes) <= 1 and max(sizes) <= 2 * target
    assert rows(store.read()) == rows(docs)
    assert store.read(5).count() < 3000  # an earlier version, before all arrivals
    again = store.version()
    store.compact(everything=True)
    assert store.version() == again  # nothing is rewritten twice
    gone = store.vacuum(versions=1, older_than_s=-60)
    assert gone and rows(store.read()) == rows(docs)


def test_runs_of_earlier_manifests_are_compacted(spark):
    store = sharding.ShardStore(spark, new_dir(spark, "t"), target_bytes=20_000)
    store.append(table(spark, 200).repartition(9))
    now = store.manifest()
    store.commit(now | {"runs": [{k: v for k, v in r.items() if k != "full"} for r in now["runs"]]}, now["version"])
    store.compact(everything=True)
    assert sum(r["shards"] for r in store.manifest()["runs"]) == 1 and store.read().count() == 200


def test_small_shards_beside_full_ones_are_vacuumed(spark):
    store = sharding.ShardStore(spark, new_dir(spark, "t"), target_bytes=20_000)
    rng = random.Random(2)
    big = spark.createDataFrame([(i, "".join(rng.choices("abcdefghijklmnop ", k=9000))) for i in range(8)], "doc_id long, text string").coalesce(1)
    store.append(big.unionByName(spark.createDataFrame([(i, "small") for i in range(100, 104)], "doc_id long, text string").repartition(2)))
    assert {r["full"] for r in store.manifest()["runs"]} == {True, False}
    before = rows(store.read())
    store.compact(everything=True)
    assert any("/part-" in x for x in store.vacuum(versions=1, older_than_s=-60))
    assert rows(store.read()) == before


def test_session_settings_stay(spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    sharding.shard(table(spark, 60), new_dir(spark, "t"), target_bytes=20_000)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes"))


def test_an_empty_table_keeps_its_types(spark):
    store = sharding.shard(spark.createDataFrame([], "doc_id string, text string"), new_dir(spark, "t"))
    assert sharding.placed(store).schema["doc_id"].dataType.simpleString() == "string" and sharding.placed(store).count() == 0
    assert sharding.audit(store).count() == 0
