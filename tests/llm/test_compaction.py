import pytest
from pyspark.sql import functions as F

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.compaction import ShardStore, full_tier, op2_size_tiered_compaction
from plumbline.llm.support import new_folder

from .odd import documents, empty, odd, odd_rows


def test_table(spark, sf):
    got = op2_size_tiered_compaction(spark, sf)
    want = documents(spark, sf).select("doc_id", "source", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(got.select(*want.columns)) == rows(want)
    per = {(r["shard"], r["shard_rows"], r["merges"]): r["count"] for r in got.groupBy("shard", "shard_rows", "merges").count().collect()}
    assert all(k[1] == n for k, n in per.items()) and any(k[2] for k in per)


def test_versions(spark):
    store = ShardStore(spark, new_folder(spark, "t"), schema=spark.range(1).schema, fan_in=3)
    assert store.read().count() == 0
    for k in range(7):
        store.append(spark.range(100 * k, 100 * k + 100, 1, 2))
    assert store.versions() == list(range(1, 8)) and store.read(3).count() == 300 and store.due()
    assert len(store.due()) == 3
    version = store.compact()
    assert sorted(r[0] for r in store.read().select("id").collect()) == list(range(700))
    assert store.manifest(version).select("run").distinct().count() < 7 and store.due() is None
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(store.manifest(), version - 1)
    assert store.read().count() == 700
    assert len(store.versions()) == 2 and store.read(version - 1).count() == 700  # the version before can still be read
    assert store.read(0).count() == 0


def test_races_and_orphans(spark):
    """Of two writers both get in; of two merges of the same runs one; what nobody lists is deleted."""
    store, other = (ShardStore(spark, root, schema=spark.range(1).schema, fan_in=2) for root in [new_folder(spark, "t")] * 2)
    for k in range(4):
        store.append(spark.range(10 * k, 10 * k + 10))
    commit, extra = store._commit, []

    def slower(manifest, after):
        if not extra:
            extra.append(other.append(spark.range(100, 110)))
        return commit(manifest, after)

    store._commit = slower
    store.append(spark.range(200, 210))
    assert sorted(r[0] for r in store.read().select("id").collect()) == [*range(40), *range(100, 110), *range(200, 210)]
    store._commit = commit
    runs = store.due()
    assert store.merge(runs) and other.merge(runs) is None
    spark.range(5).write.parquet(f"{store.root}/dead")
    store.vacuum(keep=1, orphans_after=-60)
    left = {x.getPath().getName() for x in store._fs().listStatus(store._path(store.root))}
    assert left == {"manifest", *(r["run"] for r in store.manifest().select("run").distinct().collect())}
    assert store.read().count() == 60
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "0"  # the caller's session is as it was


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=12), st.integers(2, 4))
def test_tiers_against_a_plain_model(sizes, fan_in):
    """A full tier is ``fan_in`` neighbours in size, each within half to one and a half of their mean."""
    got = full_tier([(str(k), b) for k, b in enumerate(sizes)], fan_in)
    order = sorted(sizes)
    spans = [order[k : k + fan_in] for k in range(len(order) - fan_in + 1)]
    similar = [x for x in spans if x[0] >= 0.5 * sum(x) / fan_in and x[-1] <= 1.5 * sum(x) / fan_in]
    if got is None:  # no neighbours that stay similar all along
        assert not [x for x in similar if all(x[j] <= 1.5 * sum(x[: j + 1]) / (j + 1) and x[0] >= 0.5 * sum(x[: j + 1]) / (j + 1) for j in range(fan_in)) and x[-1] <= 1.5 * x[0]]
    else:
        x = sorted(sizes[int(k)] for k in got)
        assert len(set(got)) == fan_in and x in spans and x in similar


def test_odd(spark):
    for df, n in ((odd(spark), len(odd_rows())), (empty(spark), 0)):
        store = ShardStore(spark, new_folder(spark, "t"), schema=df.schema, fan_in=2)
        for _ in range(3):
            store.append(df)
        store.compact()
        assert store.read(shard="at").drop("at").exceptAll(df.unionByName(df).unionByName(df)).count() == 0 and store.read(shard="at").count() == 3 * n
