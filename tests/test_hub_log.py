from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_hub import packed
from tributary.operators import hub, hub_log
from tributary.schemas import HUB_DIGEST
from tributary.session import scratch_path
from tributary.sources import sinks


def payloads(n, start=0):
    return [f'{{"a":{i}}}' for i in range(start, start + n)]


def stored(spark, path):
    return rows(sinks.read_hub(spark, path), "tenant_slug", "raw_data_payload")


def test_replay_inserts_nothing_and_copies_in_a_batch_stay(spark):
    path = scratch_path(spark, "hub")
    assert hub.push_into(spark, path, packed(spark, ['{"a":1}', '{"a":1}', '{"a":2}'])) == 1
    hub.push_into(spark, path, packed(spark, ['{"a":1}', '{"a":2}']))
    hub.push_into(spark, path, packed(spark, ['{"a":1}'], tenant="t1"))
    assert stored(spark, path) == [("t0", '{"a":1}')] * 2 + [("t0", '{"a":2}'), ("t1", '{"a":1}')]
    index = spark.read.parquet(f"{path}/{hub_log.INDEX}")
    assert index.count() == 3 and index.select(HUB_DIGEST).distinct().count() == 2


def test_a_push_opens_only_the_buckets_of_its_batch(spark):
    path = scratch_path(spark, "hub")
    hub.push_into(spark, path, packed(spark, payloads(300)))
    every = spark.read.parquet(f"{path}/{hub_log.INDEX}").inputFiles()
    batch = hub.with_digest(packed(spark, payloads(2)))
    prefixes = sorted({r[0] for r in batch.select(hub_log.bucket()).collect()})
    opened = hub_log.index_keys(spark, path, prefixes).inputFiles()
    assert 0 < len(opened) <= len(prefixes) < len(every)
    assert all(any(f"prefix={p}/" in f for p in prefixes) for f in opened)
    hub.push_into(spark, path, packed(spark, payloads(2)))
    assert len(stored(spark, path)) == 300


def test_small_batches_name_their_digests_to_the_scan(spark):
    path = scratch_path(spark, "hub")
    hub.push_into(spark, path, packed(spark, payloads(50)))
    batch = hub.with_digest(packed(spark, payloads(1)))
    digest = batch.first()[HUB_DIGEST]
    keys = hub_log.index_keys(spark, path, [digest[: hub_log.PREFIX]], [digest])
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(payload_md5" in plan or "EqualTo(payload_md5" in plan
    assert keys.count() == 1


def test_two_interleaved_pushes_of_one_batch_store_it_once(spark):
    path = scratch_path(spark, "hub")
    hub.push_into(spark, path, packed(spark, payloads(3)))
    batch = packed(spark, payloads(5))
    first = hub_log.prepare(spark, path, batch)  # reads commit 1, stages 2 new rows
    assert hub.push_into(spark, path, batch) == 2  # the other writer wins number 2
    assert hub_log.commit(spark, first) == 3  # conflict seen, rows computed again: none new
    assert sorted(stored(spark, path)) == sorted(("t0", p) for p in payloads(5))


def test_disjoint_writers_both_land(spark):
    path = scratch_path(spark, "hub")
    hub.push_into(spark, path, packed(spark, payloads(1)))
    mine = hub_log.prepare(spark, path, packed(spark, payloads(2, 10), tenant="t1"))
    hub.push_into(spark, path, packed(spark, payloads(2, 20), tenant="t2"))
    assert hub_log.commit(spark, mine) == 3
    assert len(stored(spark, path)) == 5


def test_a_commit_left_unpublished_is_finished_by_the_next_push(spark):
    path = scratch_path(spark, "hub")
    hub.push_into(spark, path, packed(spark, payloads(2)))
    pending = hub_log.prepare(spark, path, packed(spark, payloads(4)))
    store = hub_log.Store(spark, path)
    record = {"token": pending.token, "prefixes": pending.prefixes, "pairs": pending.pairs}
    import json

    assert store.create_new(json.dumps(record), hub_log.COMMITS, f"{2:020d}.json")  # writer stops here
    assert len(stored(spark, path)) == 2  # not visible yet
    hub.push_into(spark, path, packed(spark, payloads(4)))
    assert sorted(stored(spark, path)) == sorted(("t0", p) for p in payloads(4))


def test_an_older_hub_gets_its_index_once(spark):
    path = scratch_path(spark, "hub")
    sinks.write_hub(packed(spark, payloads(3)), path)
    hub.push_into(spark, path, packed(spark, payloads(4)))
    assert len(stored(spark, path)) == 4


def test_null_tenants_and_digests(spark):
    path = scratch_path(spark, "hub")
    nulls = packed(spark, ['{"a":1}']).withColumn("tenant_slug", F.lit(None).cast("string"))
    empty = packed(spark, ['{"a":2}']).withColumn("raw_data_payload", F.lit(None).cast("string"))
    hub.push_into(spark, path, nulls.unionByName(empty))
    hub.push_into(spark, path, nulls.unionByName(empty))
    assert len(stored(spark, path)) == 2


def test_partition_swap_is_one_manifest(spark):
    from tributary.sources.local import local_frame

    path = scratch_path(spark, "star")
    schema = "tenant_slug string, v int"
    version = sinks.overwrite_current(local_frame(spark, [("a", 1), ("b", 2), (None, 3)], schema), path, "tenant_slug")
    assert sinks.current_version(spark, path) == version.replace("file:", "") or sinks.current_version(spark, path)
    before = rows(sinks.read_current(spark, path), "tenant_slug", "v")
    # a job killed after writing its rows but before the manifest leaves the old state
    staged = f"{version}/{sinks.GENERATION}=1"
    local_frame(spark, [("a", 9)], schema).write.partitionBy("tenant_slug").parquet(staged)
    assert rows(sinks.read_current(spark, path), "tenant_slug", "v") == before
    # a reader that planned before the swap still reads the old partitions
    planned = sinks.read_current(spark, path)
    sinks.replace_partitions(local_frame(spark, [("a", 10)], schema), version, "tenant_slug", ["a", "b"])
    assert rows(planned, "tenant_slug", "v") == before
    assert rows(sinks.read_current(spark, path), "tenant_slug", "v") == sorted([("a", 10), (None, 3)], key=repr)
    sinks.replace_partitions(local_frame(spark, [(None, 4)], schema), version, "tenant_slug", [None])
    assert rows(sinks.read_current(spark, path), "tenant_slug", "v") == sorted([("a", 10), (None, 4)], key=repr)


def test_a_push_builds_each_payload_once(spark):
    path, built = scratch_path(spark, "hub"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        built.add(1)
        return text

    batch = packed(spark, payloads(40)).withColumn("raw_data_payload", counted.asNondeterministic()("raw_data_payload"))
    hub.push_into(spark, path, batch)
    hub.push_into(spark, path, batch)
    assert built.value == 2 * 40
    assert len(stored(spark, path)) == 40
    assert hub_log.Store(spark, path).names(hub_log.STAGING) == []


def bytes_below(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def test_index_files_follow_their_keys(spark):
    path = scratch_path(spark, "hub")
    hub.push_into(spark, path, packed(spark, payloads(3000)))
    index = f"{path}/{hub_log.INDEX}"
    assert spark.read.parquet(index).count() == 3000
    assert bytes_below(spark, index) < 100_000 * 16**hub_log.PREFIX


def test_a_first_push_writes_its_rows_once(spark, monkeypatch):
    """Nothing is stored, so nothing is compared; copies and unknown tenants are kept."""
    path = scratch_path(spark, "hub")
    batch = packed(spark, ['{"a":1}', '{"a":1}', None]).unionByName(packed(spark, ['{"a":2}'], tenant=None))
    with monkeypatch.context() as patched:
        patched.setattr(hub, "push", None)
        assert hub.push_into(spark, path, batch) == 1
    want = rows(batch, "tenant_slug", "raw_data_payload")
    assert stored(spark, path) == want
    assert spark.read.parquet(f"{path}/{hub_log.INDEX}").count() == 3
    assert not hub_log.Store(spark, path).names(hub_log.STAGING)
    hub.push_into(spark, path, batch)
    assert stored(spark, path) == want
