import datetime
import os
import random

import pytest
from pyspark.sql import functions as F
from test_queries import plan_of

from inspectlake.fixtures import fixture
from inspectlake.operators import projects as P
from inspectlake.operators.cache import cache_ttl_fold
from inspectlake.plans import storage
from inspectlake.session import saved, work_dir
from inspectlake.sources import files, tables, versions
from inspectlake.streaming import streams as Q


def upload(root, project, kind, name, data=b"x"):
    folder = os.path.join(root, project, "uploads", kind)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_ingest_and_image_glob(spark, tmp_path):
    root = str(tmp_path)
    for kind, name in (("handwritten", "a.pdf"), ("scanned", "b.pdf"), ("images", "c.jpg"), ("images", "d.png"), ("images", "e.gif")):
        upload(root, "p1", kind, name, name.encode())
    rows = files.ingest_files(spark, root)
    got = {(r["project_id"], r["doc_type"], os.path.basename(r["path"]), bytes(r["content"])) for r in rows.collect()}
    assert ("p1", "scanned", "b.pdf", b"b.pdf") in got and len(got) == 5
    assert {os.path.basename(r["path"]) for r in files.image_glob(spark, root).collect()} == {"c.jpg", "d.png"}
    plan = rows.select("path")._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]


def test_stream_ingest_restarts_without_repeats(spark, tmp_path):
    root, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    upload(root, "p1", "scanned", "a.pdf")
    upload(root, "p2", "images", "b.jpg")
    for _ in range(2):
        Q.stream_ingest(files.stream_files(spark, root), out, progress)
    assert spark.read.parquet(out).count() == 2
    upload(root, "p2", "images", "c.jpg")
    Q.stream_ingest(files.stream_files(spark, root), out, progress)
    assert spark.read.parquet(out).count() == 3


def test_projects(spark, tmp_path):
    path = str(tmp_path / "projects")
    when = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    new = P.create_projects(spark.createDataFrame([("1", "A"), (None, "B")], "project_id string, project_name string"), when)
    tables.save_projects(new, path)
    stored = tables.load_projects(spark, path)
    assert stored.count() == 2 and stored.filter("error is not null").count() == 0
    b = stored.filter("project_name = 'B'").first()
    assert len(b["project_id"]) == 36 and b["status"] == "created" and b["created_at"] == datetime.datetime(2024, 1, 1, 10)
    wanted = spark.createDataFrame([("1",), ("9",)], "project_id string")
    got = {r["project_id"]: r["error"] for r in tables.load_projects(spark, path, wanted).collect()}
    assert got == {"1": None, "9": "Project 9 not found"}
    # A later save adds projects and replaces those it has; earlier ones stay.
    more = P.create_projects(spark.createDataFrame([("1", "A2"), ("9", "C")], "project_id string, project_name string"), when)
    tables.save_projects(more, path)
    assert sorted(r["project_name"] for r in tables.load_projects(spark, path).collect()) == ["A2", "B", "C"]


def test_one_indented_project_per_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{\n "project_id": "7",\n "project_name": "N"\n}')
    assert tables.load_projects(spark, str(tmp_path), multi_line=True).first()["project_name"] == "N"


def test_artifacts_keep_the_last_write(spark, tmp_path):
    path, schema = str(tmp_path / "artifacts"), tables.ARTIFACT
    for rows in ([(1, "mapping", 1, "old"), (2, "mapping", 1, "two")], [(1, "mapping", 2, "new"), (1, "unknown_output", 3, "x")]):
        tables.write_artifacts(spark.createDataFrame(rows, schema), path)
    want = {(1, "mapping", "new"), (2, "mapping", "two"), (1, "unknown_output", "x")}
    assert {(r["project_id"], r["artifact"], r["payload"]) for r in tables.read_artifacts(spark, path).collect()} == want
    tables.compact_artifacts(spark, path, path + "-2")
    assert spark.read.parquet(path + "-2").count() == 3


def catalog_rows(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "page_id long, name string")


def loaded(spark, path):
    return [sorted(map(tuple, rows.collect())) for rows in tables.load_catalog(spark, path)]


def test_a_catalog_keeps_other_pages(spark, tmp_path):
    path, one = str(tmp_path / "catalog"), catalog_rows(spark)
    none = one().limit(0)
    tables.save_catalog(path, one((1, "a"), (1, "b"), (2, "c")), one((1, "s")), none)
    tables.save_catalog(path, one((1, "d")), none, one((3, "t")))
    assert loaded(spark, path) == [[(1, "d"), (2, "c")], [], [(3, "t")]]
    # A page that has nothing any more is named, and many saves become one folder.
    for _ in range(3):
        tables.save_catalog(path, one((3, "e")), none, none, pages=one((2, ""), (3, "")), compact_every=2)
    assert loaded(spark, path) == [[(1, "d"), (3, "e")], [], []]
    assert len(versions.read_manifest(spark, path)[1]["commits"]) <= 2


def test_a_stopped_save_leaves_the_catalog(spark, tmp_path, monkeypatch):
    path, one = str(tmp_path / "catalog"), catalog_rows(spark)
    tables.save_catalog(path, one((1, "a")), one((1, "s")), one((1, "t")))
    before = loaded(spark, path)
    broken = one((1, "x")).select("page_id", F.raise_error(F.lit("stopped between the tables")).cast("string").alias("name"))
    with pytest.raises(Exception, match="stopped between"):
        tables.save_catalog(path, one((1, "b"), (2, "c")), broken, one((1, "u")))
    assert loaded(spark, path) == before
    # Two saves at the same version: the second takes the next one.
    real, raced = tables.write_manifest, []

    def races(spark, path, version, content):
        if not raced:
            raced.append(version)
            monkeypatch.setattr(tables, "write_manifest", real)
            tables.save_catalog(path, one((2, "other")), one(), one())
        return real(spark, path, version, content)

    monkeypatch.setattr(tables, "write_manifest", races)
    tables.save_catalog(path, one((3, "mine")), one(), one())
    assert loaded(spark, path)[0] == [(1, "a"), (2, "other"), (3, "mine")]
    assert versions.read_manifest(spark, path)[0] == 2


def test_requested_projects_are_pruned_before_they_are_aggregated(spark, tmp_path):
    path = str(tmp_path / "projects")
    when = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([(str(k), f"P{k}") for k in range(300)], "project_id string, project_name string")
    tables.save_projects(P.create_projects(rows, when), path)
    wanted = spark.createDataFrame([("7",), ("8",)], "project_id string")
    found = tables.load_projects(spark, path, wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    semi, grouped = plan.index("LeftSemi"), plan.index("max_by(")
    assert grouped < semi and "PartitionFilters: [(bucket" in plan
    assert sorted(r["project_name"] for r in found.collect()) == ["P7", "P8"]
    folders = {f.split("/")[-2] for f in found.inputFiles() if "bucket=" in f}
    assert len(folders) > 2  # the store; the filter above leaves two of them


def test_lists_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "lists")
    for rows in ([(1, "image_output", 1, k, f"a{k}") for k in range(5)] + [(2, "image_output", 1, 0, "b")], [(1, "image_output", 2, 0, "c")]):
        tables.write_lists(spark.createDataFrame(rows, tables.LIST), path)
    assert {(r["project_id"], r["ordinal"], r["payload"]) for r in tables.read_lists(spark, path).collect()} == {(1, 0, "c"), (2, 0, "b")}


def test_views_of_the_user_are_left_alone(spark, sf):
    spark.range(1).createOrReplaceTempView("events")
    assert fixture(spark, sf, "fx_response").count() > 1
    assert spark.table("events").count() == 1
    spark.catalog.dropTempView("events")


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    path = work_dir(spark, "x")
    assert path.startswith(folder) if folder else path.startswith("/tmp/")
    assert saved(spark.range(3), "numbers").count() == 3


REVIEW = "seq long, project_id long, action string, field_name string, new_value string"


def review_events(n):
    return [(s, s % 3, "edit" if s % 2 else "approved" if s % 4 else "rejected", f"f{s % 2}", f"v{s}") for s in range(n)]


def last_of(rows):
    want = {}
    for s, p, action, field, value in rows:
        kind = ("edit", field) if action == "edit" else ("decision", None)
        want[(p, *kind)] = (s, action, value)
    return {(*k, *v) for k, v in want.items()}


def reviewed(spark, out):
    return {(r["project_id"], r["kind"], r["field_name"], r["seq"], r["action"], r["new_value"]) for r in Q.review_state(spark, out).collect()}


def test_review_stream_over_several_batches(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("events", "out", "progress"))
    rows = review_events(60)
    for n in range(6):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], REVIEW).coalesce(1).write.mode("append").parquet(source)
    stream = Q.stream_parquet(spark, source, spark.createDataFrame([], REVIEW).schema, files_per_trigger=1)
    for _ in range(2):
        Q.stream_review(stream, out, progress, compact_every=2)
    # Six batches: the state is in one snapshot and at most two newer folders.
    version, content = versions.read_manifest(spark, out)
    assert version == 5 and len(content["folders"]) <= 3 and content["folders"][0].startswith("snapshot")
    assert reviewed(spark, out) == last_of(rows)
    scans = Q.review_state(spark, out).inputFiles()
    assert {f.split("/")[-2] for f in scans} <= set(content["folders"])


def test_review_restarts_after_a_stop_in_mid_compaction(spark, tmp_path, monkeypatch):
    source, out, progress = (str(tmp_path / n) for n in ("events", "out", "progress"))
    rows = review_events(40)
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], REVIEW).coalesce(1).write.mode("append").parquet(source)
    stream = Q.stream_parquet(spark, source, spark.createDataFrame([], REVIEW).schema, files_per_trigger=1)
    real, stopped = versions.write_manifest, []

    def stops_once(spark, path, version, content):
        if content["folders"][0].startswith("snapshot") and not stopped:
            stopped.append(content["folders"][0])
            raise RuntimeError("stopped after the snapshot was written")
        return real(spark, path, version, content)

    monkeypatch.setattr(versions, "write_manifest", stops_once)
    with pytest.raises(Exception, match="stopped after the snapshot"):
        Q.stream_review(stream, out, progress, compact_every=1)
    assert stopped and os.path.exists(f"{out}/{stopped[0]}") and reviewed(spark, out) == last_of(rows[:10])
    Q.stream_review(stream, out, progress, compact_every=1)
    assert reviewed(spark, out) == last_of(rows)
    assert stopped[0] not in versions.read_manifest(spark, out)[1]["folders"]


def test_a_commit_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "table")
    assert versions.read_manifest(spark, path) == (-1, {})
    assert versions.write_manifest(spark, path, 3, {"a": 1}) and not versions.write_manifest(spark, path, 3, {"a": 2})
    assert versions.read_manifest(spark, path) == (3, {"a": 1})
    assert [n for n in os.listdir(f"{path}/_manifests") if n.endswith(".tmp")] == []


def cache_requests(n_batches, n, start):
    """Batches in time order; one key has a third of the rows."""
    rng = random.Random(11)
    batches, hour = [], 0
    for b in range(n_batches):
        rows = []
        for i in range(n):
            hour += rng.randrange(4)
            rows.append((b * n + i, "hot" if i % 3 == 0 else f"i{rng.randrange(9)}", "p", start + datetime.timedelta(hours=hour)))
        batches.append(rows)
    return batches


REQUEST = "req_id long, image_path string, prompt string, requested_at timestamp_ntz"


def test_cache_stream_equals_a_batch(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("requests", "out", "progress"))
    batches = cache_requests(6, 40, datetime.datetime(2024, 1, 1))
    for rows in batches:
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(source)
    stream = Q.stream_parquet(spark, source, spark.createDataFrame([], REQUEST).schema, files_per_trigger=1)
    Q.stream_cache(stream, out, progress, compact_every=2)
    whole = cache_ttl_fold(spark.createDataFrame([r for rows in batches for r in rows], REQUEST))
    want = sorted(r["req_id"] for r in whole.collect())
    assert sorted(r["req_id"] for r in Q.cache_misses(spark, out).collect()) == want
    # Later requests go on from the state; nothing is processed twice.
    more = [(1000 + i, "hot", "p", batches[-1][-1][3] + datetime.timedelta(hours=i)) for i in range(60)]
    spark.createDataFrame(more, REQUEST).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        Q.stream_cache(stream, out, progress, compact_every=2)
    whole = cache_ttl_fold(spark.createDataFrame([r for rows in [*batches, more] for r in rows], REQUEST))
    assert sorted(r["req_id"] for r in Q.cache_misses(spark, out).collect()) == sorted(r["req_id"] for r in whole.collect())


def test_a_cache_batch_that_runs_again_adds_nothing(spark, tmp_path, monkeypatch):
    source, out, progress = (str(tmp_path / n) for n in ("requests", "out", "progress"))
    batches = cache_requests(5, 30, datetime.datetime(2024, 1, 1))
    for rows in batches:
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(source)
    stream = Q.stream_parquet(spark, source, spark.createDataFrame([], REQUEST).schema, files_per_trigger=1)
    real, seen = versions.write_manifest, []

    def stops(spark, path, version, content):
        """Stop once before the commit of batch 2, and once after that of batch 3."""
        seen.append(version)
        if version == 2 and seen.count(2) == 1:
            raise RuntimeError("stopped")
        done = real(spark, path, version, content)
        if version == 3 and seen.count(3) == 1:
            raise RuntimeError("stopped")
        return done

    monkeypatch.setattr(versions, "write_manifest", stops)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            Q.stream_cache(stream, out, progress)
    Q.stream_cache(stream, out, progress)
    assert seen == [0, 1, 2, 2, 3, 4]
    whole = cache_ttl_fold(spark.createDataFrame([r for rows in batches for r in rows], REQUEST))
    assert sorted(r["req_id"] for r in Q.cache_misses(spark, out).collect()) == sorted(r["req_id"] for r in whole.collect())


def test_log_windows_over_several_batches_equal_a_batch(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("logs", "out", "progress"))
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"s{i % 3}", start + datetime.timedelta(minutes=17 * i), "e" if i % 4 == 0 else None) for i in range(120)]
    logs = spark.createDataFrame(rows, "step string, at timestamp_ntz, error string")
    for n in range(3):
        part = spark.createDataFrame(rows[n * 40 : n * 40 + 40], logs.schema)
        part.coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream = Q.stream_parquet(spark, source, logs.schema, files_per_trigger=1)
        Q.stream_log_windows(stream, out, progress)
    want = Q.log_windows(logs.withColumn("at", F.col("at").cast("timestamp")))
    got = Q.latest_windows(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_project_results_parse_the_page_answers_once(spark, sf, monkeypatch):
    seen = []

    def stop(path, pages, failed, *rest, **options):
        seen.extend([pages, failed])
        raise InterruptedError

    monkeypatch.setattr(storage, "write_outputs", stop)
    with pytest.raises(InterruptedError):
        storage.project_results(spark, sf)
    # Pages and errors go into several branches, each of which would parse anew.
    assert [plan_of(rows).count("ArrowEvalPython") for rows in seen] == [0, 0]
