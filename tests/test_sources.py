"""Readers and writers, on files made here."""

import os

import pytest
from pyspark.errors import AnalysisException

from shelfmark.operators import change, reports
from shelfmark.sources import inventory, listing, state


def touch(root, path, content=b"x"):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content)
    return target


def test_inventories(spark, tmp_path):
    for path in ("a/_DSC1.JPG", "a/b/c.jpg", ".hidden/d.jpg", "a/._e.jpg", "@eaDir/f.jpg", "g.txt"):
        touch(tmp_path, path, b"12345")
    os.utime(tmp_path / "a/b/c.jpg", ns=(0, 1_234_567_890_123_456_789))
    os.utime(tmp_path / "g.txt", ns=(0, -5))
    listed = inventory.read_inventory(spark, [str(tmp_path), str(tmp_path / "g.txt")])
    names = {r["path"].removeprefix(f"{tmp_path}/"): r for r in listed.collect()}
    assert "a/b/c.jpg" in names and "a/_DSC1.JPG" not in names and len(names) == 3
    assert names["a/b/c.jpg"]["mtime_ns"] == 1_234_567_890_123_000_000
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    with pytest.raises(AnalysisException):
        inventory.read_inventory(spark, [str(tmp_path / "nowhere")]).count()


def test_listing_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"Response": {"Node": [\n{"Key": 1, "Name": "a"}, {"Key": 2}], "Pages": {"Total": 3}}}')
    (tmp_path / "2.json").write_text('{"Response": {"Pages": {}}}')
    (tmp_path / "3.json").write_text('{"Response": {"Node": [{"Key": 3, "Name": "c"}]}}')
    items = listing.read_listing_pages(spark, str(tmp_path), "Node", "Key bigint, Name string")
    assert sorted((r["Key"], r["Name"]) for r in items.collect()) == [(1, "a"), (2, None), (3, "c")]
    first = listing.read_listing_pages(spark, str(tmp_path), "Node", "Key bigint, Name string", limit=2)
    assert [r["Key"] for r in first.collect()] == [1, 2]
    # The tenth page comes after the ninth, and items may nest.
    (tmp_path / "10.json").write_text('{"Response": {"Node": [{"Key": 10, "Sum": "1.50", "At": {"X": 1}}]}}')
    nested = listing.read_listing_pages(spark, str(tmp_path), "Node", "Key bigint, Sum decimal(10,2), At struct<X: int>", limit=9)
    assert [r["Key"] for r in nested.collect()] == [1, 2, 3, 10] and nested.schema["Sum"].dataType.simpleString() == "decimal(10,2)"


def test_scratch_needs_a_shared_folder_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    from shelfmark.session import shared_dir

    def session(master, configured=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=context)

    assert shared_dir(session("spark://host:7077", "/shared")) == "/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(session("local-cluster[2,1,1024]"))


def test_state_versions(spark, tmp_path):
    folder = str(tmp_path / "state")
    files, hashes = state.read_state(spark, folder)
    assert files.count() == 0 and hashes.count() == 0
    one = change.complete_state(spark.createDataFrame([("a", 1)], "path string, size bigint"))
    known = spark.createDataFrame([("s", "/i", "A", "I", None, 4, "a")], state.HASHES_SCHEMA)
    assert state.write_state(spark, folder, one, known) == 0
    files, hashes = state.read_state(spark, folder)
    more = change.upsert(files, change.complete_state(spark.createDataFrame([("a", 2), ("b", 3)], "path string, size bigint")), "path")
    assert state.write_state(spark, folder, more, hashes) == 1
    # A version without its marker does not count.
    os.remove(f"{folder}/v=1/_COMPLETE")
    assert state.versions(spark, folder) == [0]
    assert state.write_state(spark, folder, more, hashes, 1) == 1
    files, hashes = state.read_state(spark, folder)
    assert sorted((r["path"], r["size"]) for r in files.collect()) == [("a", 2), ("b", 3)]
    assert state.read_state(spark, folder, 0)[0].count() == 1
    state.clear_state(spark, folder)
    assert [t.count() for t in state.read_state(spark, folder)] == [0, 0]
    assert tuple(reports.state_stats(state.read_state(spark, folder)[1]).first())[:2] == (0, 0)


def test_run_summary_document(spark, tmp_path):
    summary = spark.createDataFrame([("/lib", 3, None)], "folder string, uploaded bigint, failed bigint")
    state.write_run_summary(summary, str(tmp_path / "run"))
    text = "".join(p.read_text() for p in (tmp_path / "run").glob("*.json"))
    assert text.strip() == '{"folder":"/lib","uploaded":3,"failed":null}'


def test_inventories_with_a_manifest(spark, tmp_path):
    rows = [("/a/_x.jpg", 0), ("/a/.y.jpg", 1), ("/a/z.jpg", None), ("/a/z.jpg", None), (None, 3)]
    listing = spark.createDataFrame(rows, "path string, size bigint").repartition(3)
    inventory.write_inventory(listing, f"{tmp_path}/i")
    key = lambda r: (r[0] or "", r[1] or 0)
    read = lambda **o: sorted([tuple(r) for r in inventory.read_manifest(spark, f"{tmp_path}/i", **o).collect()], key=key)
    assert read() == read(checksums=True) == sorted(rows, key=key)
    # What is not listed is not read.
    listing.limit(1).write.mode("append").parquet(f"{tmp_path}/i/parts")
    assert read(checksums=True) == sorted(rows, key=key)
    listed = {r["part"]: r for r in spark.read.json(f"{tmp_path}/i/manifest").collect()}
    part = tmp_path / "i/parts" / sorted(listed)[0]
    whole = part.read_bytes()
    part.write_bytes(whole[:-1])
    with pytest.raises(inventory.BrokenInventory, match=part.name):
        read()
    part.unlink()
    with pytest.raises(inventory.BrokenInventory):
        read()
    with pytest.raises(inventory.BrokenInventory):
        inventory.read_manifest(spark, f"{tmp_path}/nowhere")
    inventory.write_inventory(listing.limit(0), f"{tmp_path}/none")
    assert inventory.read_manifest(spark, f"{tmp_path}/none", checksums=True).schema == listing.schema


def test_parts_of_other_rows(spark, tmp_path):
    """As many bytes, other rows: only the sums tell."""
    for name, size in (("a", 1), ("b", 2)):
        inventory.write_inventory(spark.createDataFrame([("/x", size)], "path string, size bigint").coalesce(1), f"{tmp_path}/{name}")
    one, other = (next((tmp_path / n / "parts").glob("part-*.parquet")) for n in "ab")
    assert one.stat().st_size == other.stat().st_size
    one.write_bytes(other.read_bytes())
    (one.parent / f".{one.name}.crc").write_bytes((other.parent / f".{other.name}.crc").read_bytes())
    with pytest.raises(inventory.BrokenInventory):
        inventory.read_manifest(spark, f"{tmp_path}/a", checksums=True)
