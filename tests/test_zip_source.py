"""Zip archives as a Spark data source."""

import io
import zipfile

import pytest

from shutterloom.sources import zip_source


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, members in {"a.zip": {"x/1.jpg": b"1" * 500, "x/2.txt": b"", "ünï/3.JPG": b"333"}, "deep/er/b.ZIP": {f"m{k:03d}.jpg": bytes([k]) * 3000 for k in range(100)}, "empty.zip": {}}.items():
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_STORED) as z:
            z.writestr("folder/", b"")
            for member, content in members.items():
                z.writestr(member, content)
    (tmp_path / "no.txt").write_text("no archive")
    return tmp_path


def test_members_of_all_archives(spark, folder):
    zip_source.registered(spark)
    rows = spark.read.format("zip").load(f"file://{folder}").collect()
    assert len(rows) == 103
    got = {(r.archive.rpartition("/")[2], r.member): bytes(r.content) for r in rows}
    assert got["a.zip", "ünï/3.JPG"] == b"333" and got["a.zip", "x/2.txt"] == b"" and got["b.ZIP", "m007.jpg"] == b"\x07" * 3000
    assert all(r.size == len(r.content) for r in rows)
    assert spark.read.format("zip").option("suffixes", ".jpg").load(str(folder)).count() == 102


def test_a_large_archive_is_read_by_many_tasks(spark, folder):
    zip_source.registered(spark)
    df = spark.read.format("zip").option("partitionbytes", 20_000).load(str(folder / "deep"))
    assert df.rdd.getNumPartitions() >= 15
    assert sorted(r.member for r in df.select("member").collect()) == [f"m{k:03d}.jpg" for k in range(100)]


def test_columns_are_pruned_and_conditions_pushed(spark, folder, monkeypatch):
    zip_source.registered(spark)
    rows = spark.read.format("zip").schema("member string, size long").load(str(folder))
    assert rows.columns == ["member", "size"] and rows.where("size = 3000").count() == 100
    found = rows.where("member = 'x/1.jpg'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The source itself applies the condition, so Spark is left with none on its value.
    assert "BatchScan" in plan and "x/1.jpg" not in plan
    assert [tuple(r) for r in found.collect()] == [("x/1.jpg", 500)]
    reader = zip_source.ZipReader(rows.schema, {"path": str(folder)})
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda *a: pytest.fail("nothing is unpacked"))
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 103


def test_archives_that_climb_or_are_damaged_or_absent(spark, tmp_path):
    zip_source.registered(spark)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../evil.txt", b"x")
    (tmp_path / "evil.zip").write_bytes(out.getvalue())
    with pytest.raises(Exception, match="evil"):
        spark.read.format("zip").load(str(tmp_path)).collect()
    (tmp_path / "evil.zip").write_bytes(out.getvalue()[:40])
    with pytest.raises(Exception, match="zip"):
        spark.read.format("zip").load(str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("zip").load(str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("zip").schema("colour string").load(str(tmp_path)).collect()
