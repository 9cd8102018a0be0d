"""What the findings of round 4 named, on small inputs of their kind."""

import hashlib
import os

import duckdb
import pytest

from larder.plans import streams
from larder.sources import library_io


def _named(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _put(path, content: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


@pytest.mark.parametrize("n", [300, 900])
def test_the_driver_holds_no_list_of_media(spark, tmp_path, monkeypatch, n):
    """What the plan reads, and so what the driver holds, is as many lists for 900 files as for 300, and no media file."""
    monkeypatch.setattr(library_io, "LISTED", 7)
    monkeypatch.setattr(library_io, "READ_FILES", 50)
    for i in range(n):
        c = str(i).encode()
        _put(tmp_path / f"{i % 9:02x}" / f"{_named(c)}.mp4", c)
    read = library_io.media_inventory(spark, str(tmp_path))
    held = read.inputFiles()
    assert len(held) <= 2 * spark.sparkContext.defaultParallelism and not any(".mp4" in f for f in held)
    assert read.rdd.getNumPartitions() == n // 50
    rows = read.collect()
    assert len(rows) == n and {r.name for r in rows} == {_named(str(i).encode()) + ".mp4" for i in range(n)} and all(r.intact for r in rows)


def test_folders_of_any_depth_are_listed_as_by_sparks_readers(spark, tmp_path):
    names = {k: _named(k.encode()) for k in "abcdefghijkl"}
    seen = {"a": "{}.mp4", "b": "00/{}.JPG", "c": "00/x/y/{}.png", "d": "_k=1/{}.mp4", "e": "s p%20/é/{}.bin"}
    unseen = {"f": ".hid/{}.mp4", "g": "_hid/{}.mp4", "h": "00/.{}.mp4", "i": "{}.mp4._COPYING_", "j": "{}", "k": "Z{}.mp4"}
    for k, p in (seen | unseen).items():
        _put(tmp_path / p.format(names[k]), k.encode())
    _put(tmp_path / f"{_named(b'')}.mp4", b"")
    (tmp_path / "empty").mkdir()
    (tmp_path / f"{names['l']}.mp4").symlink_to("/nonexistent")
    with open(os.fsencode(tmp_path) + b"/00/\xff\xfe.bin", "wb") as f:
        f.write(b"x")

    def found(folder, *pattern):
        return sorted(r.name[:64] for r in library_io.media_inventory(spark, folder, *pattern).collect() if r.intact)

    def want(keys):
        return sorted(names[k] for k in keys)

    assert found(str(tmp_path)) == want("abcde")
    assert found(f"file:{tmp_path}/", "*.{JPG,png}") == want("bc")
    assert found(f"{tmp_path}/0?") == want("bc")
    assert found(f"{tmp_path}/*.mp4*") == want("a")
    with pytest.raises(FileNotFoundError):
        library_io.media_inventory(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("texts", [[None, ""], ["a", "a", "", None, "ß"]])
def test_round_trip_of_few_or_no_texts_equals_its_sql(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = streams.io2_media_round_trip(spark, str(tmp_path))
    want = con.execute(streams.plan.sql["io2_media_round_trip"])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
