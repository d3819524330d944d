"""Ranged reads of objects: one line of 200 MB gives its first characters, and no more than the asked bytes are taken."""

import json

from palisade.sources import heads, objects


def test_a_line_of_200_mb(spark, tmp_path, monkeypatch):
    big = tmp_path / "a b" / "big.txt"
    big.parent.mkdir()
    with open(big, "wb") as f:
        f.write("é🙂x".encode() * 400)
        f.truncate(200_000_000)
    (tmp_path / "a b" / "small.json").write_bytes(b'{"a": 1}\n')
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "bad.log").write_bytes(b"a\xff\xfeb\nnext\n")
    (tmp_path / "other.bin").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r["sample"] for r in objects.sample_objects(spark, str(tmp_path), 10).collect()}
    assert got == {"big.txt": ("é🙂x" * 400)[:500], "small.json": '{"a": 1}', "bad.log": "a��b\nnext"}
    taken = []

    class File:
        def __enter__(self): return self
        def __exit__(self, *_): pass
        def size(self): return 200_000_000
        def read_at(self, n, at): return taken.append((n, at)) or b"x" * n
    monkeypatch.setattr(heads, "location", lambda path: (type("S", (), {"open_input_file": lambda self, name: File()})(), path))
    assert len(heads.head("big", 2048)[2]) == 2048 and taken == [(2048, 0)]


def test_one_partition_per_object_and_a_stream(spark, tmp_path):
    paths = []
    for k in range(5):
        (tmp_path / f"o{k}.txt").write_bytes(b"%d" % k * 9)
        paths.append(f"file:{tmp_path}/o{k}.txt")
    spark.dataSource.register(heads.ObjectHeads)
    df = spark.read.format("object_heads").option("paths", json.dumps(paths)).option("bytes", 4).load()
    assert df.rdd.getNumPartitions() == 5 and sorted(bytes(r["head"]) for r in df.collect()) == [b"%d" % k * 4 for k in range(5)]
    listing = tmp_path / "listing"
    for upto in (2, 5, 5):  # the list grows; each run takes what is new
        listing.write_text("\n".join(paths[:upto]) + "\n")
        stream = spark.readStream.format("object_heads").option("listing", str(listing)).option("bytes", 3).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(
            f"{tmp_path}/out").awaitTermination()
        assert sorted(bytes(r["head"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [b"%d" % k * 3 for k in range(upto)]
