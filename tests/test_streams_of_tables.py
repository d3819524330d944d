"""Streamed queries over a table that is a folder of files."""

from workload import registry
from workload.inputs import table

SF = "/root/testdata/sf0.001"


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    table(spark, SF, "documents").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("st_scan", "st_dedupe"):
        got, want = (sorted(map(tuple, registry.QUERIES[name](spark, sf).collect()), key=repr) for sf in (str(tmp_path), SF))
        assert got == want and got
