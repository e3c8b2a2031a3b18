"""A file a video, written by tasks and read back."""

import os

from strideframe.plans import files
from strideframe.sources import readers


def test_documents_are_written_by_tasks(spark, tmp_path):
    """No committer stands between a task and its files, and no folder is left half done."""
    rows = [(v, f'[{{"n": {v}, "name": "é{v}"}}]') for v in range(50)]
    path = files.documents(spark.createDataFrame(rows, "video_id long, value string"), f"file://{tmp_path}/a", "x.json")
    root = f"{tmp_path}/a"
    assert sorted(os.listdir(root)) == sorted(f"video_id={v}" for v, _ in rows)  # without the committer's marks
    assert all(os.listdir(f"{root}/video_id={v}") == ["x.json"] for v, _ in rows)
    got = readers.read_features(spark, path, "n bigint, name string")
    assert sorted((r.n, r.name) for r in got.collect()) == [(v, f"é{v}") for v, _ in rows]


def test_folders_are_listed_by_few_tasks(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with readers.listing(spark):
        assert int(spark.conf.get(name)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    """However few files Spark would give a task; names and texts are what they were as whole texts."""
    from pyspark.sql import functions as F

    for v in range(150):
        (tmp_path / f"a b{v}").mkdir()
        (tmp_path / f"a b{v}" / "x.json").write_text("" if v == 7 else '{"rows": [broken' if v == 8 else f'{{"features": [{{"n": {v}, "name": "é\\n{v}"}},\n{{"n": null}}]}}\n', encoding="utf-8")
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, 1 << 27)
    try:
        out = readers.read_features(spark, f"file://{tmp_path}", "n bigint, name string")
        assert out.rdd.getNumPartitions() <= readers.TASKS * spark.sparkContext.defaultParallelism < 150
        got = {(r.file, r.n, r.name) for r in out.collect()}
    finally:
        spark.conf.set(name, before)
    texts = spark.read.option("recursiveFileLookup", True).text(str(tmp_path), wholetext=True).select(F.input_file_name().alias("file")).collect()
    number = lambda f: int(f.split("b")[-1].split("/")[0])
    some = {t.file: number(t.file) for t in texts if number(t.file) not in (7, 8)}
    assert got == {(f, v, f"é\n{v}") for f, v in some.items()} | {(f, None, None) for f in some}
