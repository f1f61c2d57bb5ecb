"""Delimited loaders: encodings decided per file, without a job at load time; no silent local folder on a cluster."""

import os

import pytest

from harvestry.session import ensure_checkpoint_dir, shared_path
from harvestry.sources import loaders as L


def _write(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


def test_encodings_mixed_in_one_folder(spark):
    folder = shared_path(spark, "mixed").removeprefix("file://")
    _write(folder, "a.csv", "name,n\ncafé,1\n".encode("latin-1"))
    _write(folder, "b.csv", "name,n\ncafé,2\n東京,3\n".encode())
    _write(folder, "c.csv", "name,n\nbad � café,4\n".encode())
    df = L.read_delimited(spark, folder, L.all_text_schema(spark, folder))
    assert {r.n: r.name for r in df.collect()} == {"1": "café", "2": "café", "3": "東京", "4": "bad � café"}


def test_a_latin1_file_stays_latin1_where_a_value_would_pass_for_utf8(spark):
    folder = shared_path(spark, "per-file").removeprefix("file://")
    _write(folder, "a.csv", "name,n\nÃ©,1\ncafé,2\n".encode("latin-1"))  # the first value's bytes are those of é in UTF-8
    _write(folder, "b.csv", "name,n\né,3\n".encode())
    df = L.load_text_table(spark, folder)
    assert {r.n: r.name for r in df.collect()} == {"1": "Ã©", "2": "café", "3": "é"}


def test_no_job_before_the_result_is_asked_for(spark):
    import gzip
    folder = shared_path(spark, "lazy").removeprefix("file://")
    _write(folder, "a.csv.gz", gzip.compress(b'name,"a, b"\nx,1\n'))
    spark.sparkContext.setJobGroup("lazy-load", "")
    df = L.load_text_table(spark, folder)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy-load")
    spark.sparkContext.setJobGroup("other", "")
    assert df.columns == ["name", "a, b"] and [tuple(r) for r in df.collect()] == [("x", "1")]


def test_header_names_are_decoded(spark):
    folder = shared_path(spark, "header").removeprefix("file://")
    _write(folder, "a.csv", "Área,n\nx,1\n".encode())
    assert L.load_text_table(spark, folder).columns == ["Área", "n"]


def test_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
