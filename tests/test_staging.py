"""Scratch tables: where they may lie, and that they go."""

import os

import pytest

from curatrix.staging import scratch, shared_base, staged, write_staged


def test_only_a_local_master_may_use_a_local_folder():
    assert shared_base("s3a://bucket/x/", "spark://host:7077") == "s3a://bucket/x"
    assert shared_base(None, "local[4]").startswith("file:///tmp/") and shared_base("", "local").startswith("file:///tmp/")
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_base(None, master)


def test_scratch_block_removes_its_tables(spark):
    with scratch(spark):
        path = write_staged(spark.range(3), "gone")
        with scratch(spark):
            inner = write_staged(spark.range(0), "inner")
        assert os.path.isdir(path.removeprefix("file:")) and not os.path.exists(inner.removeprefix("file:"))
        assert staged(spark.range(5), "kept").count() == 5
    assert not os.path.exists(path.removeprefix("file:"))
