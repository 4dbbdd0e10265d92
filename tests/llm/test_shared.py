"""Scratch tables."""

import pytest

from fieldbook.llm import shared


def test_scratch_scope_deletes_what_was_made_inside(spark):
    before = shared.materialize(spark.range(3), "kept")
    with shared.scratch_scope(spark):
        a = shared.materialize(spark.range(5), "a")
        with shared.scratch_scope(spark):
            b = shared.materialize(spark.range(7), "b")
            assert b.count() == 7
        assert a.count() == 5 and spark.conf.get("fieldbook.scope")
        with pytest.raises(Exception):  # noqa: B017 the files are gone
            spark.read.parquet(b.inputFiles()[0]).count()
        inner = a.inputFiles()[0]
    assert before.count() == 3 and spark.conf.get("fieldbook.scope", None) is None
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(inner).count()


def test_a_failure_inside_still_deletes(spark):
    with pytest.raises(ValueError), shared.scratch_scope(spark):
        name = shared.materialize(spark.range(5), "a").inputFiles()[0]
        raise ValueError
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(name).count()
