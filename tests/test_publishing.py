from __future__ import annotations

import pytest

from lexoria.operators import publishing


def test_versions_apply_once_and_roll_back(spark, tmp_path):
    p = publishing.Publication(spark, str(tmp_path / "corpus"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, text string")
    first = p.apply(one, "plan-1")
    assert p.apply(one.limit(0), "plan-1") == first and p.read().count() == 2
    with pytest.raises(ValueError):
        p.apply(one, "plan-2", expected="another")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "document_id long, text string")
    p.apply(publishing.replace_documents(one, new), "plan-2", expected=first["history"][-1]["fingerprint"])
    assert sorted(map(tuple, p.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert p.rollback()["version"] == first["version"] and sorted(map(tuple, p.read().collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        p.rollback()
