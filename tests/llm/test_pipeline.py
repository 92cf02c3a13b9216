"""The pipeline over odd, crowded and empty tables."""

from collections import Counter

import pytest
from conftest import rows


@pytest.mark.parametrize("kind", ["crowded", "nothing"])
def test_pipeline(spark, request, labels, tmp_path, kind):
    import corpus_pipeline

    docs = request.getfixturevalue(kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert kind == "crowded" or not got
    assert set(r.doc_id for r in got) <= {i for i, *_ in rows()}
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert all(n <= 2048 for n in filled.values())


def test_stages_keep_columns(spark, crowded, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, crowded, str(tmp_path)).columns == crowded.columns
