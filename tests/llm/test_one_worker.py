"""The pipeline's encoding keeps one Python worker a task."""

from __future__ import annotations

import pytest

import corpus_pipeline
from docloom.llm import bpe_codec


def workers(node):
    """Python workers that the most demanding stage of a plan needs for a task, and those of the stage at its top."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return workers(node.initialPlan())
    below = [workers(node.children().apply(i)) for i in range(node.children().size())]
    most, here = max([b[0] for b in below], default=0), max([b[1] for b in below], default=0)
    here = 0 if "Exchange" in name else here + (name == "MapInArrowExec")
    return max(most, here), here


def test_one_worker_a_task(spark, odd):
    plan = corpus_pipeline.encoding(spark, odd, "")._jdf.queryExecution().executedPlan()
    assert workers(plan)[0] == 1


@pytest.mark.parametrize("sizes", [{}, {"chunk_chars": 200, "overlap_chars": 40}])
def test_same_rows_as_encoding_then_decoding(odd, empty, sizes):
    def rows(df):
        return sorted(((r.doc_id, list(r.token_ids), bytes(r.content)) for r in df.collect()), key=repr)

    assert rows(bpe_codec.encode_decode(odd, **sizes)) == rows(bpe_codec.decode(bpe_codec.encode(odd, **sizes)))
    assert rows(bpe_codec.encode_decode(empty, **sizes)) == []
