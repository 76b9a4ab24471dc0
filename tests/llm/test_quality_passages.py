"""What the quality classifier trains on."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import fixtures_llm as X  # noqa: E402

from marketripple.llm import quality_mil as Q  # noqa: E402


def test_whole_texts_and_one_row_per_id_train(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.GatedAttention, "fit", lambda self, bags, y: seen.append((list(map(len, bags)), y)))
    docs = X.documents(spark, [X.prose(64 * 300, k) for k in range(20)])
    more = X.documents(spark, ["a", None, "zzz"] * 50, ids=[1, 2, 3] * 50)  # repeats of ids: the first text in order counts
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id bigint, quality int")
    Q.train(docs, labels)
    Q.train(docs.unionByName(more), labels)
    Q.train(docs, labels, per_label=2)
    (sizes, y), (again, y2), (_, few) = seen
    assert set(sizes) == {300} and len(sizes) == len(y) < 20 and y == y2 and sum(few) == 2 and len(few) == 4
    assert len(again) == len(sizes) and set(again) <= {1, 300}
