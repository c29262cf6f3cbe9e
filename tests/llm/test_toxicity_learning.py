"""What the toxicity model may learn from."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from meshwright.llm import toxicity

DATA = "/root/testdata/sf0.01"


def test_held_out_labels_change_nothing(spark, tmp_path):
    docs, labels = (pd.read_parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held_out = labels.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert held_out.sum() > 20
    docs.to_parquet(tmp_path / "documents.parquet")
    turned = labels.assign(toxic=np.where(held_out, 1 - labels.toxic, labels.toxic))
    turned.to_parquet(tmp_path / "labels.parquet")
    scores = [{r["doc_id"]: r["score"] for r in toxicity.op2_toxicity(spark, d).collect()} for d in (DATA, str(tmp_path))]
    assert scores[0] == scores[1]


def test_penalty_by_cross_validation_in_learning_rows():
    """Of penalties far apart the one in use is the best, by texts of learning rows that a fit has not seen."""
    docs = pd.read_parquet(f"{DATA}/documents.parquet").merge(pd.read_parquet(f"{DATA}/labels.parquet"), on="doc_id")
    docs = docs[docs.toxic.isin([0, 1]) & (docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) != 0)].sort_values("doc_id")
    texts = pa.array(docs.text.fillna("").tolist())
    doc, words, counts = toxicity.word_counts(texts)
    at = np.searchsorted(doc, np.arange(len(docs) + 1))
    rows = [(int(y), words[a:b], counts[a:b]) for y, a, b in zip(docs.toxic, at[:-1], at[1:], strict=True)]
    loss = toxicity.cross_validated(rows, texts, [0.002, 0.2])
    assert loss[0.002] < loss[0.2]
