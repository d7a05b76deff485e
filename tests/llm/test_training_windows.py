"""The rounds of the language model's training take every window of every training document."""

import random

import numpy as np
from pyspark.sql import functions as F

from carepath.llm import attention_lm as lm


def test_rounds_train_on_every_window(spark, monkeypatch):
    turns = []
    monkeypatch.setattr(lm, "_round", lambda train, model, class_of, end, kind, turn: turns.append(turn) or model)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("the house of river and stone".split()) for _ in range(20))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with open(lm.default_path(), encoding="utf-8") as f:
        source = f.read()
    lm.fit(lm.tokenized(docs, lm.count_words(docs), source, F.lit(False)), lm.Bpe(source))
    offsets = np.concatenate([[0], np.cumsum([1, 5, 32, 33, 300, 1, 4000])])
    everything = {(d, tuple(p)) for d, p in zip(*[x.tolist() for x in lm.windows(offsets)[:2]])}
    seen = [(d, tuple(p)) for t in turns for d, p in zip(*[x.tolist() for x in lm.windows(offsets, t)[:2]])]
    assert set(seen) == everything
    long = [x for x in seen if x[0] in (4, 6)]
    assert len(long) == len(set(long))  # once each where a document has a window for every round
