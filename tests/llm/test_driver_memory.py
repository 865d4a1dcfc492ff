"""What the driver holds between the stages of the pipeline."""

from __future__ import annotations

import tracemalloc
import weakref

import numpy as np

from partweave.llm import language_id


def test_the_sample_is_given_back(spark, monkeypatch):
    """pipeline: after training the sample's features are gone, and their memory is the system's."""
    rows = spark.createDataFrame([(i, f"{'der hund' if i % 2 else 'the dog'} {i}", "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    held, gone, train = [], [], language_id.train

    def watched(sample, *rest):
        held.append(weakref.ref(sample[0][0]))
        return train(sample, *rest)

    monkeypatch.setattr(language_id, "train", watched)
    monkeypatch.setattr(language_id, "give_back", lambda: gone.append(held[0]() is None))
    model = language_id.fit(rows, "text", "lang", "doc_id", 1000)
    assert gone == [True] and sorted(model.classes) == ["de", "en"]


def test_training_holds_one_vector():
    """pipeline: training takes no more memory for more rows of the sample."""
    found, counts = np.arange(20_000, dtype=np.int32), np.ones(20_000, np.int32)
    peaks = []
    for n in (10, 200):
        rows = [(found, counts, "de" if i % 2 else "en") for i in range(n)]
        tracemalloc.start()
        language_id.train(rows, ["de", "en"], np.ones(language_id.BUCKETS))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + (2 << 20)
