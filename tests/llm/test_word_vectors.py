"""Word vectors of the quality classifier come from every text of the table, whatever the network is fitted on."""

import numpy as np

from tidyledger.llm import quality


def slow_sums(texts):
    index, sums = quality.index_vectors(), np.zeros((quality.ROWS, quality.WIDTH))
    for text in texts:
        for numbers in quality.reader()(text.encode()):
            for at, word in enumerate(numbers):
                for near in [*numbers[max(0, at - quality.REACH) : at], *numbers[at + 1 : at + 1 + quality.REACH]]:
                    sums[word] += index[near]
    return sums


def test_vectors_take_texts_without_a_label(spark):
    texts = [(i, f"common words number {i} in a row") for i in range(20)]
    texts += [(100 + i, f"unlabelled rare{i} vocabulary stands here rare{i} Rare") for i in range(20)]
    texts += [(200, ""), (201, None), (202, "alone"), (203, "alone alone")]
    rows = spark.createDataFrame(texts, "row_index long, note string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "row_index long, verdict int")
    sums = quality.unpacked(quality.context_sums(rows.select("note")))
    assert (sums == slow_sums([t or "" for _, t in texts])).all()
    model = quality.Model.load(quality.fit(rows, labels, "note", "verdict", fit_rows=10))
    assert np.allclose(model.vectors, quality.word_vectors(sums))
    (rare,), _ = quality.reader()(b"rare7")
    bare = quality.index_vectors()[rare] / np.sqrt(quality.NONZERO)
    assert np.linalg.norm(model.vectors[rare] - bare) > 0.9


def test_sums_of_many_batches(monkeypatch, spark):
    monkeypatch.setattr(quality, "HELD", 7)
    import pyarrow as pa

    texts = ["a b c d e f g h", "b a", "c d e " * 9, "x"]
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], ["cell"]) for t in texts]
    (partial,) = quality._partial_sums(iter(batches))
    (whole,) = quality._whole_sums(iter([partial, partial]))
    found = np.zeros((quality.ROWS, quality.WIDTH))
    for part, blob in zip(*[c.to_pylist() for c in whole.columns]):
        own = np.frombuffer(quality.zlib.decompress(blob), np.int64).reshape(quality.PART, -1)
        found[part * quality.PART : (part + 1) * quality.PART] = own
    assert (found == 2 * slow_sums(texts)).all()
