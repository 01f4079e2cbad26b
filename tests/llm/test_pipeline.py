"""The pipeline's stages against brute-force versions, each on what the stage before kept."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_duplicates import roots, slow_fingerprint, squeezed


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    repeated = docs.unionByName(docs.where("doc_id % 40 = 0"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "sum_of_squares_packing",
    ]

    def kept(name, frame):
        found = stages[name](spark, frame, sf_dir)
        assert found.columns == docs.columns
        return found.checkpoint()

    good = kept("quality_classifier", docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [r.doc_id for r in docs.collect() if labels.get(r.doc_id) == 1]
    assert len(set(clean) & {r.doc_id for r in good.collect()}) >= 0.97 * len(clean)

    once = kept("exact_dedup", repeated)
    best = {}
    for r in docs.collect():
        best[squeezed(r.text)] = min(best.get(squeezed(r.text), (0, 1)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for _, i in best.values())

    near = kept("simhash_near_dedup", once)
    rows = sorted((r.doc_id, r.text) for r in once.collect())
    tops = roots([slow_fingerprint(t) for _, t in rows], 4)
    assert sorted(r.doc_id for r in near.collect()) == sorted({rows[t][0] for t in tops})

    clear = kept("benchmark_decontamination", near)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {}
    expected = [r.doc_id for r in near.collect() if not hits(r.text, items, windows)]
    assert sorted(r.doc_id for r in clear.collect()) == sorted(expected)

    packed = stages["sum_of_squares_packing"](spark, clear, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(expected)


def hits(text, items, known):
    from tidyledger.llm.words import words

    if not known:
        for _, item in items:
            own = words(item.encode())
            known.update({tuple(own[i : i + 10]): 1 for i in range(max(1, len(own) - 9))})
    own = words(text.encode())
    return any(tuple(own[i : i + 10]) in known for i in range(len(own)))


def small(spark, folder, documents):
    """Driver tables with some documents of their own, and a column of the name the stages would choose."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _pipeline_row string, row_key int"
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in documents]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, "one two three four five six seven eight nine ten eleven")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(-5, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_documents(spark, tmp_path):
    quote = "He said one two three four five six seven eight nine ten and left"
    documents = [(1, None), (2, ""), (3, " \n"), (4, "a text of its own"), (4, "a text of its own"), (None, "no id here at all")]
    documents += [(5, quote), (6, "word " * 120_000), (7, "another text under one id"), (7, "and a second text under that id")]
    folder = small(spark, tmp_path, documents)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns, name
        assert {r._pipeline_row for r in docs.collect()} == {"clash"}
    kept = sorted((repr(r.doc_id), (r.text or "")[:20]) for r in docs.collect())
    wanted = [(1, ""), (3, ""), (4, "a text of its own"), (None, "no id here at all"), (6, "word " * 4)]
    wanted += [(7, "another text under o"), (7, "and a second text un")]
    # Of the texts without a word the longest stays.
    assert [k for k in kept if k[1].strip()] == sorted((repr(i), t) for i, t in wanted if t)
    assert [k for k in kept if not k[1].strip()] == [("3", " \n")]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} <= {3, 4, None, 6, 7} and all(r.length <= 1024 for r in packed)


def test_empty_table(spark, tmp_path):
    folder = small(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_results_of_stages_are_removed(spark, tmp_path):
    import pathlib

    folder = small(spark, tmp_path, [(i, f"text number {i} of them") for i in range(5)])
    shared = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    stored = lambda: {p.name for name, _ in corpus_pipeline.STAGES for p in shared.glob(f"{name}-*")}
    before = stored()
    assert corpus_pipeline.run(spark, folder).count() == 5
    assert [n.rsplit("-", 5)[0] for n in stored() - before] == [corpus_pipeline.STAGES[-2][0]]
