import numpy as np

import corpus_pipeline
from matricula.llm import decontaminate, langid
from matricula.llm.common import materialize
from tests.conftest import SF
from tests.llm import test_decontaminate, test_linededup, test_packing, test_simhash


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(path := f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(path)
        found = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if name == "language_id":
            net = langid.train(spark.createDataFrame(list(rows.values())).filter("crc32(cast(doc_id as string)) % 3 <> 1").select("text", "lang"))
            x, owner, sizes = langid.windows([r.text.encode() for r in rows.values()])
            z = net.scores(x)
            kept = set()
            for i, r in enumerate(rows.values()):
                mean = np.average(z[owner == i], axis=0, weights=sizes[owner == i])
                p = np.exp(mean - mean.max())
                if any(c.isalpha() for c in r.text) and p.max() / p.sum() >= 0.25:
                    kept.add(r.doc_id)
            assert {r.doc_id for r in found} == kept and len(kept) > 0.9 * len(rows)
        elif name == "line_dedup":
            gone = test_linededup.brute([(d, r.text) for d, r in rows.items()])
            want = {d: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in set(gone.get(d, ()))) for d, r in rows.items()}
            full = lambda t: [x for x in t.split("\n") if x.strip()]  # noqa: E731  blank lines between gone ones may go with them
            assert {r.doc_id: full(r.text) for r in found} == {d: full(t) for d, t in want.items() if d not in gone or t.strip()}
            assert all(r.n_chars == len(r.text) for r in found)
        elif name == "simhash_near_dedup":
            ids = sorted(rows)
            roots = test_simhash.brute_components([test_simhash.brute_print(rows[d].text) for d in ids])
            assert {r.doc_id for r in found} == {ids[r] for r in roots}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            dirty = {d for d, _ in test_decontaminate.brute([(d, r.text) for d, r in rows.items()], items)}
            assert {r.doc_id for r in found} == set(rows) - dirty and dirty
        else:
            test_packing.verify(found, [(d, r.text) for d, r in rows.items()])
        if k < 4:
            rows = {r.doc_id: r for r in found}


def test_run_packs_what_the_stages_keep(spark):
    """`run` on the smallest tables: its pieces are those of the texts that the four stages keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    test_packing.verify(corpus_pipeline.run(spark, SF).collect(), kept)
    assert 0 < len(kept) < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs, tmp_path):
    clashing = odd_docs.withColumns({c: odd_docs["source"] for c in ("__id", "__gone", "__language", "__probability", "score", "fp", "row", "item")})
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    mixed = base.unionByName(clashing, allowMissingColumns=True)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    bench.limit(0).write.parquet(f"file://{tmp_path}/none/benchmark.parquet")
    for folder in (f"file://{tmp_path}", f"file://{tmp_path}/none"):
        for docs in (mixed, no_docs):
            for _, stage in corpus_pipeline.STAGES[:-1]:
                columns = docs.columns
                docs = materialize(stage(spark, docs, folder))
                assert docs.columns == columns
            rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
            assert (len(rows) > 0) == (len(docs.columns) > 5)


def test_stages_hand_texts_over_in_small_batches(spark, no_docs):
    """What a Python worker gets at once is bounded in rows: mapInArrow does not heed the limit in bytes."""
    import pyarrow as pa

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches)
    before = spark.conf.get(rows)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(rows, 10_000)
            stage(spark, no_docs, SF)
            found = [r.n for r in spark.range(0, 2000, 1, 1).mapInArrow(sizes, "n long").collect()]
            assert sum(found) == 2000 and max(found) <= 500
    finally:
        spark.conf.set(rows, before)
