from __future__ import annotations

import os
import random

import corpus_pipeline
from hiregrid.llm.decontaminate import contamination
from hiregrid.llm.quality import quality_signals

from .test_lines import brute as lines_brute
from .test_near import roots as near_roots
from .test_packing import check as check_packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(tmp_path, spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(10, 30))) for _ in range(5)) for _ in range(40)]
    item = " ".join(word() for _ in range(18))
    texts += [texts[0]] * 12 + [texts[1] + " end", "bad " * 90, "short", "\n".join([texts[2], item, texts[3]])]
    texts[20:29] = [t + "\nAll rights are reserved here." for t in texts[20:29]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_each_stage_against_its_own_input(spark, tmp_path):
    rows = make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        before, after = [tuple(r) for r in docs.collect()], out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
            got = sorted(map(tuple, after))
        if k == 0:
            kept = {r.doc_id for r in quality_signals(docs).where("kept").collect()}
            assert got == sorted(r for r in before if r[0] in kept) and 0 < len(got) < len(rows)
        elif k == 1:
            want = lines_brute([(r[0], r[1]) for r in before])
            assert sorted((r[0], r[1]) for r in got) == sorted(want) and all(r[4] == len(r[1]) for r in got)
            assert not any("reserved" in r[1] for r in got)
        elif k == 2:
            root = near_roots({r[1] for r in before})
            first = {}
            for r in before:
                first[root[r[1]]] = min(first.get(root[r[1]], r[0]), r[0])
            assert got == sorted(r for r in before if r[0] in first.values()) and len(got) < len(before)
        elif k == 3:
            bad = {r.doc_id for r in contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("contaminated").collect()}
            assert bad and got == sorted(r for r in before if r[0] not in bad)
        else:
            check_packing(after, before)
        docs = out if k == len(corpus_pipeline.STAGES) - 1 else spark.createDataFrame(got, docs.schema)
    assert sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.ids_crc32) for r in after)


def test_awkward_rows_and_columns_in_every_stage(spark, clashing, empty, rows, tmp_path):
    spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, str(tmp_path))
        none = stage(spark, empty, str(tmp_path))
        assert none.count() == 0
        if name == "best-fit packing":
            assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
        else:
            assert out.schema.names == clashing.schema.names and none.schema.names == empty.schema.names
            assert 0 < out.count() <= len(rows)
    # A table whose columns are null throughout.
    nulls = empty.sparkSession.createDataFrame([(None, None, None, None, None)] * 3, empty.schema)
    counts = [stage(spark, nulls, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES]
    assert counts == [0, 3, 1, 3, 3]


def test_run_leaves_only_the_last_stage(spark, tmp_path):
    make(tmp_path, spark)
    from hiregrid.llm.common import shared_folder

    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    corpus_pipeline.run(spark, str(tmp_path)).count()
    left = set(os.listdir(shared_folder(spark).removeprefix("file:"))) - before
    assert [x for x in sorted(left) if x.endswith(".parquet")] == [x for x in left if x.startswith("benchmark-decontamination")]
