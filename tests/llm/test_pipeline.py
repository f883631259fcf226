"""The pipeline's stages over a small table, each against what its operator must have done."""

import corpus_pipeline
from documents import awkward
from test_line_dedup import brute as dropped_lines
from test_simhash import brute, brute_groups
from test_tokens import check_pieces

from leafmill.llm import decontamination
from leafmill.llm.common import written

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, stages = docs, dict(corpus_pipeline.STAGES)

    after = written(stages["language_id"](spark, before, SMALL), "t")
    assert after.columns == columns
    assert ids(after) == ids(before.where(r"text rlike '\\p{L}'"))

    before = after
    after = written(stages["line_dedup"](spark, before, SMALL), "t")
    assert after.columns == columns
    want = {}
    drops = dropped_lines(before.collect())
    for r in before.collect():
        lines, gone = r.text.split("\n"), drops.get((r.doc_id, r.text), [])
        if len(gone) < sum(bool(x.strip()) for x in lines):
            want[r.doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert {r.doc_id: r.text for r in after.collect()} == want

    before = after
    after = written(stages["simhash_near_dedup"](spark, before, SMALL), "t")
    assert after.columns == columns
    groups = brute_groups({(r.doc_id, brute(r.text)) for r in before.collect()})
    assert ids(after) == sorted({c for c in groups.values()})

    before = after
    after = written(stages["decontamination"](spark, before, SMALL), "t")
    assert after.columns == columns
    found = decontamination.contamination(before, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert ids(after) == ids(found.where("n_hit = 0"))

    check_pieces(after, stages["packing"](spark, after, SMALL).collect(), 0)


def test_awkward_rows_pass(spark, tmp_path):
    folder = str(tmp_path)
    awkward(spark).drop("part", "key", "node").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} <= {None, 4, 6, 7, 9, 10}
