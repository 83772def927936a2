"""Every stage of the corpus pipeline against brute force on its own input."""

import corpus_pipeline as pipe
from tests.llm.conftest import SF
from tests.llm.test_models import check_mix
from tests.llm.test_native import brute_hits, brute_lines
from tests.llm.test_pipeline_rules import brute_kept
from tidemark.llm import toxicity as tox
from tidemark.sources.tables import stored


def test_stages_against_brute_force(spark, small):
    stage = dict(pipe.STAGES)
    assert list(stage) == ["toxicity", "line dedup", "near-duplicates", "decontamination", "mixing"]

    def go(name, docs):
        out = stored(stage[name](spark, docs, SF), "stage")
        if name != "mixing":
            assert tuple(out.columns) == pipe.COLUMNS
        return out

    clean = go("toxicity", small)
    model = tox.fit(small, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in tox.toxicity(small, model).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}
    assert 0 < len(scores) - clean.count() < len(scores) / 3

    lines = go("line dedup", clean)
    before = sorted(clean.collect(), key=lambda r: r["doc_id"])
    want = dict(zip([r["doc_id"] for r in before], brute_lines([r["text"] for r in before], 10, keep_first=True)))
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] != {b["doc_id"]: b["text"] for b in before}[r["doc_id"]])

    alone = go("near-duplicates", lines)
    assert {r["doc_id"] for r in alone.collect()} == brute_kept([(r["doc_id"], r["text"]) for r in lines.collect()])[0]

    fair = go("decontamination", alone)
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = alone.collect()
    assert {r["doc_id"] for r in fair.collect()} == {r["doc_id"] for r in rows if brute_hits(r["text"], items)[1] == 0}
    assert fair.count() < alone.count()

    mixed = go("mixing", fair).collect()
    check_mix(mixed, 0.25)  # sources of ten documents
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, pipe.run(spark, SF).collect()))


def test_stages_with_odd_rows(spark, odd, none):
    for docs in (odd, none):
        kept = docs
        for name, stage in pipe.STAGES:
            kept = stored(stage(spark, kept, SF), "stage")
        ids = [r["doc_id"] for r in kept.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {1, 2, 3, 4, 5, 6, 7, 8, None}
