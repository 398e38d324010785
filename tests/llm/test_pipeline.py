"""The pipeline against plain Python, stage by stage, on the smallest tables."""

import corpus_pipeline as CP
import plain
import pytest
from gatekit.llm import toxicity
from gatekit.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = table(spark, SF, "documents")
    out = {}
    for name, stage in CP.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, done)
        docs = done
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert [n for n, _ in CP.STAGES] == ["toxicity", "line dedup", "near-dedup", "benchmark decontamination", "source mixing"]
    assert all(done.columns == columns for _, done in list(stages.values())[:-1])


def test_toxic_documents_go(spark, stages):
    docs, kept = stages["toxicity"]
    scored = toxicity.toxicity_scores(docs, table(spark, SF, "labels"))
    assert set(rows(kept)) == {r.doc_id for r in scored.where("score < 0.5").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    assert all(labels.get(d, 0) == 0 or plain.fold(d) == 0 or scored.where(F.col("doc_id") == d).first().score < 0.5 for d in rows(kept))
    assert not {d for d, x in labels.items() if x == 0} - set(rows(kept))


def test_lines_near_copies_and_leaks_go(spark, stages):
    docs, done = stages["line dedup"]
    given = [(r.doc_id, r.text) for r in docs.collect()]
    got = rows(done)
    assert [got[d].text for d, _ in given] == plain.dedup_lines(given)
    assert all(r.n_chars == len(r.text) for r in got.values())
    docs, done = stages["near-dedup"]
    named = plain.near_components([(r.doc_id, r.text) for r in docs.collect()])
    assert set(rows(done)) == {d for d, c in named.items() if d == c}
    docs, done = stages["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, _ in plain.leaks([(r.doc_id, r.text) for r in docs.collect()], items)}
    assert bad and set(rows(done)) == set(rows(docs)) - bad


def test_mix_covers_what_is_left(spark, stages):
    docs, done = stages["source mixing"]
    sizes = plain.defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(plain.words(r.text))
    want, got = plain.targets(sizes), rows(done)
    assert set(got) == set(rows(docs))
    for r in docs.collect():
        assert got[r.doc_id].source_size == sizes[r.source] and got[r.doc_id].target == pytest.approx(want[r.source])
        assert 0 <= got[r.doc_id].taken <= 3 * got[r.doc_id].size


def test_run_applies_all_stages(spark, stages):
    assert sorted(map(tuple, CP.run(spark, SF).collect())) == sorted(map(tuple, stages["source mixing"][1].collect()))


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows and an empty table pass through every stage."""
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (1, "", "en", "s", 0), (2, "x y z", None, None, 5), (2, "x y z", None, None, 5), (3, "x y z", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for docs, want in ((odd, [6, 6, 5, 5, 5]), (odd.limit(0), [0] * 5)):
        counts = []
        for _, stage in CP.STAGES:
            docs = stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            counts.append(docs.count())
        assert counts == want
