import corpus_pipeline
import pytest
from billspark.llm import packing
from billspark.llm.queries import vocabulary
from tests.llm.test_corpus_search import classes_by_force, hits
from tests.llm.test_lines_quality_licenses import kept_lines
from tests.llm.test_text_models import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, repeated lines, near copies and a benchmark passage."""
    where = tmp_path_factory.mktemp("sf")
    docs, labels = labelled(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    line = "a boilerplate line that is found in many documents"
    rows = [(i, f"{line}\n{t}" if i % 3 == 0 else t) for i, t in rows]
    unique = [" ".join(f"u{k}w{j}" for j in range(60)) for k in range(30)]
    passage = " ".join(f"bench{j}" for j in range(30))
    rows += [(1000 + k, t) for k, t in enumerate(unique)]
    rows += [(2000 + k, t.replace("w7", "edit", 1)) for k, t in enumerate(unique[:10])]
    rows += [(3000, f"before {passage} after"), (3001, None), (None, "no id"), (3002, "")]
    spark.createDataFrame(
        [(i, t, "en", "src0", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(f"{where}/documents.parquet")
    labels.write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows, passage


def test_pipeline_matches_brute_force(spark, folder):
    where, rows, passage = folder
    toxic = {i for i, _ in rows if i is not None and i < 600 and i % 4 == 0}
    rest = [(i, t) for i, t in rows if i not in toxic]
    rest = [(i, t) for i, t, _, _ in kept_lines(rest)]
    smallest = -(2**63)
    firsts = {c for _, c in classes_by_force(rest)}
    rest = [(i, t) for i, t in rest if (smallest if i is None else i) in firsts]
    bad = {i for i, n, hit, _ in hits(rest, [(1, passage)]) if hit and 20 * hit >= n}
    assert bad == {3000}
    rest = {i: t for i, t in rest if i not in bad}
    got = corpus_pipeline.run(spark, where).collect()
    encode = packing.encoder(vocabulary(), 1)
    assert {r["doc_id"] for r in got} == set(rest)
    for i, t in rest.items():
        assert sum(r["length"] for r in got if r["doc_id"] == i) == len(encode(t)) // 4


def test_stages_on_odd_and_empty_tables(spark, folder, odd):
    where = folder[0]
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, table, where)
            if name != "packing":
                assert found.columns == table.columns
                assert {r["score"] for r in found.select("score").distinct().collect()} <= {"clash"}
            assert (found.count() > 0) == (table.count() > 0)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_duplicates", "decontamination", "packing",
    ]
