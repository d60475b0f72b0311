"""The stages one after the other, each held against a plain version on its own input."""

import random

import pytest

import corpus_pipeline as P
from tests.llm.conftest import prose
from tests.llm.test_brute import duck
from tests.llm.test_simhash_similar import least_of_groups


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    rng, out = random.Random(11), tmp_path_factory.mktemp("sf")
    more = [(100 + i, f"{prose(rng, 60)} {'blockhead' if i % 3 == 0 else ''} {prose(rng, 40)}", "en", f"src{i % 4}", 1) for i in range(150)]
    spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


@pytest.fixture(scope="module")
def kept(spark, folder):
    """What each stage returns, from the documents on."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in P.STAGES:
        schema = docs.schema
        docs = stage(spark, docs, folder).cache()
        assert stage is P.STAGES[-1][1] or docs.schema.simpleString() == schema.simpleString()
        out.append(docs.collect())
    return out


def test_toxic_documents_go(kept):
    gone = {r["doc_id"] for r in kept[0]} - {r["doc_id"] for r in kept[1]}
    toxic = {r["doc_id"] for r in kept[0] if "blockhead" in (r["text"] or "")}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 0.03 * len(kept[0])


def test_lines(kept):
    from tessera.llm import line_winnow

    want, names = duck([tuple(r) for r in kept[1]], line_winnow.SQL)
    want = {w[names.index("doc_id")]: (w[names.index("n_lines")] - w[names.index("n_deleted")], w[names.index("kept_md5")]) for w in want}
    import hashlib

    for r in kept[2]:
        assert hashlib.md5((r["text"] or "").encode()).hexdigest() == want[r["doc_id"]][1]
    assert {r["doc_id"] for r in kept[1]} - {r["doc_id"] for r in kept[2]} <= {i for i, (n, _) in want.items() if n <= 1}


def test_one_document_of_each_group_stays(kept):
    want = least_of_groups([(r["doc_id"], r["text"]) for r in kept[2]])
    assert {r["doc_id"] for r in kept[3]} == set(want.values())


def test_mixing(kept):
    from tessera.llm import mixing

    sql = mixing.SQL.replace("* 0.5)", f"* {P.MIX_SHARE})").replace("sum(tokens) * 2", "sum(tokens) * 1").replace("tokens * 2 AS cap", "tokens * 1 AS cap")
    want, names = duck([tuple(r) for r in kept[3]], sql)
    assert {r["doc_id"] for r in kept[4]} == {w[names.index("doc_id")] for w in want}


def test_packing_and_run(spark, folder, kept):
    packed = kept[5]
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept[4]}
    strip = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert strip(P.run(spark, folder).collect()) == strip(packed)


def test_no_rows_and_odd_rows(spark, folder, odd, nothing):
    for docs in (nothing, odd):
        columns = docs.columns
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, folder).cache()
            assert docs.columns == columns
        assert P.STAGES[-1][1](spark, docs, folder).count() >= docs.count()
