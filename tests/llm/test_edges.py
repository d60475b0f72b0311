"""Every operator on null, empty, repeated and clashing input, and on none."""

import pytest

from tessera.llm import brown_lm, chunk_dedup, edit_embed, line_winnow, media_chunks, mixing, packing, secret_owners, simhash_bk, toxicity
from tessera.llm.queries import vocabulary

PER_ROW = {
    "brown": brown_lm.score,
    "simhash": simhash_bk.near_duplicates,
    "edit": edit_embed.fingerprints,
    "lines": line_winnow.deduplicated,
    "secrets": secret_owners.scan,
    "media": media_chunks.media,
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d, d.sparkSession.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int"))),
}
OTHERS = {"pack": lambda d: packing.pack(d, vocabulary()), "mix": mixing.select_rows, "chunks": chunk_dedup.repeats}


@pytest.mark.parametrize("name", [*PER_ROW, *OTHERS])
def test_odd_rows(name, odd, rows):
    got = (PER_ROW | OTHERS)[name](odd).toPandas()
    if name in PER_ROW:
        want = sorted([r[0] for r in rows] + [4, 4])
        assert sorted(got["doc_id"].dropna().astype(int)) == want and got["doc_id"].isna().sum() == 1
        same = got[got["doc_id"] == 4].drop(columns=[c for c in ("near_next", "edited_sha256", "edited_fingerprint", "near_edited") if c in got])
        assert len(same.astype(str).drop_duplicates()) == 1
    elif name == "pack":
        assert got.groupby("doc_id", dropna=False)["start"].apply(lambda s: (s == 0).sum()).sum() == len(rows) + 3


@pytest.mark.parametrize("name", [*PER_ROW, *OTHERS])
def test_no_rows(name, nothing):
    assert (PER_ROW | OTHERS)[name](nothing).count() == 0
