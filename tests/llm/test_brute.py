"""Operators held against plain versions of themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tessera.llm import brown_lm, edit_embed, gear, line_winnow, media_chunks, mixing, packing, secret_owners, simhash_bk, toxicity
from tessera.llm.queries import vocabulary


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def duck(rows, sql):
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    con = duckdb.connect()
    con.register("documents", documents)
    con.execute("CREATE TABLE d AS SELECT * FROM documents")
    con.unregister("documents")
    con.execute("ALTER TABLE d RENAME TO documents")
    return con.sql(sql).fetchall(), [c[0] for c in con.sql(sql).description]


# --- 1


def test_base_scores(docs, rows):
    got = by_id(brown_lm.score(docs))
    tokens = {r[0]: [*words_of(r[1]), ""] for r in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(w in c for w in t), n, i not in train)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def likelihood(bigrams, member, k):
    onto = np.eye(k)[member]
    t = onto.T @ bigrams @ onto
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_finds_planted_classes_and_no_single_move_is_better():
    rng = np.random.default_rng(5)
    planted = np.repeat([0, 1, 2], 8)
    rate = np.array([[1, 30, 1], [1, 1, 30], [30, 1, 1]])[planted][:, planted]
    bigrams = rng.poisson(rate).astype(float)
    member = brown_lm.exchange(bigrams, 3, 20)
    assert len({tuple(member[planted == c]) for c in range(3)}) == 3 and all(len(set(member[planted == c])) == 1 for c in range(3))
    best = likelihood(bigrams, member, 3)
    for u in range(24):
        for c in range(3):
            other = member.copy()
            other[u] = c
            assert likelihood(bigrams, other, 3) <= best + 1e-6


# --- 2


def fingerprint(text):
    w = words_of(text)
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def groups(values, radius):
    """Least id reachable from each, by all pairs."""
    up = {i: i for i in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(values)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(docs, rows):
    values = {r[0]: fingerprint(r[1]) for r in rows}
    want = groups(values, 4)
    got = {i: (r["fingerprint"], r["component_id"]) for i, r in by_id(simhash_bk.near_duplicates(docs)).items()}
    assert got == {i: (f"{v:016x}", want[i]) for i, v in values.items()}
    assert len(set(want.values())) < len(rows)


@pytest.mark.parametrize("shard_rows", [4, 64, 4096])
def test_links_of_crowded_values(spark, shard_rows):
    """Chains and crowds within the radius, in shards that must be cut."""
    rng = np.random.default_rng(2)
    values = {0}
    for _ in range(150):
        base = int(rng.choice([0, 0x0123456789ABCDEF, 0xFFFF0000FFFF0000]))
        for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            base ^= 1 << int(b)
        values.add(base)
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash_bk.links(frame, 4, shard_rows, 1 << (12 if shard_rows > 64 else 40)).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    up = {v: v for v in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        up[root(a)] = root(b)
    want = groups(dict(enumerate(values)), 4)
    assert len({(want[i], root(v)) for i, v in enumerate(values)}) == len(set(want.values())) == len({root(v) for v in values})


def test_bk_tree():
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 1 << 16, 300)]
    tree = simhash_bk.BKTree()
    for v in sorted(set(values)):
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.near(q, 3)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 3)


# --- 3


def test_mixing_is_its_sql(docs, rows):
    want, names = duck(rows, mixing.SQL)
    got = mixing.select_rows(docs).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def fill(children, budget):
    """(name, weight, capacity) -> budgets, by rounds of shares until none is over its capacity."""
    given, open_ = {}, list(children)
    while open_:
        total = sum(w for _, w, _ in open_)
        full = [c for c in open_ if c[2] * total <= (budget - sum(given.values())) * c[1]]
        if not full:
            left = budget - sum(given.values())
            return given | {n: w * left // total for n, w, _ in open_}
        least = min(full, key=lambda c: c[2] / c[1])
        given[least[0]] = least[2]
        open_.remove(least)
    return given


@pytest.mark.parametrize("budget", [0, 100, 900, 5000])
def test_quotas(spark, budget):
    leaves = [("web", "en", "a", 500), ("web", "en", "b", 20), ("web", "de", "a", 100), ("books", "en", "c", 30), ("code", "fr", "d", 0)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"web": 2, "books": 5}, "lang": {"en": 3}, "source": {}}
    got = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in mixing.quotas(frame, mixing.LEVELS, weights, budget, 1).collect()}

    def down(path, budget):
        depth = len(path)
        if depth == 3:
            return {path: budget}
        names = sorted({x[depth] for x in leaves if x[:depth] == path})
        children = [(n, weights[mixing.LEVELS[depth]].get(n, 1), sum(x[3] for x in leaves if x[: depth + 1] == (*path, n))) for n in names]
        out = {}
        for n, b in fill(children, budget).items():
            out |= down((*path, n), b)
        return out

    assert got == down((), budget)


# --- 4


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    got = packing.pack(docs, vocabulary(), most=512).toPandas()
    want = {}
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 512):
            want[(i, k // 512)] = (k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 512
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 512) + 1


def test_sums_of_squares_places_each_where_the_sum_is_least():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 33, 200)
    sequence, offset = packing.sum_of_squares(lengths, 32)
    fill = defaultdict(int)
    for at in np.argsort(-lengths, kind="stable"):
        size, gaps = int(lengths[at]), Counter(32 - v for v in fill.values() if v < 32)
        room = {g: sum(n * n for g2, n in (gaps - Counter([g]) + Counter([g - size] if g > size else [])).items()) for g in gaps if g >= size}
        if room:
            assert room[32 - fill[sequence[at]]] == min(room.values())
        else:
            assert sequence[at] not in fill
        assert offset[at] == fill[sequence[at]]
        fill[sequence[at]] += size


def test_encoder_is_the_tokenizer():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, t = random.Random(1), Tokenizer.from_file(vocabulary())
    alphabet = "abcXYZ019 .,;:!?'\"-_\n\téİǅ́　あ中\U0001f600ſK\x1c\x85<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["we'll. 's,", "<|endoftext|>", "a<|ENDOFTEXT|>B", ""]
    ids, offsets = packing.Encoder.at(vocabulary()).ids(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*t.encode(text, add_special_tokens=False).ids, 0], text


# --- 5


def test_edit_fingerprints(docs, rows):
    got = by_id(edit_embed.fingerprints(docs))
    texts = [r[1] or "" for r in rows]
    for k, (i, *_) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = edit_embed.embed([text, edited, after])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.hex(), b.hex())
        assert (r["near_edited"], r["near_next"]) == (edit_embed.likeness(a, b), edit_embed.likeness(a, c))
    long = [r for r in got.values() if r["n_chars"] > 200 and r["near_next"] < 1]
    assert all(r["near_edited"] > r["near_next"] for r in long)


def test_walk_is_the_plain_walk():
    text = "the quick brown fox, é中 jumps over " * 9
    dwell, i, emitted = edit_embed._dwell(), 0, []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    while i < len(points):
        for _ in range(dwell[int(edit_embed._classes(points[i : i + 1])[0]) * edit_embed.PERIOD + len(emitted) % edit_embed.PERIOD]):
            emitted.append(i)
        i += 1
    got = edit_embed.embed([text])[0]
    steps = edit_embed.steps_of(got[0])
    want = [int(edit_embed._sample_bytes(points[emitted[s] : emitted[s] + 1])[0]) if s < len(emitted) else 0 for s in steps]
    assert list(got[1 : 1 + edit_embed.SAMPLES]) == want


def test_parts_are_in_order(spark, rows, docs, monkeypatch):
    want = sorted(map(tuple, edit_embed.fingerprints(docs).collect()))
    monkeypatch.setattr(edit_embed, "PART_BYTES", 9000)
    assert sorted(map(tuple, edit_embed.fingerprints(docs).collect())) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_within_and_links(spark):
    import random

    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = "".join(rng.choice("abcdef ") for _ in range(150))
        texts.append(base)
        for _ in range(3):
            at = rng.randrange(len(base))
            base = base[:at] + rng.choice("xyz") + base[at + rng.randint(0, 1) :]
            texts.append(base)
    for a in texts[:10]:
        for b in texts[:10]:
            assert edit_embed.within(a, b, 3) == (distance(a, b) <= 3)
    assert edit_embed.within("", "ab", 2) and not edit_embed.within("", "abc", 2)
    frame = spark.createDataFrame([*enumerate(texts), (99, texts[0])], "doc_id long, text string")
    found = {tuple(sorted((r["a"], r["b"]))) for r in edit_embed.edit_links(frame, 3).collect()}
    all_texts = dict(enumerate(texts)) | {99: texts[0]}
    assert all(distance(all_texts[a], all_texts[b]) <= 3 for a, b in found) and (0, 99) in found
    up = {i: i for i in all_texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        up[root(a)] = root(b)
    pairs = [(a, b) for a in range(48) for b in range(a) if distance(texts[a], texts[b]) <= 3]
    assert sum(root(a) == root(b) for a, b in pairs) >= 0.9 * len(pairs)


# --- 6


def test_line_dedup_is_its_sql(docs, rows):
    from pyspark.sql import functions as F

    want, names = duck(rows, line_winnow.SQL)
    kept = line_winnow.deduplicated(docs).select("doc_id", F.col("_w_n_lines").alias("n_lines"), F.col("_w_n_deleted").alias("n_deleted"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))
    assert sorted(map(tuple, kept.select(*names).collect())) == sorted(want)
    assert sum(dict(zip(names, w, strict=True))["n_deleted"] for w in want) > 20


def test_a_shared_run_of_window_lines_goes_from_the_later_text(spark):
    run = "\n".join(f"a line of some length, number {i}, that both texts have in common" for i in range(3))
    frame = spark.createDataFrame([(1, f"first\n{run}\nend one"), (2, f"second\nother\n{run}\nend two")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_winnow.deduplicated(frame).collect()}
    assert got == {1: f"first\n{run}\nend one", 2: "second\nother\nend two"}


# --- 7


def test_cuts_move_with_the_text_and_do_not_see_the_text_before():
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 120, 4000).astype(np.uint8)
    shifted = np.concatenate((raw[:100], np.frombuffer(b"inserted", np.uint8), raw[100:]))
    cut = lambda x: {x[a:b].tobytes() for a, b in zip(*gear.chunks(x, np.array([0, len(x)]), 6)[1:], strict=True)}
    assert len(cut(raw) - cut(shifted)) <= 3
    doc, starts, ends = gear.chunks(np.concatenate((raw, raw)), np.array([0, 4000, 4000, 8000]), 6, most=90)
    first = [(a, b) for d, a, b in zip(doc, starts, ends, strict=True) if d == 0]
    assert first == [(a - 4000, b - 4000) for d, a, b in zip(doc, starts, ends, strict=True) if d == 2] and 1 not in doc
    assert (ends - starts).max() <= 90 and (starts[1:] == ends[:-1]).all() and ends[-1] == 8000


# --- 8


def test_secrets(docs, rows):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = by_id(secret_owners.scan(docs))
    for i, text, *_ in rows:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        base = [f"{secret_owners.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("owned")] == base
    assert got[20]["n_copied"] > 0 and "owned" not in got[20]["spans"] and "owned" in got[21]["spans"]


# --- 9


def test_toxicity_finds_insults_in_texts_it_has_not_seen(spark):
    import random

    from tests.llm.conftest import prose

    rng = random.Random(9)
    rows = []
    for i in range(400):
        text, toxic = prose(rng, rng.randint(5, 200)), int(i % 6 == 0)
        if toxic:
            at = rng.randrange(len(text))
            text = f"{text[:at]} {rng.choice(('blockhead', 'Nitwit', 'DIMWIT'))} {text[at:]}"
        rows.append((i, text, toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic").where(~toxicity.held_out())
    got = by_id(toxicity.score(frame.drop("toxic"), toxicity.train(frame, labels)))
    held = [(got[i]["score"] >= 0.5, bool(t)) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) >= 0.95 and all(0 <= r["score"] <= 1 for r in got.values())


def test_grams_stay_in_their_text():
    points = np.arange(10, 30, dtype=np.uint32)
    _, inside = toxicity.grams(points, np.array([0, 2, 2, 9, 20]), 3)
    assert np.flatnonzero(inside).tolist() == [2, 3, 4, 5, 6, *range(9, 18)]


# --- 10


def test_media_round_trip(docs, rows):
    got = by_id(media_chunks.media(docs))
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] > 0
    assert len({(r["media_sha256"], r["feature"]) for r in got.values()}) == len({(rows[i][1] or "").encode().ljust(192) for i in got})
    assert got[4]["media_sha256"] == got[5]["media_sha256"]
