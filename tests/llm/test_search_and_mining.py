"""Nearest-neighbour quality, hard negatives, collocations, near copies, sharding,
packing and page scanning against brute force."""

import random
import time
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sourcemine import storage
from sourcemine.llm import chat, collocations, hard_negatives, html_extract, near_copies, neighbours, packing, quality, sharding, tokens, topk
from sourcemine.llm.common import stored
from sourcemine.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


# quality by neighbours


def test_bags_of_long_texts_equal_those_of_their_parts(monkeypatch):
    rng = random.Random(1)
    words = ["the", "The", "ABC!!", "a|b", "x9", "é", "\n", "12", "w" * 90, "\t"]
    texts = [None, "", " \n ", *(" ".join(rng.choices(words, k=n)) for n in (1, 2, 30, 400))]
    whole = neighbours.bags(texts)
    monkeypatch.setattr(neighbours, "PART_BYTES", 64)
    for (rows, shares), (r, s) in zip(whole, neighbours.bags(texts)):
        assert rows.tolist() == r.tolist() and np.allclose(shares, s)
    assert [len(r) for r, _ in whole[:3]] == [0, 0, len(whole[2][0])] and len(whole) == len(texts)


def test_votes_equal_a_plain_count():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((60, 5)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[7] = vectors[3]  # a tie
    y = (rng.random(60) < 0.3).astype(float)
    space = neighbours.Space(None, np.eye(5), vectors, y, np.where(y > 0, 0.5, 0.1))
    asked = vectors[:20]
    for score, q in zip(space.vote(asked), asked):
        cosines = vectors @ q
        near = np.argsort(-cosines, kind="stable")[: neighbours.K]
        weight = np.maximum(cosines[near], 0) ** neighbours.SHARPNESS * space.votes[near]
        assert score == pytest.approx((weight * y[near]).sum() / weight.sum(), rel=1e-4)
    assert neighbours.Space(None, np.eye(5), vectors[:0], y[:0], y[:0]).vote(asked).tolist() == [1.0] * 20


def test_quality_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_quality_neighbours"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(r["quality"], got[r["doc_id"]]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert len(got) == 1000 and sum(1 for q, _ in held if q == 0) > 5
    assert all(r["predicted"] == q for q, r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_quality_without_labels_texts_or_ids(spark):
    rows = [(None, None, 9), (1, "", 9), (2, "some words", 9), (2, "some words", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(None, 0), (2, None)], "doc_id bigint, quality int")
    space = neighbours.fit(docs, labels)
    assert [tuple(r) for r in neighbours.scored(docs, space).select("score", "predicted").collect()] == [(1.0, 1)] * 4
    assert neighbours.scored(docs.limit(0), neighbours.fit(docs.limit(0), labels)).count() == 0


# hard negatives


def _plain_negatives(rows, anchors, positives, negatives, low, high):
    whole = []
    for n, (vec_id, x, label) in enumerate(rows):
        if label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            whole.append((n, vec_id, [int(np.floor(256 * float(np.float32(v)))) for v in x], label))
    out = []
    for n, vec_id, x, label in whole:
        if vec_id is None or not anchors(vec_id):
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), (i is None, i or 0), m, other) for m, i, y, other in whole if m != n]
        own = sorted(s for s in scored if s[3] == label)[:positives]
        for p in own:
            ps = -p[0]
            fit = sorted(s for s in scored if s[3] != label and low * ps <= -100 * s[0] <= high * ps)[:negatives]
            for rank, s in enumerate(fit, 1):
                out.append((vec_id, None if p[1][0] else p[1][1], rank, None if s[1][0] else s[1][1], ps, -s[0]))
    return sorted(out, key=str)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "FANOUT", 3)
    monkeypatch.setattr(hard_negatives, "TILE", 64)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.random(6) * rng.integers(1, 3)).tolist(), int(rng.integers(0, 4))) for i in range(300)]
    rows += [(i, [0.5] * 6, i % 3) for i in range(400, 440)]  # ties
    rows += [(7, [0.5] * 6, 1), (7, [0.5] * 6, 1), (None, [0.9] * 6, 2), (10, [0.4, 0.4], 0), (11, [], 0)]
    rows += [(500, None, 1), (501, [1.0] * 6, None), (502, [float("nan")] * 6, 1), (503, [None] * 6, 1), (504, [float("inf")] * 6, 0)]
    schema = "vec_id bigint, embedding array<float>, label int, row string, whole int, batch int"
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    got = hard_negatives.mined(df, "vec_id % 10 = 0").collect()
    want = _plain_negatives(rows, lambda i: i % 10 == 0, 5, 10, 30, 90)
    assert sorted(map(tuple, got), key=str) == want and len(want) > 500
    assert hard_negatives.mined(df.limit(0), "true").count() == 0


def test_hard_negatives_are_exact_beyond_doubles(spark):
    big = [(0, [1e6, 1.0], 0), (1, [1e6, 2.0], 0), (2, [8e5, 1.0], 1), (3, [8e5, 1.00390625], 1), (4, [9.9e5, 1.0], 1)]
    df = spark.createDataFrame(big, "vec_id bigint, embedding array<float>, label int")
    got = sorted(map(tuple, hard_negatives.mined(df, "vec_id = 0").collect()))
    assert got == _plain_negatives(big, lambda i: i == 0, 5, 10, 30, 90) and [r[3] for r in got] == [3, 2]


def test_top_k_is_exact_beyond_doubles_and_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "STORED", 16)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "HEAD", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(8)
    x = rng.integers(-40, 40, (200, 6)) / 4
    x[:6] = 1e6 + np.arange(36).reshape(6, 6) / 2  # products of about 2 ** 58
    x[20:24] = x[24:28]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(spark, df, "vec_id % 10 = 0 OR vec_id < 3").collect()))
    whole = [[int(256 * v) for v in row] for row in x.astype(np.float32).astype(float)]
    want = []
    for q in (i for i in range(200) if i % 10 == 0 or i < 3):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(200) if i != q)
        want += [(q, rank, i, -score) for rank, (score, i) in enumerate(scores[:5], 1)]
    assert got == sorted(want)


# collocations


@pytest.mark.parametrize("n", [2, 3, 4, 5])
@pytest.mark.parametrize("bits", [1, 7, 20, 32])
def test_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * bits)
    shape = collocations.Shape(n, bits)
    ids = [rng.integers(0, min(1 << bits, 1 << 32), 3000, dtype=np.uint64).astype(np.uint32) for _ in range(n)]
    assert all((a == b).all() for a, b in zip(shape.unpack(shape.pack(ids)), ids))
    counts = rng.integers(1, 400, 3000)
    whole = collocations.Filter.of(shape.pack(ids), counts)
    want = Counter()
    for key, k in zip(zip(*(x.tolist() for x in ids)), counts.tolist()):
        want[key] += k
    for split in (0, 1, min(5, shape.wide)):
        parts = list(whole.segments(shape, split))
        back = [collocations.Filter.from_bytes(f.to_bytes(shape, split), shape, split, s) for s, f in parts]
        merged = collocations.Filter.merged([*back, *back])
        keys = zip(*(x.tolist() for x in shape.unpack(merged.lanes)))
        assert dict(zip(keys, merged.counts.tolist())) == {k: 2 * v for k, v in want.items()}


def _plain_phrases(docs, least, top, share=100):
    import re

    f, n = Counter(), Counter()
    small = {c: c + 32 for c in range(65, 91)}
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(small)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    rows = defaultdict(list)
    for (lang, g), a in found.items():
        inside = [
            1 for (l2, h), b in found.items() if l2 == lang and len(h) > len(g) and 100 * b >= share * a
            and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        ]
        if inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        rows[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    out = []
    for lang, own in rows.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, top, share", [(3, 2000, 100), (2, 5, 60)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top, share):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 500)
    monkeypatch.setattr(collocations, "SEGMENT_ENTRIES", 64)
    rng = random.Random(4)
    words = ["the", "The", "of", "é", "New", "york", "x-y", "\x00", "a b", "c.", "d,e", "f\ng", "h\ti", "日本"]
    docs = [(" ".join(rng.choices(words, weights=range(1, 15), k=rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    docs += [(None, "en"), ("", None), (" . , ", "fr"), ("one two three four five six " * 200, "en")]
    df = spark.createDataFrame([(*d, i, 5) for i, d in enumerate(docs)], "text string, lang string, f int, gram int").repartition(5)
    got = sorted(map(tuple, collocations.mined(df, least=least, top=top, share=share).collect()))
    assert got == _plain_phrases(docs, least, top, share) and got


def test_no_phrases(spark):
    docs = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert collocations.mined(docs).count() == 0 and collocations.mined(docs.limit(0)).count() == 0


# near copies


def test_near_copies_are_found(spark):
    rng = random.Random(5)
    docs, want = [], []
    for base in range(60):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(40, 200))]
        group = [base * 10]
        docs.append((group[0], " ".join(words)))
        for k in range(1, 5):
            edited = list(words)
            for _ in range(max(1, len(words) // 60) if k < 4 else 0):
                edited[rng.randrange(len(edited))] = f"new{rng.random()}"
            docs.append((base * 10 + k, " ".join(edited).upper() if k == 4 else "  ".join(edited)))
        want.append(base * 10)
    docs += [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, "a c"), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id bigint, text string, m int").repartition(4)

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {d: shingles(t) for d, t in docs if d is not None}

    def alike(a, b):
        return 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])

    left = near_copies.one_of_each(df).collect()
    kept = {r["doc_id"] for r in left}
    assert df.columns == list(left[0].asDict()) and len(kept) == len(left) and None not in kept
    assert {9000, 9002, 9004} <= kept and not {9001, 9003} & kept
    near = [d for d, _ in docs if d is not None and d < 9000 and d % 10 and alike(d, d - d % 10)]
    assert sum(d not in kept for d in near) >= 0.9 * len(near) and len(near) > 100
    for d in sets.keys() - kept:  # nothing goes without a copy
        assert any(alike(d, e) for e in sets if e != d)
    assert near_copies.one_of_each(df.limit(0)).count() == 0


# sharding


@pytest.mark.parametrize("key, most_cut", [("id div 10", 20), ("0", 1), ("if(id < 330, 0, id div 3 + 1000)", 24)])
def test_shards_hold_even_counts_and_whole_groups(spark, key, most_cut):
    rows = stored(spark.range(1000).selectExpr("id as row", f"cast({key} as string) as key", "7 as shard", "'x' as goal"), "rows")
    placed = sharding.sharded(rows)
    assert sorted(placed.columns) == ["goal", "row", "shard", "slot"]
    got = placed.join(rows.select("row", "key"), "row").collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 1000 and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    held = defaultdict(Counter)
    for r in got:
        held[r["key"]][r["shard"]] += 1
    assert sum(len(v) > 1 for v in held.values()) <= most_cut
    for own in held.values():  # a large group fills as few shards as hold it, one more at most
        assert sum(own.values()) <= 62 or len(own) <= -(-sum(own.values()) // 62) + 1


def test_rounds_join_counts_and_not_the_table(spark):
    state = stored(spark.range(100).selectExpr("cast(id div 4 as string) as key", "cast(id % 4 as int) as shard", "1L as n"), "s")
    plan = sharding.asking(state, [25] * 4, 30, 0)
    assert all(f.split("/")[-2].startswith("s-") for f in plan.inputFiles())
    asks = np.zeros((4, 4, sharding.BUCKETS), np.int64)
    rng = np.random.default_rng(6)
    for s in range(4):
        for g in range(4):
            if s != g:
                asks[s, g] = rng.integers(0, 2, sharding.BUCKETS)
    loads = [300, 290, 310, 280]
    for most in (0, 290, 320, 10_000):
        taken = sharding.admitted(asks, loads, most)
        moved = asks * taken
        after = np.array(loads) + moved.sum(axis=(0, 2)) - moved.sum(axis=(1, 2))
        assert all(after[g] <= most for g in range(4) if taken[g].any())


# packing


def test_best_fit_by_counts_equals_one_by_one():
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.choice([10, 37, 64])
        left = {x: rng.randint(1, 30) for x in rng.sample(range(1, capacity), rng.randint(1, 9))}
        rooms, n = [], 0
        for x in sorted(left, reverse=True):
            for _ in range(left[x]):
                at = bisect_left(rooms, x)
                room = rooms.pop(at) if at < len(rooms) else capacity
                n += room == capacity
                if room > x:
                    insort(rooms, room - x)
        found, got = packing.best_fit(left, capacity), Counter()
        for configuration, times in found.items():
            assert sum(x * k for x, k in configuration) <= capacity
            for x, k in configuration:
                got[x] += k * times
        assert got == Counter(left) and sum(found.values()) == n


@pytest.mark.parametrize("histogram, want", [({1500: 10**7}, 10**7), ({1500: 10**7, 500: 10**7}, 10**7), ({2048: 3, 1: 2}, 4), ({}, 0)])
def test_plans_of_few_lengths_are_small_and_tight(histogram, want):
    start = time.monotonic()
    plan = packing.solve(histogram)
    assert plan.n_sequences == want == plan.at_least and len(plan.length) < 100
    assert time.monotonic() - start < 60
    for x, n in histogram.items():
        for slot in (0, n - 1):
            sequence, offset = plan.place(np.array([x]), np.array([slot]))
            assert 0 <= sequence[0] < want and offset[0] + x <= 2048


# pages


@pytest.mark.parametrize("piece", ["<a '", "<div>", "<div>word ", "<head>", "<", '<p a="', "<!-- ", "<iframe>", "<button><p>", "</b>"])
def test_broken_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.monotonic()
    html_extract.main_text(page)
    assert time.monotonic() - start < 15  # a second or two; the old way took hours


def test_a_comment_without_an_end_does_not_take_the_page():
    body = "A long line of plain words that goes on and on to the very end of it, as text does."
    assert html_extract.main_text(f"<article><!-- note ><p>{body}</article>") == body


def test_siblings_share_a_container():
    found = html_extract.blocks("<div><p>one</p><p>two</p><ul><li>a<li><b>b</b></ul>three</div><div>four</div>")
    where = {b.text: b.parent for b in found}
    assert where["one"] == where["two"] == where["three"] and where["a"] == where["b"] != where["one"] != where["four"]


# chats, ledger, pipeline


def test_rows_of_one_turn_come_by_role_and_text(spark):
    texts = ["Z", "<a", "\\", "<says>", "Z!", ""]
    turns = spark.createDataFrame([(1, 0, "user", t) for t in texts] + [(1, 0, "a!", "x"), (1, 0, "a", "y")], "conv_id bigint, turn bigint, role string, text string")
    rows = chat.in_order(chat.formatted(turns)).select("formatted").collect()
    escaped = [("a", "y"), ("a!", "x")] + [("user", t) for t in sorted(texts)]
    want = [f"<turn>{r}<says>{t.replace(chr(92), chr(92) * 2).replace('<', chr(92) + '<')}</turn>\n" for r, t in escaped]
    assert [r["formatted"] for r in rows] == want


def test_ablations_of_the_stored_ledger(spark):
    rows = quality.stored_ledger(table(spark, SF, "documents"), ["doc_id"])
    assert "text" not in rows.columns
    bits = [r["fail_bits"] for r in rows.collect()]
    for r in quality.ablations(rows).collect():
        mask, bit = quality.POLICIES[r["version"]], quality.BIT[r["rule"]]
        assert r["n_failed"] == sum(b & bit > 0 for b in bits)
        assert r["n_only"] == sum(b & mask == bit for b in bits)
        assert (r["n_kept"], r["n_kept_without"]) == (sum(b & mask == 0 for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def test_stages_leave_values_as_they_came(spark):
    docs = table(spark, SF, "documents").limit(120).selectExpr("*", "99.0D as score", "77 as n_words", "5 as predicted", "'r' as row")
    docs = stored(docs, "docs")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert rows and all(before[r["doc_id"]] == r for r in rows), name
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    members = Counter(m["doc_id"] for r in packed for m in r["members"] if m["piece"] == 0)
    assert members == Counter(before.keys()) and all(4 <= len(r["ids"]) <= 4 * 2048 for r in packed)


def test_packing_keeps_ids_narrow_on_disk(spark):
    """Stored pieces take at most two bytes an id; sequences hold the ids of the library."""
    rng = np.random.default_rng(8)
    words = ["".join(chr(c) for c in rng.integers(97, 123, 6)) for _ in range(5000)]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 3000, 200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(200, None)], "doc_id bigint, text string")
    got = packing.sequences_of(df).collect()
    ids = {(m["doc_id"], m["piece"]): bytes(r["ids"])[4 * m["offset"] :] for r in got for m in r["members"]}
    encoder = tokens.Encoder(tokens.BYTE)
    n = 0
    for i, text in [*enumerate(texts), (200, None)]:
        want, at = encoder.library(text or "") + bytes(4), 0
        n += len(want) // 4
        for k, length in enumerate(packing.cut(len(want) // 4)):
            assert ids[i, k][: 4 * length] == want[4 * at : 4 * (at + length)]
            at += length
    assert sum(len(r["ids"]) for r in got) == 4 * n
    path = next(p for p in reversed(storage._made[spark.sparkContext.applicationId]) if "/whole-pieces-" in p)
    assert sum(f.stat().st_size for f in Path(path).glob("*.parquet")) < 2.2 * n


def test_ids_beyond_16_bits_stay_whole(spark):
    numbers = [[1, 70_000, 3], [65_535, 0]]
    parts = [np.array(x, "<u4").tobytes() for x in numbers]
    narrow = [packing.narrowed(x) for x in parts]
    assert narrow[0] == parts[0] and len(narrow[1]) == 4
    rows = [(0, offset, k, 0, len(x), ids) for k, (offset, x, ids) in enumerate(zip((0, 3), numbers, narrow))]
    kinds = "sequence_id bigint, offset bigint, doc_id bigint, piece int, length bigint, ids binary"
    assert bytes(packing.sequences(spark.createDataFrame(rows, kinds)).first()["ids"]) == b"".join(parts)


def test_near_copies_leave_no_working_tables(spark):
    rows = [(i, " ".join(f"w{(i // 2) * 40 + k}" for k in range(30)) + " x" * (i % 2)) for i in range(40)]
    before = len(storage._made.get(spark.sparkContext.applicationId, []))
    df = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    labels = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in storage._made[spark.sparkContext.applicationId][before:]]
    assert sorted(labels) == ["marked", "stay"]
    assert sorted(r["doc_id"] for r in df.collect()) == list(range(0, 40, 2))


def test_a_group_of_near_copies_gives_no_square_of_pairs(spark, monkeypatch):
    """Texts that come first are like none or few of the group; all groups as by brute force."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(340):
        words = list(base)
        for _ in range(rng.randint(4, 8) if k < 40 else rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"n{k % 97}x{rng.randint(0, 30)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randint(0, 900)}" for _ in range(60)) for _ in range(60)] + [None, "", "w1 w2"]
    made = Counter()

    def counted(df, label, codec=None):
        table = stored(df, label, codec)
        made[label] += table.count()
        return table

    monkeypatch.setattr(near_copies, "stored", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    kept = sorted(r["doc_id"] for r in near_copies.one_of_each(df).collect())
    assert made["pairs"] <= 8 * len(texts) and made["links"] <= 8 * len(texts)
    known = near_copies.Words()
    sets = [set(near_copies.shingles(t, known).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert kept == sorted(set(root)) and 60 < len(kept) < 140


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_rows_are_found_by_their_number(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "MOST_WORDS", most)
    rows = spark.range(0, 5000).selectExpr("id + ((id % 3) << 33) as row", "id")
    asked = rows.where("id % 7 = 0 or id < 70").withColumnRenamed("row", "class").union(rows.where("id = 7"))
    words = stored(near_copies._words(asked, "class"), "words")
    got = near_copies._asked(rows, "row", words)
    assert got.columns == ["row", "id"]
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(5000) if i % 7 == 0 or i < 70]


def test_words_of_chunks_come_back_as_lists(spark):
    """One row a chunk and bucket, however many words a chunk has; numbers without a gap."""
    rows = [(f"w{i} w{i + 1} a. rare{i}x{k}", ("en", None, "de")[k % 3]) for k in range(30) for i in range(200)]
    chunks = collocations.chunks_of(spark.createDataFrame(rows, "text string, lang string").repartition(8))
    words, places = collocations.frequent_words(chunks, 10)
    got = words.collect()
    assert sorted(r["id"] for r in got) == list(range(1, len(got) + 1))
    want = Counter((lang or "und", w) for text, lang in rows for w in text.replace(".", "").split())
    assert {(r["lang"], bytes(r["word"]).decode()): r["f"] for r in got} == {k: n for k, n in want.items() if n >= 10}
    word = {r["id"]: (r["lang"], bytes(r["word"])) for r in got}
    of = {r["chunk"]: (r["lang"], r["words"]) for r in chunks.collect()}
    met = places.collect()
    for r in met:
        lang, own = of[r["chunk"]]
        assert [word[i] for i in r["ids"]] == [(lang, own[k - 1]) for k in r["locals"]]
    n = sum(len(r["ids"]) for r in met)
    assert n == sum((lang, w) in set(word.values()) for lang, own in of.values() for w in own)
    assert len(met) <= collocations.LEAST_BUCKETS * len(of) and n > len(met)
