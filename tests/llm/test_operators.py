"""Operators against brute force on small fixtures: nulls, empty and long texts,
ties, repeated rows, empty tables, columns of clashing names."""

import hashlib
import io
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sourcemine.llm import chat, html_extract, mixing, packing, quality, sharding, simhash, token_files, tokens, topk, toxicity
from sourcemine.llm.queries import QUERIES
from sourcemine.storage import new_scratch_path

LONG = "word and more, " * 4000
TEXTS = [None, "", " \n\t", "one", "a b c", LONG, "Æ ß 日本 <|endoftext|>", "same text here", "same text here", "x  y\n\nz"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, f"s{i % 3}" if i else None, 5, 7) for i, t in enumerate(TEXTS)]
    rows += rows[7:8] * 2  # repeated rows
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score int, n_words int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", [tokens.WORD, tokens.BYTE])
def test_cached_encoding_equals_the_library(name):
    encoder, rng = tokens.Encoder(name), np.random.default_rng(1)
    some = ["".join(rng.choice(list("ab É,.'\n\ts1 <|"), 12)) for _ in range(3000)]
    plain = tokens.Encoder(name).tokenizer.from_file(tokens.vocabulary_path(name))  # untouched
    some += ["a <|startoftext|> b", "x<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|><|endoftext|>y"]
    for text in [t for t in TEXTS if t] + some:
        ids = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == ids, text


def test_token_files(spark, docs, none):
    encoder = tokens.Encoder(tokens.WORD)
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r["start"])
    want = {i: encoder.library(t or "") + b"\2\0\0\0" for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]}
    start, last = 0, -1
    for r in got:
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r["n_tokens"]
        key = -1 if r["doc_id"] is None else r["doc_id"]
        assert key >= last
        last = key
    assert len(got) == docs.count() and token_files.round_trip(none).count() == 0


def test_token_file_reads_and_checks_single_documents():
    out = io.BytesIO()
    data = [(5, b"\1\0\0\0" * 9), (None, b""), (7, b"\2\0\0\0" * (token_files.FRAME_BYTES // 4 + 3))]
    assert token_files.write_file(out, data) == (3, sum(len(x) for _, x in data) // 4)
    read = token_files.TokenFile(out, len(out.getvalue()))
    assert [(i, read.document(k)) for k, i in enumerate(read.doc_ids)] == data
    spoilt = bytearray(out.getvalue())
    spoilt[int(read.packed[0]) - 5] ^= 1
    bad = token_files.TokenFile(io.BytesIO(bytes(spoilt)), len(spoilt))
    with pytest.raises(Exception):
        bad.document(0)
    assert bad.document(2) == data[2][1]


def _even(counts):
    return max(counts) - min(counts) <= 1


def test_shards(spark):
    # One key holds a third of all rows; many pairs; null keys.
    keys = ["hot"] * 400 + [f"k{i // 2}" for i in range(400)] + [None] * 400
    rows = spark.createDataFrame(list(enumerate(keys)), "row bigint, key string")
    got = sharding.sharded(rows).collect()
    key_of = dict(enumerate(keys))
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 1200 and _even([counts[s] for s in range(16)])
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    shards_of: dict = {}
    for r in got:
        shards_of.setdefault(key_of[r["row"]], set()).add(r["shard"])
    pairs = [len(v) for k, v in shards_of.items() if k and k != "hot"]
    assert sum(n == 1 for n in pairs) > 0.9 * len(pairs)
    assert sharding.sharded(rows.limit(0)).count() == 0


def test_shards_keep_groups_whole_when_most_rows_are_copies(spark):
    from sourcemine.llm.common import stored

    size = F.when(F.col("id") < 6000, 2).when(F.col("id") < 11000, 5).otherwise(100)
    key = F.when(F.col("id") < 16000, F.concat_ws("-", size, F.floor(F.col("id") / size)))
    rows = stored(spark.range(20000).select(F.col("id").alias("row"), key.alias("key")), "copies")
    got = sharding.sharded(rows).join(rows, "row")
    counts = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(counts) == 20000 and len(counts) == 16 and max(counts) - min(counts) <= 1
    n_cut = sharding.cut_keys(got).count()
    print("cut groups", n_cut)
    assert n_cut <= 2 * 16  # 3,000 + 1,000 + 50 groups; levelling may cut one at each edge


def test_quality_measures_and_policies(spark, docs, none):
    run = "a b c d e f g h "
    text = run * 2 + "tail\nline\nline"
    assert dict(zip(quality.MEASURES, quality.measure(text)))["n_repeat_words"] == 16
    assert quality.repeated_words(b"a a a a a a a a a".split()) == 9
    assert quality.measure(None) == quality.measure("") == (0,) * len(quality.MEASURES)
    rows = quality.ledger(docs)
    assert rows.count() == docs.count() and rows.columns.count("n_words") == 1
    found = {(r["version"], r["rule"]): r for r in quality.ablations(rows).collect()}
    bits = [r["fail_bits"] for r in rows.collect()]
    for (version, rule), r in found.items():
        mask, bit = quality.POLICIES[version], quality.BIT[rule]
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_only"] == sum(b & mask == bit for b in bits)
        assert r["n_kept"] == sum(not b & mask for b in bits)
        assert r["n_kept_without"] == sum(not b & mask & ~bit for b in bits)
    assert quality.ledger(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    sizes = Counter(int(x) for x in np.minimum(rng.lognormal(5, 1.2, 3000).astype(int) + 1, 2048))
    plan = packing.solve(dict(sizes))
    fill: Counter = Counter()
    for x, n in sizes.items():
        sequence, offset = plan.place(np.full(n, x), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            fill[s] += x
            assert o + x <= 2048
    assert max(fill.values()) <= 2048
    assert plan.n_sequences == len(fill) <= 1.01 * sum(x * n for x, n in sizes.items()) / 2048 + 1


def test_best_configuration_is_optimal():
    price = np.full(21, -np.inf)
    price[[3, 7, 11]] = 1.0, 2.5, 4.1
    found = packing.best_configuration(price)
    best = max(a + 2.5 * b + 4.1 * c for a in range(7) for b in range(3) for c in range(2) if 3 * a + 7 * b + 11 * c <= 20)
    assert price[found].sum() == pytest.approx(best) and found.sum() <= 20


def test_packed_pieces(spark, docs, none):
    rows = packing.packed(packing.pieces(docs, with_ids=True))
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(rows).collect()}
    encoder = tokens.Encoder(tokens.BYTE)
    ids_of = {r["doc_id"]: encoder.library(r["text"] or "") + bytes(4) for r in docs.collect()}
    got = rows.collect()
    for r in got:
        part = ids_of[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"]
        assert bytes(whole[r["sequence_id"]])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == part
        assert r["piece"] == 0 or r["length"] == 2048
    assert sum(r["length"] for r in got) == sum(len(ids_of[r["doc_id"]]) // 4 for r in docs.collect())
    assert packing.packed(packing.pieces(none)).count() == 0


def test_mix(spark, docs, none):
    rng = np.random.default_rng(3)
    sizes = [("a", 40, 300), ("b", 10, 300), (None, 400, 30), ("d", 5, 2)]
    rows = [(i, "w " * int(rng.integers(0, 2 * m)), s) for s, n, m in sizes for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.copies(mixing.measured(table)).collect()
    total, weights = sum(len(t.split()) for _, t, _ in rows), {"a": 5, "b": 2, "d": 1, None: 5}
    size_of = Counter()
    for _, t, s in rows:
        size_of[s] += len(t.split())
    capped: set = set()
    while True:  # water-filling, by hand
        level = (total - sum(3 * size_of[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s, w in weights.items() if s not in capped and level * w > 3 * size_of[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for r in got:
        target = 3 * size_of[r["source"]] if r["source"] in capped else level * weights[r["source"]]
        assert r["target"] == pytest.approx(target) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    goals = {r["source"]: r["target"] for r in got}
    off = {s: (round(t), taken[s] - t) for s, t in goals.items()}
    # Documents stay whole, so half of a source's largest one may be missing.
    largest = {x: max(r["size"] for r in got if r["source"] == x) for x in goals}
    assert all(abs(d) <= largest[x] / 2 for x, (_, d) in off.items()), off
    again = sorted((r["doc_id"], r["size"], r["copies"]) for r in mixing.copies(mixing.measured(table)).collect())
    assert again == sorted((r["doc_id"], r["size"], r["copies"]) for r in got)
    times = mixing.mixed(docs)
    assert times.columns == docs.columns and times.count() > 0 and mixing.mixed(none).count() == 0


def test_html():
    page = (
        "<html><head><title>t</title></head><body><header><a href=/>Home</a></header><nav><li>One<li>Two</nav>"
        "<div class='cookie-notice'>We use cookies, please accept them all.</div><article><h1>A &amp; B</h1>"
        "<p>First <b>long</b>\n paragraph of text, with enough words to be one. <script>var x='</p>';</script>"
        "<p>End.</article><div id=comments><p>A reader says that this was a nice one.</p></div><footer>&copy; x</footer>"
    )
    want = "A & B First long paragraph of text, with enough words to be one. End."
    assert html_extract.main_text(page) == want
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""
    body = "Text that goes on for a while. " * 20000
    assert html_extract.main_text(f"<article><p>{body}</article>") == body.strip()


LEAD = "A first paragraph of the article that has enough words to count as text."
TAIL = "A second paragraph of the article that has enough words to count as text."


@pytest.mark.parametrize("tag", ["button", "select", "object", "noscript", "svg", "math", "iframe", "template"])
def test_html_elements_without_an_end_do_not_cut_the_page(tag):
    for page in (
        f"<body><{tag}><article><p>{LEAD}</p><p>{TAIL}</p></article></body>",
        f"<body><article><p>{LEAD}</p><{tag}><p>{TAIL}</p></article></body>",
    ):
        assert html_extract.main_text(page) == f"{LEAD} {TAIL}"


def test_html_keeps_the_text_of_formulas_and_fallbacks():
    for tag in ("math", "object", "noscript"):
        page = f"<article><p>{LEAD} <{tag}>x = 1</{tag}> holds.</p><p>{TAIL}</p></article>"
        assert html_extract.main_text(page) == f"{LEAD} x = 1 holds. {TAIL}"
    page = f"<head><title>t</title><body><article><p>{LEAD}</p><button>Buy now</button><iframe>No frames</iframe><p>{TAIL}</p></article>"
    assert html_extract.main_text(page) == f"{LEAD} {TAIL}"


def test_html_words_in_an_article_do_not_drop_its_text():
    for word in ("related-work", "search", "form-and-function", "social-history"):
        page = f"<article><p>{LEAD}</p><section id='{word}'><h2>On it</h2><p>{TAIL}</p></section></article>"
        assert html_extract.main_text(page) == f"{LEAD} On it {TAIL}"
        page = f"<article><p>{LEAD}</p><h2 id='{word}' class='{word}'>On it</h2><p>{TAIL}</p></article>"
        assert html_extract.main_text(page) == f"{LEAD} On it {TAIL}"
    text = f"{TAIL} {LEAD} {TAIL}"
    page = f"<article><p>{LEAD}</p><section class='related work'><h2>On it</h2><p>{text}</p></section></article>"
    assert html_extract.main_text(page) == f"{LEAD} On it {text}"
    for ad in ("<div class='share'>Share this</div>", "<ul class='related'><li><a href=/>Read this other page too</a></ul>"):
        assert html_extract.main_text(f"<article><p>{LEAD}</p>{ad}<p>{TAIL}</p></article>") == f"{LEAD} {TAIL}"
    outside = f"<div class='related'><p>{text}</p></div><article><p>{LEAD}</p></article>"
    assert html_extract.main_text(outside) == LEAD


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = 6
        keep, drop = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, n).tolist()
        edges = [(i, j, int(rng.integers(0, 6))) for i in range(n) for j in range(i)]

        def cost(side):
            cut = sum(c for a, b, c in edges if side[a] != side[b])
            return cut + sum(drop[i] if side[i] else keep[i] for i in range(n))

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.content_side(keep, drop, edges)) == best


def _near_brute(ids, codes):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("bucket", [20_000, 20])
def test_near_links_equal_brute_force(spark, bucket):
    rng = np.random.default_rng(2)
    codes = set(rng.integers(0, 2**63, 150, dtype=np.uint64).tolist())
    for c in list(codes)[:40]:
        for _ in range(12):
            x = c
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(bit)
            codes.add(x)
    codes |= {3 << k for k in range(62)}  # a crowded bucket
    codes = np.array(sorted(codes), dtype=np.uint64)
    signed = codes.view(np.int64)
    table = spark.createDataFrame([(int(c),) for c in signed], "code bigint")
    from sourcemine.llm.components import components

    roots = {r["u"]: r["root"] for r in components(simhash.links(table, bucket)).collect()}
    assert [roots.get(int(c), int(c)) for c in signed] == _near_brute(signed.tolist(), codes).tolist()


def test_near_groups(docs, none):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_groups(docs).collect()}
    by_id = {i: c for (i, _), c in got.items()}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[7] == by_id[8] == 7
    assert got[None, simhash.fingerprint("one") - (simhash.fingerprint("one") >> 63 << 64)] is None
    left = simhash.one_of_each(docs)
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, -1, 4, 5, 6, 7, 9]
    assert simhash.near_groups(none).count() == simhash.one_of_each(none).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi <turn>\\"), (1, 1, "assistant", "</turn>\n\\<"), (1, 2, "user", None), (2, 0, None, ""),
             (None, None, "assistant", "x"), (1, 1, "assistant", "</turn>\n\\<")]
    rows = chat.formatted(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digests(rows).collect()}
    told = "user\nhi <turn>\\\n" + "assistant\n</turn>\n\\<\n" * 2 + "user\n\n"
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(("</turn>\n\\<" * 2).encode()).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    examples = sorted(chat.expanded(rows).where("conv_id = 1").collect(), key=lambda r: r["example"])
    assert [r["text"].count("<says>") for r in examples] == [2, 3]
    for r in examples:
        assert chat.unescaped(r["text"][r["loss_start"] : r["loss_start"] + r["loss_length"]]) == "</turn>\n\\<"
    assert chat.digests(rows.limit(0)).count() == 0


def test_chat_examples_are_rows_checked_against_their_prefix(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b<"), (1, 1, "assistant", "b<"), (1, 2, None, None),
             (1, 3, "assistant", ""), (None, 0, "assistant", "c")]
    rows = chat.formatted(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    lines, examples = chat.written(rows)
    texts = {}
    for r in sorted(lines.collect(), key=lambda r: r["start"]):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["formatted"]
    found = sorted(((r["conv_id"] or 0, r["example"]), r) for r in examples.collect())
    assert [k for k, _ in found] == [(0, 0), (1, 0), (1, 1), (1, 2)]
    full = {(r["conv_id"] or 0, r["example"]): r for r in chat.expanded(rows).collect()}
    for k, r in found:
        text = texts[r["conv_id"]]
        context = text[: r["context_end"]]
        assert hashlib.sha256(context.encode()).hexdigest() == r["context_sha256"]
        assert full[k]["text"].startswith(context) and full[k]["loss_start"] == r["target_start"]
        assert text[r["target_start"] :].startswith(["c", "b\\<", "b\\<", ""][found.index((k, r))])
    one = F.col("example") == 1
    for wrong in (
        examples.withColumn("context_end", F.when(one, 0).otherwise(F.col("context_end"))),
        examples.withColumn("context_sha256", F.when(one, "x").otherwise(F.col("context_sha256"))),
        examples.withColumn("target_length", F.when(one, 1).otherwise(F.col("target_length"))),
        examples.where(~one),
    ):
        with pytest.raises(Exception, match="example|context|target"):
            chat.read_digests(lines, wrong).collect()


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(700)]
    rows += [(50, rows[50][1]), (None, rows[3][1]), (901, None), (902, [float("nan")]), (903, [None, 1.0]), (904, []), (905, [0.5])]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a third alike
    got = topk.top_k(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id % 50 = 0").collect()
    whole = []
    for i, (vec, x) in enumerate(rows):
        if x is not None and all(c is not None and np.isfinite(c) for c in x):
            whole.append((i, vec, np.pad(np.floor(256 * np.array(x, np.float32).astype(float)), (0, 24 - len(x)))))
    want = []
    for i, vec, x in whole:
        if vec is not None and vec % 50 == 0:
            scores = sorted((-int(x @ y), float("inf") if v is None else v) for j, v, y in whole if j != i)[:5]
            want += [(vec, k, None if v == float("inf") else v, -s) for k, (s, v) in enumerate(scores, 1)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(spark, empty, "vec_id % 50 = 0").count() == 0


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(6)
    plain = [f"word{i}" for i in range(60)]

    def text(bad):
        words = rng.choice(plain, rng.integers(5, 150)).tolist()
        return " ".join(words[:3] + (["vile"] if bad else []) + words[3:])

    truth = [int(i % 4 == 0) for i in range(240)]
    network = toxicity.train([text(y) for y in truth[:160]], truth[:160], least_steps=150)
    scores = toxicity.Scorer(network).score([text(y) for y in truth[160:]])
    assert np.mean((scores >= toxicity.THRESHOLD) == np.array(truth[160:], bool)) > 0.95
    rows = toxicity.scored(docs, network)
    assert rows.count() == docs.count() and rows.columns.count("score") == 1
    assert all(0 <= r["score"] <= 1 for r in rows.collect())
    assert toxicity.scored(none, toxicity.train([], [])).count() == 0
    assert toxicity.train(["a", "b"], [1, 1]).fitted is False


def test_windows_overlap_and_cover():
    for n in (0, 1, 47, 48, 49, 84, 85, 1000):
        cut = toxicity.windows_of(np.arange(1, n + 1))
        assert set(cut.ravel()) - {0} == set(range(1, n + 1))


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = new_scratch_path(spark, "stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0 or k == 3
    tokens_in = sum(r["length"] for r in docs.collect())
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and tokens_in > 0
    assert os.path.exists(os.path.join(os.path.dirname(corpus_pipeline.__file__), "__spark_entry__.py"))
