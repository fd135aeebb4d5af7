"""The ten operators against brute force, exact round trips and held-out accuracy, and edge cases."""

import functools
import io
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quillstream.llm import bitplanes, html_layout, langid, lm_difference, nbest, ngram_join, packing, pu_classifier, rules, vector_graph
from quillstream.llm.components import components
from quillstream.llm.queries import tokenizer_path
from quillstream.llm.tokens import ChunkEncoder

BPE = tokenizer_path("byte_bpe_50k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
RNG = random.Random(11)
WORDS = "the of and river stone light quiet garden window paper signal market orange silver copper forest letter bridge winter summer".split()
ODD = [None, "", " ", "x", "a  b", " \n\n a \n b", "a\x1cb  c", "it's  don't 's", "é☃ a\tb", "<|endoftext|> a", "12 34.5", "a b", "ÀÖ×÷ y", "end "]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [prose(RNG.randint(1, 120)) for _ in range(60)] + ODD + ["long " + prose(6000)]
    texts += [texts[3], texts[3]]
    rows = [(None if k == 5 else 7 if k in (8, 9) else k, t, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def whole(text):
    return library().encode(text or "", add_special_tokens=False).ids


# --- work tables ------------------------------------------------------------------------------


def test_work_tables_go_to_the_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from quillstream.llm import common

    of = lambda at, context: SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: at))
    assert common.shared_dir(of(f"{tmp_path}/work/", spark.sparkContext)) == f"file://{tmp_path}/work"  # no scheme: the default file system
    assert common.shared_dir(of(f"file:///{tmp_path}/work", spark.sparkContext)) == f"file://{tmp_path}/work"
    made = common.stored(spark.range(3), "t")
    place = made._stored_at.removeprefix("file://")
    assert made.count() == 3 and os.path.isdir(place)
    common.release(made)
    assert not os.path.exists(place)
    calls = []
    local = SimpleNamespace(master="local[4]", getCheckpointDir=lambda: None, setCheckpointDir=calls.append, _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc)
    assert common.shared_dir(of(None, local)) == calls[0] and calls[0].startswith("file:///")
    with pytest.raises(RuntimeError):
        common.shared_dir(of(None, SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)))


def test_names_of_hash_pairs_are_distinct(spark):
    from quillstream.llm.common import row_key, told_apart, unused

    pairs = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "high long, low long")
    assert len({r[0] for r in pairs.select(told_apart(pairs, "high", "low")).collect()}) == 3
    rows = spark.createDataFrame([(1, None), (1, ""), (None, "1"), (None, None), (1, "-"), (1, "1")], "d long, t string")
    assert rows.select(row_key(F.col("d"), F.col("t")).alias("k")).distinct().count() == 6
    assert unused(rows.toDF("Key", "_key"), "key") == "__key"


# --- tokens, 1 and 7 ----------------------------------------------------------------------------


def test_chunks_encode_as_whole_texts_do():
    rng = random.Random(2)
    texts = [x for x in ODD if x] + [prose(50) for _ in range(20)] + ["".join(rng.choice("ab' .\n\t é1<|×") for _ in range(14)) for _ in range(3000)]
    e = ChunkEncoder(BPE, keep=200, step=300)
    for x, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == whole(x), x


def test_chunks_whose_hashes_meet_are_encoded_apart(monkeypatch):
    from quillstream.llm import tokens

    real = tokens.chunk_sums
    monkeypatch.setattr(tokens, "chunk_sums", lambda raw, b, e, *code: real(raw, b, e, *code) if code else (e - b).astype(np.uint64))
    e = ChunkEncoder(BPE)
    for texts in (["the cat sat", "one two six red", ""], ["dog the cow", "ink"]):
        assert [x.tolist() for x in e.encode(texts)] == [whole(x) for x in texts]


def test_literals_of_added_tokens_encode_as_the_library_does():
    texts = ["a b <|endoftext|> c", "<|endoftext|>", "x<|endoftext|>y z", "a <|endoftext| > b", "plain words", "é <|endoftext|><|endoftext|>"]
    got = [x.tolist() for x in ChunkEncoder(BPE).encode(texts)]
    assert got == [whole(x) for x in texts] and got[0] == [64, 275, 220, 50256, 269]


@pytest.mark.parametrize("bits", [False, True])
def test_id_file_round_trip(bits):
    rng = np.random.default_rng(1)
    given = [(None, []), (-3, [5]), (7, rng.integers(0, 2**32, 1000).tolist()), (7, list(range(300))), (9, [])]
    out = io.BytesIO()
    w = bitplanes.IdWriter(out, bits, per_chunk=128)
    for d, ids in given:
        w.add(d, np.array(ids, np.uint32))
    assert w.close() == 1301
    assert bitplanes.describe_bytes(out.getvalue()) == given
    r = bitplanes.IdReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert r.ids(3).tolist() == list(range(300)) and len(r.chunks) == 11


def test_op1_matches_brute_force(spark, docs):
    got = bitplanes.bitplane_round_trip(docs, BPE, 2).collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    want = Counter((r["doc_id"], len(i := whole(r["text"]) + [2]), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [r["doc_id"] for r in rows]
    assert bitplanes.bitplane_round_trip(docs.limit(0), BPE, 2).count() == 0


def test_packing_plans_are_exact():
    rng = np.random.default_rng(4)
    for n in (0, 1, 700):
        lengths = np.clip(rng.lognormal(4, 1, n).astype(int), 1, 256)
        h = Counter(lengths.tolist())
        plan = packing.pack_histogram(h, 256)
        used = Counter()
        for p, k in plan:
            assert sum(p) <= 256
            for x in p:
                used[x] += k
        assert used == h
        assert sum(k for _, k in plan) <= math.ceil(sum(lengths) / 256) * 1.02 + 1


def test_op7_packs_every_piece_without_gaps(spark, docs):
    got = packing.pattern_packing(docs, BPE, 0, 256).collect()
    per_doc = Counter()
    for r in got:
        per_doc[r["doc_id"]] += r["length"]
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(whole(r["text"])) + 1
    assert per_doc == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert len(seqs) <= math.ceil(sum(per_doc.values()) / 256) + 2
    long = sorted((r for r in got if r["doc_id"] == 60 + len(ODD)), key=lambda r: r["piece"])
    assert all(r["length"] == 256 for r in long[1:]) and [r["piece"] for r in long] == list(range(len(long)))
    assert packing.pattern_packing(docs.limit(0), BPE, 0, 256).count() == 0
    big = [2**53 + 1, 2**53 + 3, None, 2**62 + 1]
    assert Counter(r["doc_id"] for r in packing.pattern_packing(table(spark, [(d, "a b") for d in big]), BPE, 0, 256).collect()) == Counter(big)
    one_length = packing.pack_pieces(packing.stored(spark.range(500).selectExpr("id as doc_id", "0 as piece", "0L as start", "100L as length", "id as ids_crc32"), "t"), 256, group=50)
    assert one_length.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 256").count() == 0 and one_length.select("sequence_id", "offset").distinct().count() == 500


# --- 2 ---------------------------------------------------------------------------------------------


def every_segmentation(s, text):
    t = (nbest.SPACE + text).replace(" ", nbest.SPACE)
    ways = [[(0.0, ())]]
    for i in range(1, len(t) + 1):
        here, single = [], False
        for j in range(max(0, i - s.longest), i):
            if got := s.pieces.get(t[j:i]):
                here += [(a + got[1], b + (got[0],)) for a, b in ways[j]]
                single |= j == i - 1
        if not single:
            here += [(a + s.unknown, b + s._unknown_ids(t[i - 1])) for a, b in ways[i - 1]]
        ways.append(here)
    return ways[-1]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_op2_against_all_segmentations(n):
    s = nbest.Segmenter.from_model(PIECES, n)
    rng = random.Random(n)
    texts = ["the cat", "a, b", "aaaaaa", "😀é x", "  a", "\n\t"] + ["".join(rng.choice("the anr,é") for _ in range(8)) for _ in range(25)]
    for text, got in zip(texts, s.segment(texts)):
        every = sorted(every_segmentation(s, text), key=lambda x: -x[0])
        score = {ids: v for v, ids in every}
        assert [v for v, _ in got] == [v for v, _ in every[:n]]
        assert len({tuple(i.tolist()) for _, i in got}) == len(got)
        for v, ids in got:
            assert score[tuple(ids.tolist())] == v and s.decode(ids).decode() == text


def test_op2_long_parts_agree_with_short_ones():
    s = nbest.Segmenter.from_model(PIECES, 4)
    rng = random.Random(4)
    for text in ["thecat" * 9, "a" * 50, "zq" * 25, "".join(rng.choice("theanr") for _ in range(60))]:
        part = nbest.SPACE + text
        whole_part, cut = s.search(part), s.words([part])[0]
        assert [round(v, 6) for v, _ in whole_part] == [round(v, 6) for v, _ in cut]
        assert all(s.decode(np.array(ids)).decode() == text for _, ids in whole_part)
    text = "international" * 8000
    assert s.decode(s.segment([text])[0][0][1]).decode() == text


def test_op2_changes_are_the_least_sets():
    from itertools import combinations

    rng = random.Random(12)
    for n in range(1, 9):
        for _ in range(60):
            items = sorted({(rng.choice([0.0, 0.5, 1.0, rng.random()]), rng.randint(0, 4), rng.randint(1, 3)) for _ in range(rng.randint(0, 8))})[: n - 1]
            sets = [c for k in range(len(items) + 1) for c in combinations(items, k) if len({i for _, i, _ in c}) == k]
            sets.sort(key=lambda c: (sum(d for d, _, _ in c), len(c), [items.index(x) for x in c]))
            assert nbest.changes(items, n) == sets[:n]
    assert len(nbest.changes([(1.0 + k / 1000, k, 1) for k in range(63)], 64)) == 64


def test_op2_on_a_table(spark, docs):
    rows = nbest.decode(nbest.segment(docs, PIECES, 3), PIECES).collect()
    assert all(r["score"] <= 0 for r in rows)
    assert Counter(r["decoded"] for r in rows if r["rank"] == 0) == Counter((r["text"] or "") for r in docs.collect())
    assert nbest.digest(nbest.decode(nbest.segment(docs.limit(0), PIECES), PIECES)).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------


def test_op3_codes_and_accuracy(spark):
    p = langid.letters_of("Ab1c")
    assert p.tolist() == [0, 97, 98, 0, 99, 0]
    assert len(langid.gram_codes(p)) == 3 + 5 + 3
    rng = random.Random(5)
    lex = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(300)] for x, a in (("aa", "abcdefg"), ("bb", "efghijk"))}
    rows = [(k, " ".join(rng.choice(lex[x]) for _ in range(60)), x) for k, x in enumerate(rng.choices(["aa", "bb"], k=200))]
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (902, "", None), (1, rows[1][1], None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    known = {k: x for k, _, x in rows[:200]}
    assert all(r["lang_pred"] == known[r["doc_id"]] for r in got if r["doc_id"] < 200)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] >= 900)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(none).first()["lang_pred"] == "und" and langid.identify(none.limit(0)).count() == 0


def brute_profile(texts, size):
    counts = Counter()
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        for w in words:
            for n in (1, 2, 3):
                padded = w if n == 1 else f"\0{w}\0"
                counts.update(padded[i : i + n] for i in range(len(padded) - n + 1) if n < 3 or padded[i + 1] != "\0")
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) + {1: 0, 2: 1 << 62, 3: -(1 << 63)}[len(g)]
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_op3_against_counters(spark):
    rng = random.Random(15)
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 40)))
    rows = [(k, text(a), x) for k, (x, a) in enumerate([("aa", "abcdef'"), ("bb", "defghé2"), ("cc", "ÀBCxyz-")] * 25)]
    rows += [(500, "", None), (501, "ab", "aa"), (501, "ab", "aa"), (502, "7", "cc")]
    size = 60
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=size).collect()
    train = {x: brute_profile([t for k, t, y in rows if y == x and zlib.crc32(str(k).encode()) % 5], size) for x in ("aa", "bb", "cc")}
    want = Counter()
    for k, t, _ in rows:
        own = brute_profile([t], size)
        far = {x: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for x, p in train.items()}
        best = min(far, key=lambda x: (far[x], x))
        want[(k, best, round(1 - far[best] / (size * len(own)), 9)) if own else (k, "und", 0.0)] += 1
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got) == want


def test_op3_tells_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98


def test_op3_distance_is_out_of_place():
    langs, t = langid.rank_table({"x": np.array([10, 20, 30]), "y": np.array([30, 40, 10])})
    assert langs == ["x", "y"] and langid.distances(np.array([10, 50, 30]), t, 3).tolist() == [0 + 3 + 0, 2 + 3 + 2]


# --- 4 ---------------------------------------------------------------------------------------------


def brute_groups(rows, n, threshold):
    def grams(t):
        w = [x for x in (t or "").lower().replace("\x0b", " ").split(" ") for x in x.split("\n") if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {d: (links[i], min(rows[k][0] for k in range(len(rows)) if find(k) == find(i))) for i, (d, _) in enumerate(rows)}


def test_op4_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(25):
        base = [rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(rng.choice([2, 5, 30, 80]))]
        for _ in range(rng.choice([1, 2, 4])):
            w = list(base)
            for k in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
            rows.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(rows)] + [(1000, ""), (1001, None), (1002, ""), (1003, "\n")]
    report = []
    got = ngram_join.ngram_groups(table(spark, rows).withColumn("cls", F.lit("clash")), block=8, report=report).collect()
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_groups(rows, 3, 0.5)
    assert [d for d, _, _ in report] == [7, 5, 3] and report[-1][1] >= report[0][1] > 0  # few links prove little: it goes to the shortest prefix
    assert len({r["component_id"] for r in got}) == sum(r["kept"] for r in got)
    assert ngram_join.ngram_groups(table(spark, [])).count() == 0


def test_op4_a_hot_group_of_near_copies_is_split(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base + [f"only{k}"])) for k in range(70)] + [(100 + k, " ".join(base)) for k in range(40)]
    got = ngram_join.ngram_groups(table(spark, rows), block=16).collect()
    assert all(r["n_links"] == 109 and r["component_id"] == 0 and r["kept"] == (r["doc_id"] == 0) for r in got)


def test_op4_prefixes_shorten_to_the_target():
    assert ngram_join.prefix_depth(0.5, 56, 0.999) == 3 and ngram_join.prefix_depth(0.9, 56, 0.999) > 10
    with pytest.raises(ValueError):
        ngram_join.prefix_depth(0.01, 2, 0.999)
    same, edge = np.zeros(ngram_join.BINS), np.zeros(ngram_join.BINS)
    same[-1], edge[ngram_join.BINS // 2] = 10**6, 10**6
    assert ngram_join.estimated_recall(same, 7, 56, 0.5) > 0.999  # only near-identical texts: deep prefixes do
    found = 1 - (1 - 0.5**5) ** 56  # of all links, those at the threshold found at depth 5
    assert ngram_join.estimated_recall(edge, 5, 56, 0.5) == pytest.approx(found, abs=1e-3) and ngram_join.estimated_recall(same * 0, 7, 56, 0.5) == 0


def test_op4_stops_shortening_where_links_are_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    rows = [(100 * g + k, " ".join([f"g{g}x{w}" for w in base] + [f"only{g}y{k}"])) for g in range(3) for k in range(100)] + [(9000 + k, prose(30, rng)) for k in range(20)]
    report = []
    got = ngram_join.ngram_groups(table(spark, rows), target=0.99, block=64, report=report).collect()
    assert len(report) == 1 and report[0][1] == 3 * 100 * 99 // 2
    assert all(r["n_links"] == 99 and r["component_id"] == r["doc_id"] // 100 * 100 for r in got if r["doc_id"] < 9000)


def test_op4_signatures_meet_as_often_as_sets_are_alike():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.unique(x[:600]), np.unique(x[300:])
    assert abs((ngram_join.signature(a, 0, 392) == ngram_join.signature(b, 0, 392)).mean() - 1 / 3) < 0.08


def test_op4_repeated_rows_and_shared_passages(spark):
    many = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "'a page that was not found on this server' as text")
    lead = " ".join(f"lead{k}" for k in range(40))
    rows = [(k, lead + " " + " ".join(f"own{k}x{j}" for j in range(160))) for k in range(60)]
    got = ngram_join.ngram_groups(many.unionByName(table(spark, rows)), block=16)
    bad = got.filter("doc_id is null and (n_links <> 99999 or component_id is not null or not kept)").count()
    assert got.count() == 100_060 and bad == 0
    assert got.filter("doc_id is not null and (n_links > 0 or not kept)").count() == 0


def test_components_of_a_long_chain(spark):
    e = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


# --- 5 ---------------------------------------------------------------------------------------------


def test_op5_against_counters(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng.randint(1, 60), rng)) for k in range(40)] + [(50, None), (51, ""), (3, prose(9, rng)), (None, prose(5, rng)), (2**53 + 1, prose(7, rng)), (2**53 + 3, None)]
    target = spark.createDataFrame([(k,) for k in (1, 3, 5, 7, 7, 99)] + [(None,)], "doc_id long")
    got = lm_difference.cross_entropy_difference(table(spark, rows), target, BPE).collect()
    assert len(got) == len(rows)
    ids = [(d, whole(t)) for d, t in rows]
    models = []
    for keep in (lambda d: d in (1, 3, 5, 7), lambda d: True):
        pair, ctx, one = Counter(), Counter(), Counter()
        for d, x in ids:
            if keep(d):
                h = [-1, *x[:-1]]
                pair.update(zip(h, x))
                ctx.update(h[: len(x)])
                one.update(x)
        models.append((pair, ctx, one, sum(one.values())))

    def loss(x, m, own):
        """The model's loss on a document that is left out of it."""
        pair, ctx, one, n = m
        h = [-1, *x[:-1]]
        p, c, o = (Counter(zip(h, x)), Counter(h), Counter(x)) if own else (Counter(),) * 3
        n -= len(x) * own
        return np.mean([-math.log((pair[a, w] - p[a, w] + 100 * (one[w] - o[w] + 0.5) / (n + 0.5 * 50258)) / (ctx[a] - c[a] + 100)) for a, w in zip(h, x)])

    want = Counter((d, round(loss(x, models[0], d in (1, 3, 5, 7)) - loss(x, models[1], True), 9) if x else None) for d, x in ids)
    for run_tokens in (4_000_000, 60):
        got = lm_difference.cross_entropy_difference(table(spark, rows), target, BPE, run_tokens=run_tokens).collect()
        assert Counter((r["doc_id"], None if r["score"] is None else round(r["score"], 9)) for r in got) == want
    assert lm_difference.cross_entropy_difference(table(spark, []), target, BPE).count() == 0


def test_op5_runs_are_spread_evenly(spark):
    x = [lm_difference.run_number(t, k, 51) for t in range(51) for k in (0, 1)]
    assert len(set(x)) == 102
    got = spark.createDataFrame([(v,) for v in x], "v long").selectExpr("v", "hash(v) as h").collect()
    assert lm_difference.spark_hash(np.array([r["v"] for r in got])).tolist() == [r["h"] for r in got]
    assert set(Counter(r["h"] % 51 for r in got).values()) == {2}


def test_op5_totals_are_64_bit(spark):
    rows = [(r, key, 3_000_000_000 + r, 2**31) for r in range(4) for key in (5, 7)] + [(9, 8, 1, 0)]
    got = lm_difference.total_counts(spark.createDataFrame(rows, "run long, key long, c long, t long")).collect()
    assert {(r["run"], r["key"]): (r["c"], r["t"]) for r in got} == {(r, k): (12_000_000_006, 2**33) if k < 8 else (1, 0) for r, k, _, _ in rows}
    keys, c = np.array([3, 2**32 - 1]), np.array([1, 2**32 - 1])
    assert [x.tolist() for x in lm_difference.unpack(lm_difference.pack([keys, c, c]), 3)] == [keys.tolist(), c.tolist(), c.tolist()]
    with pytest.raises(OverflowError):
        lm_difference.pack([keys, c + 1, c])


# --- 6 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("a < b", "a < b"), ("<p>a<p>b", "a\n\nb"), ("x<br>y", "x\ny"), ("<b>a</b> <i>b</i>\n c", "a b c"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"), ("<ol type=i><li>a<li value=4>b</ol>", "i. a\niv. b"),
    ("<table><tr><th>Name<th>N<tr><td>a b c<td>1</table>", "Name   N\na b c  1"), ("<table><tr><td colspan=2>ab<td>z<tr><td>longer<td>y<td>x</table>", "ab         z\nlonger  y  x"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<pre> a\n  b</pre>c", " a\n  b\n\nc"), ("<div hidden>n</div><p style='display: none'>n</p><script>n</script><title>n</title>y", "y"),
    ("<details><summary>s</summary>n</details><details open><summary>t</summary>y</details>", "s\nt\ny"), ("<!-- n --><p>&lt;&amp;&nbsp;x</p>", "<& x"), ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<td>x</td></p></b>y", "xy"), ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"), ("<select><option>a<option>b</select>", "a\nb"),
])
def test_op6_layout(page, text):
    assert html_layout.render(page) == text


@pytest.mark.parametrize("page,text", [
    ("<p>So <math><mi>x</mi><mo>=</mo>\n<mfrac><mn>1</mn><mn>2</mn></mfrac></math>, then</p>", "So x = 1 2, then"), ("<p>a</p>is<math></math> b", "a\n\nis b"),
    ("a<math display=block><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>E=m</annotation></semantics></math>b", "a\nE = m\nb"),
    ("<math><mtext>if <b>x</b> holds</mtext><mspace/><mphantom><mi>n</mi></mphantom></math>", "if x holds"),
    ("<svg><title>n</title><desc>n</desc><defs><text>n</text></defs>n<g><text>Sales <tspan>2020</tspan></text><text>up<tspan x=1>next</tspan></text></g><defs/><text>z</text></svg>t", "Sales 2020 up next z t"),
    ("<p>x<svg><foreignObject><p>p<p>q</foreignObject><text>r</text></svg></p>", "x\n\np\n\nq\n\nr"), ("<svg><g><p>after</p>rest", "after\n\nrest"), ("<text>a</text>b", "ab"),
    ("<svg visibility=hidden><text>n</text><text visibility=visible>y</text></svg><svg display=none><text>n</text></svg>", "y"),
    ("<div style='visibility:hidden'>n <b style='visibility: visible'>see</b> n</div>d", "see\nd"), ("<p style='visibility:hidden'><i style='display:none;visibility:visible'>n</i>n</p>y", "y"),
    ("<ol><li style='visibility:collapse'>n<li>b</ol>", "2. b"), ("<p style='backface-visibility:hidden'>y</p>", "y"),
])
def test_op6_formulas_drawings_and_visibility(page, text):
    assert html_layout.render(page) == text


def test_op6_deep_and_broken_markup_is_linear(spark):
    assert html_layout.render("<b>" * 40000 + "x") == "x" and html_layout.render("<a '" * 20000) and html_layout.render("<p>" * 40000 + "y") == "y"
    got = html_layout.render_pages(spark.createDataFrame([(1, "<p>a", "old"), (2, None, "old")], "page_id long, html string, text string")).collect()
    assert [(r["page_id"], r["text"]) for r in got] == [(1, "a"), (2, "")]


def brute_table(rows, pad):
    """Every column and every taken place one by one, then characters on a canvas."""
    taken, cells, edges = set(), [], set()
    for r, row in enumerate(rows):
        c = 0
        for lines, across, down in row:
            while (r, c) in taken:
                c += 1
            taken |= {(i, c + j) for i in range(r, min(len(rows), r + down)) for j in range(across)}
            cells.append((r, c, c + across, lines))
            edges |= {c, c + across}
            c += across
    column = {c: k for k, c in enumerate(sorted(edges))}
    size = lambda lines: max((len(x) for x in lines if len(x) <= pad), default=0)
    width = [max([size(x) for _, a, b, x in cells if column[a] == k and column[b] == k + 1], default=0) for k in range(len(column))]
    for _, a, b, lines in cells:
        if column[b] > column[a] + 1:
            have = sum(width[column[a] : column[b]]) + 2 * (column[b] - column[a] - 1)
            width[column[b] - 1] += max(0, size(lines) - have)
    out = []
    for r in range(len(rows)):
        mine = [x for x in cells if x[0] == r]
        for k in range(max((len(x[3]) for x in mine), default=0)):
            line = ""
            for _, a, _, lines in mine:
                if k < len(lines) and lines[k]:
                    line = line.ljust(max(sum(width[: column[a]]) + 2 * column[a], len(line) + 2 if line else 0)) + lines[k]
            out.append(line)
    return out


def test_op6_tables_against_brute_force():
    rng = random.Random(17)
    for _ in range(400):
        rows = [[([rng.choice(["", "a", "bcd", "efghi jk", "x" * 12]) for _ in range(rng.randint(1, 2))], rng.choice([1, 1, 1, 2, 4]), rng.choice([1, 1, 2, 3])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 6))]
        assert html_layout.lay_out(rows, 10) == brute_table(rows, 10), rows


@pytest.mark.parametrize("rows,down", [(2000, 65534), (2000, 1000), (50, 3)])
def test_op6_wide_spans_cost_no_more_than_their_cells(rows, down):
    text = html_layout.render("<table>" + f"<tr><td colspan=1000 rowspan={down}>a" * rows + "</table>")
    assert len(text) < 8_000_000 and [x.strip() for x in text.split("\n")] == ["a"] * rows


def test_op6_keeps_all_visible_words(spark):
    from html.parser import HTMLParser

    class Seen(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "head")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "head")

        def handle_data(self, data):
            self.words += [] if self.off else data.split()

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(100).collect():
        p = Seen()
        p.feed(r["html"])
        assert "".join(p.words) == "".join(html_layout.render(r["html"]).replace("\n- ", "\n").removeprefix("- ").split())


# --- 8 ---------------------------------------------------------------------------------------------


def brute_rules(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_op8_against_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \x0b\n", "a", "a b c d e f g h", "x " * 40, "a|b #$ 😀é\x85z\xa0q", "\n".join(["same line here", "other", "same line here", "", " "])]
    for _ in range(60):
        w = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))]
        texts.append(rng.choice([" ", "\n", "\t"]).join(w + w[: rng.randint(0, 20)]))
    got = rules.apply_rules(table(spark, list(enumerate(texts))).withColumn("kept", F.lit("old"))).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got} == {k: brute_rules(t) for k, t in enumerate(texts)}
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)
    assert rules.apply_rules(table(spark, [])).count() == 0


def test_op8_plan_has_no_python_and_no_exchange(spark):
    plan = rules.apply_rules(table(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- 9 ---------------------------------------------------------------------------------------------


def test_op9_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(60):
        c = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 1, 3, 12]))):
            v = c + rng.normal(size=16) * rng.choice([0, 0.05, 0.1, 0.3])
            rows.append((k, [float(x) for x in v], int(rng.integers(0, 2))))
            k += 1
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [1.0, 2.0], 1), (906, [], 1), (907, [2.0, 4.0], 1)]
    report = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_graph.near_dedup(df, shard=40, block=30, report=report).collect()}
    assert len(got) == len(rows) and report[-1][1] == report[-1][2]
    good = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i < 900]
    links, root = Counter(), {i: i for i, *_ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, v, x) in enumerate(good):
        for j, w, y in good[:a]:
            if x == y and v @ w >= 0.93:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    assert all((got[i]["n_links"], got[i]["component_id"]) == (links[i], find(i)) for i in root)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 903, 904, 906))
    assert got[905]["n_links"] == 1 and got[907]["component_id"] == 905
    assert vector_graph.near_dedup(df.limit(0)).count() == 0


def siblings(groups, members, dim=32, seed=5):
    """Unit vectors: tight subgroups whose centres are about 0.95 alike, then some far from all."""
    rng = np.random.default_rng(seed)
    base, turn = np.eye(dim)[0], np.linalg.qr(rng.normal(size=(dim - 1, dim - 1)))[0][:groups]
    centres = np.sqrt(0.95) * base + np.sqrt(0.05) * np.concatenate([np.zeros((groups, 1)), turn], axis=1)
    x = np.concatenate([np.repeat(centres, members, axis=0) + rng.normal(size=(groups * members, dim)) * 0.002, rng.normal(size=(60, dim))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links_of(rows):
    links, near, root = Counter(), Counter(), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        links[r["cls"]] += r["links"]
        near[r["cls"]] += r["near"]
        p, q = sorted((find(r["cls"]), find(r["root"])))
        root[q] = p
    return links, near, {x: find(x) for x in root}


@pytest.mark.parametrize("block,shards", [(6000, 1), (200, 1), (6000, 3)])
def test_op9_counts_links_of_sibling_groups_larger_than_the_candidate_lists(spark, block, shards):
    x = siblings(6, 100)
    df = spark.createDataFrame([(k, [float(a) for a in v], 1, 1 + k % 3) for k, v in enumerate(x)], "cls long, v array<double>, label int, class_size long")
    got = vector_graph.find_links(df, radius=0.93, centroids=vector_graph.k_means(x, shards), overlap=shards, beam=16, degree=20, block=block)
    links, near, root = links_of(got.collect())
    alike = x @ x.T >= 0.93
    np.fill_diagonal(alike, False)
    assert [links[k] for k in range(len(x))] == alike.sum(axis=1).tolist()
    assert [near[k] for k in range(len(x))] == (alike @ (1 + np.arange(len(x)) % 3)).tolist()
    assert len({root[k] for k in range(600)}) == 1 and alike.sum() > 300_000


def test_op9_large_shards_are_divided(spark):
    rng = np.random.default_rng(8)
    x = vector_graph.unit(np.repeat(rng.normal(size=(150, 12)), 4, axis=0) + rng.normal(size=(600, 12)) * 0.02)
    df = spark.createDataFrame([(k, [float(a) for a in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    report = []
    got = {r["vec_id"]: r["n_links"] for r in vector_graph.near_dedup(df, shard=10, fit_rows=100, parts=2, sample=20, report=report).collect()}
    alike = x @ x.T >= 0.93
    assert report[-1][0] > 0 and sum(got.values()) >= 0.99 * (alike.sum() - 600)
    placed = df.selectExpr("vec_id as cls", "label", "12 as dim", "0L as shard", "1L as class_size", "embedding as v")
    cut = vector_graph.refined(placed, ["label", "dim", "shard"], 10, 100, 4)
    assert cut.select("cls").distinct().count() == 600 and cut.groupBy("shard").count().agg(F.max("count")).first()[0] < 600


def test_op9_a_dense_block_stays_small_in_memory():
    import tracemalloc

    x = vector_graph.unit(np.random.default_rng(1).normal(size=(1, 32)) + np.random.default_rng(2).normal(size=(2000, 32)) * 0.01)
    adjacency, _ = vector_graph.robust_prune(x)
    found = np.zeros((2000, 2000), bool)
    tracemalloc.start()
    for i, j in vector_graph.range_search(x, x, adjacency, np.arange(2000)[:, None], 0.93, 16):
        vector_graph.mark(found, i, j, x, x, 0.93)
    got = vector_graph.tally(np.triu(found, 1), np.arange(2000), np.arange(2000), np.arange(2000), np.ones(2000, np.int64))
    assert found.all() and (got.links == 1999).all() and (got.root == 0).all() and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_op9_takes_huge_and_tiny_components(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [1e-310, 1.02e-310], 1), (3, [5.0, 5.0], 1), (4, [-1e308, 1e308], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_graph.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_op9_search_enters_every_component_of_a_graph():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 24))
    x = vector_graph.unit(np.repeat(centres, 80, axis=0) + rng.normal(size=(960, 24)) * 0.25)
    adjacency, _ = vector_graph.robust_prune(x)
    q = vector_graph.unit(x + rng.normal(size=x.shape) * 0.005)
    found = np.zeros((len(q), len(x)), bool)
    for i, j in vector_graph.range_search(q, x, adjacency, np.full((len(q), 1), -1), 0.97, 16):
        vector_graph.mark(found, i, j, q, x, 0.97)
    true = q @ x.T >= 0.97
    assert (found & true).sum() >= 0.99 * true.sum() >= 900


def no_links(classes, **_):
    return classes.selectExpr("cls", "0L as links", "0L as near", "cls as root").limit(0)


def test_op9_compares_all_where_the_audit_fails(spark, monkeypatch):
    x = siblings(10, 40)
    df = spark.createDataFrame([(k, [float(a) for a in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(vector_graph, "find_links", no_links)
    report = []
    got = {r["vec_id"]: r for r in vector_graph.near_dedup(df, sample=20, block=150, report=report).collect()}
    near = x @ x.T >= 0.93
    assert all(got[i]["n_links"] == near[i].sum() - 1 for i in range(len(x)))
    assert [r[0] for r in report] == [3, 5, 7, 9, 0] and all(r[1] > r[2] == 0 for r in report[:4])


def test_op9_audit_grows_until_it_meets_links(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(3000, 16))
    x[2999] = x[17] * 1.01 + 0.01
    df = spark.createDataFrame([(k, [float(a) for a in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(vector_graph, "find_links", no_links)
    report = []
    got = {r["vec_id"]: r for r in vector_graph.near_dedup(df, sample=50, report=report).collect()}
    y = vector_graph.unit(x)
    near = y @ y.T >= 0.93
    assert got[2999]["component_id"] == 17 and not got[2999]["kept"] and report == [(0, near.sum() - len(x), near.sum() - len(x))]
    assert all(got[i]["n_links"] == near[i].sum() - 1 for i in range(len(x)))


# --- 10 --------------------------------------------------------------------------------------------


def test_op10_separates_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = pu_classifier.train(docs, labels)
    extra = docs.unionByName(table(spark, [(5000, None), (5001, ""), (5001, "x")])).withColumn("score", F.lit("clash"))
    got = pu_classifier.score(extra, model)
    assert got.count() == docs.count() + 3 and got.filter("score is null or score < 0 or score > 1").count() == 0
    held = got.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    assert all(r["predicted"] == 1 for r in held if r["quality"] == 1)
    one = docs.limit(50).select("text", pu_classifier.features(F.col("text")).alias("f")).collect()
    x = np.array([r["f"] for r in one])
    spark_m = [r["m"] for r in docs.limit(50).select(model.column(pu_classifier.features(F.col("text"))).alias("m")).collect()]
    assert np.allclose(model.margin(x), spark_m)
    none = pu_classifier.score(docs.limit(5), pu_classifier.train(docs, labels.limit(0))).collect()
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in none)
    assert pu_classifier.score(docs.limit(0), pu_classifier.train(docs.limit(0), labels)).count() == 0


def brute_features(text):
    import unicodedata

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stop = {x for ws in rules.STOP_WORDS.values() for w in ws.split() for x in (w, w.capitalize())}
    n, chars, rows = max(1, len(words)), max(1, len(t)), max(1, len(lines))
    count = lambda signs: sum(c in signs for c in t)
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, sum(unicodedata.category(c) == "Lu" for c in t) / chars, count("0123456789") / chars,
        min(3, count("#*$%&|<>") / n), min(3, count('{}[]()=_/\\;:@^~"') / n), min(3, count("!?") / n), sum(w in stop for w in words) / n, len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, (len(lines) - len(set(lines))) / rows, math.log1p(len(words) / rows), min(3, count(".,") / n), float(not words),
        sum(len(w) > 14 for w in words) / n, sum(bool(regex.search(r"[^\p{L}\p{N}]{2}", w)) for w in words) / n,
    ]


def test_op10_features_against_brute_force(spark):
    rng = random.Random(14)
    texts = [None, "", " \n", "The the THE", "a a b b b", "x" * 20, 'é{}[]()=_/\\;:@^~"!?., end--', "one\ntwo\none\n\n1 2 3"]
    texts += ["".join(rng.choice("aB é1#?.,-/\n  The ") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    got = {r["doc_id"]: r["f"] for r in table(spark, list(enumerate(texts))).select("doc_id", pu_classifier.features(F.col("text")).alias("f")).collect()}
    for k, t in enumerate(texts):
        assert np.allclose(got[k], brute_features(t)), t


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_op10_prior_needs_no_negatives(share):
    rng = np.random.default_rng(4)
    of = lambda n, at: np.concatenate([rng.normal(at, 1, (n, 3)), rng.normal(0, 1, (n, 2))], axis=1)
    unlabelled = np.concatenate([of(int(6000 * share), 2), of(6000 - int(6000 * share), -2)])
    got = pu_classifier.estimate_prior(of(4000, 2), rng.permutation(unlabelled))
    assert abs(got - share) < 0.06


def test_op10_sample_is_bounded_by_rows(spark):
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "concat('the text ', id % 2) as text")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (2, None)], "doc_id long, quality int")
    model = pu_classifier.train(docs, labels, sample=50)
    assert pu_classifier.score(docs, model).filter("score is null").count() == 0


def test_nnpu_finds_the_boundary():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1, 1, (400, 2)), rng.normal(-2, 1, (400, 2))
    u = np.concatenate([rng.normal(1, 1, (700, 2)), rng.normal(-2, 1, (300, 2))])
    m = pu_classifier.fit_nnpu(p, u, 0.7)
    assert (m.margin(p) > 0).mean() > 0.97 and (m.margin(n) < 0).mean() > 0.8
