"""Operators for training data against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mixing, splitting, tokens, topn

DOCS = "doc_id bigint, source string, text string, ids string"


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder("byte_bpe_50k", tokens.TOKENIZERS)


def filing(i, t, roe, gm=0.5, pe=10.0):
    return (i, t, roe, gm, pe)


FILINGS = "filing_id bigint, ticker string, roe double, gross_margin double, pe double"


def test_top_n_ties_missing_and_copies(spark):
    nan = float("nan")
    rows = [
        filing(1, "aa", 0.1), filing(1, " AA", 0.1), filing(2, "AA ", 0.10000000001), filing(3, "AA", 0.1, None), filing(4, "AA", 0.1, nan),
        filing(5, "AA", 0.1, 0.5, None), filing(6, "AA", 0.1, 0.5, 900.0), filing(7, "AA", 0.1, 0.5, -3.0), filing(8, "AA", nan), filing(9, "AA", None),
        filing(10, "B", float("inf")), filing(11, "B", -1.0), filing(12, None, 0.1), filing(None, "B", 0.1),
    ]
    got = topn.best_filings(spark.createDataFrame(rows, FILINGS).withColumn("rank", F.lit("x"))).orderBy("ticker", "rank").collect()
    assert [(r.ticker, r.filing_id) for r in got] == [("AA", 7), ("AA", 1), ("AA", 2), ("AA", 5), ("AA", 6), ("B", 10), ("B", 11)]
    assert topn.best_filings(spark.createDataFrame([], FILINGS)).count() == 0


def test_top_n_hot_group(spark):
    d = spark.range(20000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("g"), "id", ((F.col("id") * 7919) % 1009).cast("double").alias("v"))
    got = {(r.g, r.id) for r in topn.top_n(d, "g", "id", [F.col("v")], 4).collect()}
    p = d.toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert got == {(r.g, r.id) for r in p.groupby("g").head(4).itertuples()}


def test_top_n_copies_of_unequal_scores(spark):
    rows = [("g", 1, 10.0), ("g", 1, 9.0), ("g", 2, 5.0), ("g", 3, 1.0)]
    d = spark.createDataFrame(rows, "g string, id bigint, v double").coalesce(1)
    assert [(r.id, r["rank"]) for r in topn.top_n(d, "g", "id", [F.col("v")], 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_certain_cuts():
    spaces, digits = tokens.certain_cuts([b"a", b" a", b"12", b"\xc2\xa0 ", b"x\n"])
    assert " " in spaces and "\n" not in spaces and digits
    assert tokens.certain_cuts([b"1:"])[1] is False


PIECES = st.sampled_from(["a", "The", " the", "'s", "'", "12:34", ":5", ",6", ".", "  ", " ", "\n", "\r\n", "\t", "\x0b", "\xa0", "　", "\x85", "\x1c", "à", "私は", "²", "½7", "Р", "😀", "'re", "<|endoftext|>", "-->", "00:00:01,250"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_fragments_give_the_ids_of_the_whole(text):
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        e = tokens.encoder(name, tokens.TOKENIZERS)
        want = e.encoding.encode_ordinary(text)
        assert np.frombuffer(e.ids(text), np.int32).tolist() == want and e.count(text) == len(want)


def test_encode_corpus(spark, enc):
    long = "Ein Satz, 00:12:01,500 --> 00:12:03,000\n私は " * 9000
    texts = [None, "", " ", "a\n\nb", long, "x" * 5000, "<|endoftext|>"]
    d = spark.createDataFrame([(i, "s", t, "clash") for i, t in enumerate(texts)] + [(None, None, "a", None)], DOCS)
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(d, "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == [] and got[None] == enc.encoding.encode_ordinary("a")
    for i, t in enumerate(texts[2:], 2):
        assert got[i] == enc.encoding.encode_ordinary(t)
        assert enc.encoding.decode(got[i]) == t
    assert tokens.encode_corpus(d.limit(0), "doc_id", "text").count() == 0
    for name in ("word_bpe_49k", "piece_bpe_32k", "byte_bpe_multi_50k"):
        n = {r.doc_id: r.tokens for r in tokens.count_tokens(d.where("doc_id < 4"), ["doc_id"], "text", name).collect()}
        ids = {r.doc_id: len(r.ids) for r in tokens.encode_corpus(d.where("doc_id < 4"), "doc_id", "text", name).collect()}
        assert n == ids and n[0] == n[1] == 0


def test_json_and_rank_files_agree(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("Hello  world\n\n 12:30 it's", "私は橋　のそば \xa0 x", "<|endoftext|>"):
        assert t.encode(text, add_special_tokens=False).ids == np.frombuffer(enc.ids(text), np.int32).tolist()


def test_mix_shares_and_caps(spark):
    rows = [(i, "big" if i % 10 else "small", 50 + i % 400) for i in range(3000)] + [(90001, None, 10), (90002, "other", 10), (90003, "big", 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 2), ("none", 0.2, 5)], "source string, target_share double, max_repeats int")
    draws, report = mixing.mix_documents(sizes, targets)
    d, r = draws.toPandas(), {x.source: x for x in report.collect()}
    total = sum(s for _, c, s in rows if c in ("big", "small"))
    assert r["big"].reachable and not r["small"].reachable and not r["none"].reachable
    assert abs(r["big"].drawn - 0.5 * total) < 0.01 * total
    small = d[d.source == "small"]
    assert (small.copies == 2).all() and len(small) == 300 and r["small"].drawn == r["small"].capacity
    assert d.copies.max() <= 2 and set(d.source) == {"big", "small"} and 90003 not in set(d.doc_id)
    assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    again = mixing.mix_documents(sizes.repartition(5), targets)[0].toPandas()
    assert d.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    empty = mixing.mix_documents(sizes.limit(0), targets)[1].collect()
    assert len(empty) == 3 and all(x.drawn == 0 for x in empty)


def test_mix_of_rare_draws(spark):
    sizes = spark.range(200_000).selectExpr("id doc_id", "'rare' source", "100 size").union(spark.createDataFrame([(10**6, "rest", 10)], "doc_id bigint, source string, size int"))
    targets = spark.createDataFrame([("rare", 4.1e-5, 3), ("rest", 0.999959, 3)], "source string, target_share double, max_repeats int")
    report = {x.source: x for x in mixing.mix_documents(sizes, targets)[1].collect()}
    goal = 4.1e-5 * 20_000_010 / 100
    assert abs(report["rare"].copies - goal) < 1 and report["rare"].most == 1 and report["rare"].documents == 200_000


def test_top_n_of_an_item_with_many_scores(spark):
    rows = [("g", 1, float(x)) for x in (10, 9, 8, 7, 6)] + [("g", i, float(6 - i)) for i in range(2, 8)]
    for parts in (1, 3):
        d = spark.createDataFrame(rows, "g string, i bigint, s double").repartition(parts)
        assert sorted((r["rank"], r.i) for r in topn.top_n(d, "g", "i", [F.col("s")], 5).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
        topn.BROADCAST_GROUPS, kept = -1, topn.BROADCAST_GROUPS
        try:
            assert topn.top_n(d, "g", "i", [F.col("s")], 5).count() == 5
        finally:
            topn.BROADCAST_GROUPS = kept


def check_pieces(text, enc, rule):
    pieces = splitting.split_text(text, enc, rule)
    ids = np.frombuffer(enc.ids(text), np.int32).tolist()
    assert pieces[0][0] == 0 and pieces[-1][1] == len(ids) and pieces[-1][3] == len(text)
    if len(ids) <= rule.limit:
        assert len(pieces) == 1
        return pieces
    assert len(pieces) > 1
    for a, b in zip(pieces, pieces[1:]):
        assert b[0] == max(0, a[1] - rule.overlap)
    for s, e, c, d, _ in pieces:
        assert 0 < e - s <= rule.room and enc.count(text[c:d]) <= rule.limit
        raw, body = enc.encoding.decode_bytes(ids[s:e]), text[c:d].encode()
        assert body.endswith(raw) and len(body) - len(raw) <= 3
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(PIECES, st.sampled_from(["\n\n", "\r\n\r\n", "\n\n7\n00:00:01,000 --> 00:00:02,000\nHe said", "{1}{2}x\n", "私" * 9, "z" * 60])), max_size=120).map("".join))
def test_split_pieces_tile_the_text(text):
    check_pieces(text, tokens.encoder("byte_bpe_50k", tokens.TOKENIZERS), splitting.SplitRule(limit=40, overlap=7, slack=2))


def test_split_prefers_natural_boundaries(enc):
    cue = "\n\n{n}\n00:00:01,000 --> 00:00:02,000\nThe ferryman kept the old map, and the miller."
    text = "".join(cue.replace("{n}", str(i)) for i in range(60))
    pieces = check_pieces(text, enc, splitting.SplitRule())
    assert {p[4] for p in pieces[:-1]} == {"sentence"}
    assert all(text[p[3] :].startswith("\n\n") for p in pieces[:-1])
    assert {p[4] for p in check_pieces("word " * 2000, enc, splitting.SplitRule())[:-1]} == {"word"}
    assert {p[4] for p in check_pieces("私は橋" * 600, enc, splitting.SplitRule())[:-1]} == {"inside"}


def test_split_documents(spark, enc):
    texts = [None, "", "short", "word " * 599 + "a", "word " * 601, "\n" * 3000]
    d = spark.createDataFrame([(i, "s", t, None) for i, t in enumerate(texts)], DOCS)
    p = splitting.split_documents(d, "doc_id", "text").toPandas()
    n = [enc.count(t) if t else 0 for t in texts]
    assert set(p[p.piece > 0].doc_id) == {i for i, x in enumerate(n) if x > 600}
    bare = splitting.split_documents(d, "doc_id", "text", with_text=False).toPandas()
    assert bare.equals(p.drop(columns="text"))
    assert p[p.doc_id == 0].text.iloc[0] is None and p[p.doc_id == 1].text.iloc[0] == "" and p[p.doc_id == 2].text.iloc[0] == "short"
    assert splitting.split_documents(d.limit(0), "doc_id", "text").count() == 0


def test_pieces_encoded_alone_stay_under_the_limit(spark, tiny, enc):
    p = splitting.split_documents(spark.read.parquet(f"{tiny}/documents.parquet"), "doc_id", "text").toPandas()
    assert max(len(enc.encoding.encode_ordinary(t)) for t in p.text if t) <= 600


def test_mix_by_brute_force(spark, tiny, enc):
    from tidemark.llm.queries import QUERIES

    docs, targets = (spark.read.parquet(f"{tiny}/{t}.parquet").toPandas() for t in ("documents", "mix_targets"))
    docs["n"] = [len(enc.encoding.encode_ordinary(t)) if t else 0 for t in docs.text]
    have = docs.groupby("source").n.sum().reindex(targets.source).fillna(0).to_numpy()
    want = set(targets.source[have * targets.max_repeats.to_numpy() < targets.target_share.to_numpy() * have.sum()])
    assert {r.source for r in QUERIES["p9_found"](spark, tiny).collect()} == want
    assert {r.doc_id for r in QUERIES["p10_found"](spark, tiny).collect()} == set(docs.doc_id[docs.n > 600])
