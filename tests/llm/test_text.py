"""Operators on text: exact encoding, whole packing, held-out accuracy of the reading level."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill import llm
from tidemill.llm import packing, reading_level, tokens

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_replay(texts):
    text = "".join(texts)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    start = tokens.split_points(cp, bounds)
    number, words = tokens.number_words(text, cp, start)
    ids = tokens.replay([w.encode() for w in words], tokens.ranks(tokens.read_vocabulary(tokens.VOCABULARY)))
    cut = np.r_[0, np.cumsum(np.diff(np.searchsorted(start, bounds)))]
    return [[i for n in number[a:b] for i in ids[n]] for a, b in zip(cut, cut[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab's'tre've'mll'd  \n\t1²½é漢😀_-.,’ \x1c\x85"), st.characters(codec="utf-8"))), max_size=6))
def test_replay_equals_the_public_encoder(encoding, texts):
    assert by_replay(texts) == [encoding.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["", " ", "\n\n", "'", "it's''s 's\n's", "a" * 5000, "ab" * 3000, "<|endoftext|> x", "  two  blanks  "])
def test_replay_of_hard_texts(encoding, text):
    assert by_replay([text, "", text]) == [encoding.encode_ordinary(text), [], encoding.encode_ordinary(text)]


def test_encode_table(spark, encoding, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.lit("x").alias("ids"), F.lit(1).alias("word"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "x", 1), (-2, "", "x", 1), (None, "null id", "x", 1), (-3, "same", "x", 1), (-3, "same", "x", 1)], docs.schema)).repartition(3)
    got = tokens.encode(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(encoding.encode_ordinary(r.text or ""))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(r.ids)
    assert have == texts
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}
    assert counts == {k: len(v[0]) for k, v in texts.items()}


def test_encode_small_blocks_and_empty(spark, encoding):
    docs = spark.createDataFrame([(k, f"word{k} it's {'x' * k}") for k in range(50)], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in tokens.encode(docs).collect()} == {r.doc_id: encoding.encode_ordinary(r.text) for r in docs.collect()}
    assert tokens.encode(docs.filter("doc_id < 0")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_pack_never_overfills(sizes):
    bins = packing.pack(sizes, 50)
    used = np.bincount(bins, sizes, minlength=1) if sizes else np.zeros(1)
    assert used.max() <= 50 and len(bins) == len(sizes)


def test_pack_is_tight():
    rnd = random.Random(2)
    sizes = [min(2048, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    assert packing.pack(sizes).max() + 1 <= -(-sum(sizes) // 2048) + 2


def test_fill_containers_keeps_every_piece(spark):
    rows = [(k, 100 * k % 700) for k in range(400)] + [(1000, 2048), (1001, 5000), (1002, None), (1003, 0), (None, 30), (1004, 4096), (5, 30)]
    out = packing.fill_containers(spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("bucket", F.lit("clash")), per_bucket=100).collect()
    per = {}
    for r in out:
        per.setdefault(r.container, 0)
        per[r.container] += r.n_tokens
    assert max(per.values()) <= 2048
    assert sum(r.n_tokens for r in out) == sum(s or 0 for _, s in rows)
    pieces = sorted((r.piece_no, r.n_tokens) for r in out if r.doc_id == 1001)
    assert pieces == [(0, 2048), (1, 2048), (2, 904)]
    assert {r.doc_id for r in out} == {d for d, _ in rows} and len(out) == len(rows) + 3
    assert packing.fill_containers(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


def test_levels_on_held_out_ratings(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/read_labels.parquet")
    held = F.xxhash64("doc_id") % 4 == 0  # a split of the ratings, not of the documents
    est = reading_level.estimate_levels(docs, labels.filter(~held))
    j = est.join(labels.filter(held).groupBy("doc_id").agg(F.avg("read_level").alias("g")), "doc_id")
    r = j.agg(F.count_if(F.expr("level >= 3.5 and g >= 3.5")).alias("tp"), F.count_if(F.expr("level >= 3.5 and g < 3.5")).alias("fp"), F.count_if(F.expr("level < 3.5 and g >= 3.5")).alias("fn"), F.corr("level", "g").alias("c")).first()
    assert r.tp / max(1, r.tp + r.fp) >= 0.9 and r.tp / max(1, r.tp + r.fn) >= 0.9 and r.c > 0.8


def test_levels_of_odd_input(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "[music]\n<i></i>", "a"), (4, "plain words that nobody rated at all here now " * 3, "a"), (None, "x " * 20, "a"), (5, "hard terms of the moot axiom are here again and again " * 2, "a"), (6, "too few words to be prose at all", "a")], "doc_id long, text string, n string")
    labels = spark.createDataFrame([(5, 5, "r"), (5, 4, "r"), (5, None, "r"), (None, 3, "r"), (99, 1, "r")], "doc_id long, read_level int, rater string")
    got = {r.doc_id: r.level for r in reading_level.estimate_levels(docs, labels).collect()}
    assert set(got) == {4, 5} and all(v is not None for v in got.values())
    assert {r.level for r in reading_level.estimate_levels(docs, labels.filter("doc_id < 0")).collect()} == {None}
    assert reading_level.estimate_levels(docs.filter("doc_id < 0"), labels).collect() == []


def test_speech_of_very_long_texts(spark):
    texts = ["[" * 200_000, "<i>word</i> " * 50_000, "a" * 500_000, "[never closed\n" + "word " * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n for r in reading_level.edges(docs).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    assert got == {1: 50_000, 2: 1, 3: 1002}


def test_long_brackets_and_adverts_are_no_speech(spark):
    sound = "[" + "a very long sound " * 100 + "]"
    advert = "buy more " * 200 + "at www.some.org " + "and more " * 200
    texts = [f"1\n00:00:01,000 --> 00:00:02,000\nOne two.\n\n2\n{sound} three\n\n{advert}\nfour (never closed\n\nfive) six", "JOHN: hello\r\n{1}{2}you {y:i}there\n♪ la la ♪\n*knocks* come &amp; in"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.w for r in docs.select("doc_id", F.regexp_extract_all(reading_level.speech(F.col("text")), F.lit(r"\p{L}+"), 0).alias("w")).collect()}
    assert got == {0: ["one", "two", "three", "four", "never", "closed", "five", "six"], 1: ["hello", "you", "there", "come", "in"]}


def test_levels_have_converged_and_do_not_depend_on_the_join(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "read_labels"))
    graded = labels.filter("read_level is not null").groupBy("doc_id").agg(F.avg("read_level").alias("grade"))

    def levels(tolerance, **kw):
        out, steps = reading_level.harmonic(reading_level.Graph(docs, **kw), graded, 3.0, tolerance)
        return {r.doc_id: r.v for r in out.collect()}, steps

    (want, n), (tight, m), (shuffled, _) = levels(1e-4), levels(1e-6), levels(1e-4, broadcast_words=200)
    assert n < m < 40 and len(want) > 80
    for other in (tight, shuffled):
        assert want.keys() == other.keys() and max(abs(want[k] - other[k]) for k in want) < 0.01


def test_release_drops_the_tables_of_edges(spark):
    from tidemill.sources import tables

    reading_level.Graph(spark.read.parquet(f"{DATA}/documents.parquet"))
    names = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith(("edges_", "counts_"))]
    assert names()
    tables.release(spark)
    assert names() == []


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_queries_run(spark, name):
    assert llm.QUERIES[name](spark, DATA).count() > 0
