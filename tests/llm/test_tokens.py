import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import bpe, packing, sharding
from tallyloom.llm.queries import old_shard, op3_sharding

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n  x", "a  b\t c d\x1c e\x85f", "don't IT'S we'll", "naïve 日本語 👩‍👩‍👧 नमस्ते", "<|endoftext|> x<|startoftext|>", "İstanbul ǅ ſ ß", "x" * 70_000, "1234 56.78", "é ö  ́", "\x00﻿", "Ⅷ ² ½"]


def own_encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_the_pattern_is_the_tokenizers_one():
    assert bpe.PATTERN == P.PATTERN


def test_round_trip(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(1000 + k, t) for k, t in enumerate(ODD)]
    out = bpe.round_trip_digest(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, ids string"), RANKS).collect()
    enc, texts = own_encoding(), dict(docs)
    assert len(out) == len(docs)
    for r in out:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip_digest(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def test_round_trip_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "x"), (None, "a b", "x"), (3, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id int, text string, n_tokens string")
    out = bpe.round_trip_digest(docs, RANKS)
    none, some = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"a b").hexdigest()
    assert out.columns.count("n_tokens") == 1 and sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in out.collect()) == [(0, 0, none), (0, 2, some), (3, 0, none), (3, 2, some), (3, 2, some)]


MODEL = bpe.ByteBPE(bpe.tokenizer_json(bpe.read_ranks(RANKS)), remembered=500)
ENCODING = own_encoding()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.aAe1é \x1c\x85　日👩‍"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_as_tiktoken_does(text):
    ids = MODEL.encode(text)
    assert ids.tolist() == ENCODING.encode_ordinary(text)
    assert MODEL.decode_bytes(ids) == text.encode()
    first, end = MODEL.char_offsets(text, ids)
    at = MODEL.byte_offsets(ids)
    for k in range(len(ids)):
        part = text.encode()[at[k] : at[k + 1]]
        assert part in text[first[k] : end[k]].encode() and end[k] > first[k]


def test_encode_and_decode_columns(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    out = bpe.decode_ids(bpe.encode_texts(docs, RANKS, offsets=True), RANKS)
    for r in out.collect():
        assert bytes(r.decoded) == (r.text or "").encode() and len(r.ids) == len(r.starts) == len(r.ends)
    half = "日".encode()
    ids = MODEL.encode("日").tolist()
    if len(ids) > 1:
        assert MODEL.decode(ids[:1]) == half[: len(MODEL.table[ids[0]])].decode(errors="replace")


PIECES = packing.PieceEncoder(open(WORDS).read(), remembered=400)
PLAIN_TOKENIZER = Tokenizer.from_file(WORDS)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.aAtTsSmM1éÉ<|> \x1ćİſßǅ"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_are_those_of_whole_texts(text):
    assert PIECES.encode(text).tolist() == PLAIN_TOKENIZER.encode(text, add_special_tokens=False).ids


def least_cost(costs, total, window, inside):
    """Token by token: the least cost of any cuts at all, at costs[p] where a cut is natural and else at `inside`."""
    best = [0.0]
    for j in range(1, total + 1):
        cut = 0.0 if j == total else costs.get(j, inside)
        best.append(cut + min(best[i] + window - (j - i) for i in range(max(0, j - window), j)))
    return best[-1]


def spent(cuts, costs, total, window, inside):
    before, out = 0, 0.0
    for c in cuts:
        assert 0 < c - before <= window
        out += window - (c - before) + (0 if c == total else costs.get(c, inside))
        before = c
    assert before == total
    return out


@settings(max_examples=500, deadline=None)
@given(st.integers(1, 900), st.lists(st.tuples(st.integers(1, 899), st.sampled_from([0.0, 3.0])), max_size=40), st.integers(4, 60), st.sampled_from([0.0, 7.0, 100.0]))
def test_cuts_cost_least(total, places, window, inside):
    places = {p: min(c, inside) for p, c in places if p < total}
    at = np.array(sorted(places), dtype=np.int64)
    cost = np.array([places[p] for p in at.tolist()])
    cuts = packing.choose_cuts(at, cost, total, window, inside)
    assert spent(cuts, places, total, window, inside) == least_cost(places, total, window, inside)


def test_cuts_of_sparse_streams_cost_least():
    rng = np.random.default_rng(9)
    assert spent(packing.choose_cuts(np.array([100]), np.array([8.0]), 6144, 2048, 24.0), {100: 8.0}, 6144, 2048, 24.0) == 48
    for _ in range(60):
        total = int(rng.integers(500, 6000))  # spans of up to sixty windows
        places = {int(p): float(rng.choice([0.0, 8.0])) for p in rng.integers(1, total, rng.integers(0, 11))}
        at = np.array(sorted(places), dtype=np.int64)
        cuts = packing.choose_cuts(at, np.array([places[p] for p in at.tolist()]), total, 100, 24.0)
        assert spent(cuts, places, total, 100, 24.0) == least_cost(places, total, 100, 24.0)


def test_long_texts_without_sentences_take_little_padding(spark):
    rows = [(k, " ".join(f"word{(k * 7 + n) % 50}" for n in range(4500))) for k in range(40)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1), WORDS).toPandas()
    assert out.doc_id.dtype == "int32" and sorted(out.doc_id.unique()) == list(range(40))
    used = out.groupby("sequence_id").length.sum()
    full = used[(used & (used - 1)) != 0]
    assert (2048 - full).sum() < 0.01 * used.sum() and used.max() == 2048


def test_packing_takes_any_ids(spark):
    repeated = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (None, None)], "doc_id int, text string")
    out = packing.pack(repeated, WORDS, with_ids=True).collect()
    assert sum(r.length for r in out) == 10 and all(r.doc_tokens in (1, 3) for r in out)
    assert sum(r.length for r in out if r.doc_id == 5) == 6 and {r.doc_id for r in out} == {5, None}
    named = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    assert [r.doc_id for r in packing.pack(named, WORDS).collect()][0] == "x"


@pytest.mark.parametrize("stretch", [1 << 21, 5000])
def test_pieces_hold_each_token_once(spark, stretch):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(1000 + k, t, "x") for k, t in enumerate(ODD)] + [(None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    out = packing.pack(docs, WORDS, stretch=stretch, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text, _ in rows:
        ids = [*PLAIN_TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in got for x in r.ids] == ids
        for r in got:
            assert r.doc_tokens == len(ids) and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
    padding = total = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        n = sum(r.length for r in s)
        assert n <= 2048
        total += n
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding / (padding + total) < 0.03
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_flow_moves_no_more_than_it_must():
    for sizes, capacities in (([10, 50, 0, 3], [16, 16, 16, 15]), ([5, 5, 5], [15]), ([9], [3, 3, 3]), ([0, 0], [0, 0]), ([7, 1, 4, 4, 0], [4, 4, 4, 4])):
        flow = sharding.minimum_cost_flow(sizes, capacities)
        assert all(sum(v for (i, _), v in flow.items() if i == k) == s for k, s in enumerate(sizes))
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= c for k, c in enumerate(capacities))
        moved = sum(v for (i, j), v in flow.items() if i != j)
        assert moved == sum(max(0, s - (capacities[k] if k < len(capacities) else 0)) for k, s in enumerate(sizes))
    dear = sharding.minimum_cost_flow([4, 0], [0, 4], cost=lambda i, j: 5)
    assert dear == {(0, 1): 4}
    by_price = sharding.minimum_cost_flow([3, 3], [3, 3], cost=lambda i, j: [[2, 1], [1, 3]][i][j])
    assert by_price == {(0, 1): 3, (1, 0): 3}
    with pytest.raises(ValueError):
        sharding.minimum_cost_flow([5], [4])


def test_shards_of_equal_bytes(spark):
    folder = "/root/testdata/sf0.01"
    out = op3_sharding(spark, folder).toPandas()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(out.doc_id) == sorted(texts) and set(out.shard) == set(range(16)) and out.grown_shard.isna().all()
    for r in out.itertuples():
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.02 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    moved = out[out.shard != out.old_shard]["size"].sum()
    over = (out.groupby("old_shard")["size"].sum() - sizes.sum() / 16).clip(lower=0).sum()
    assert moved < 1.05 * over, "little more than what the full shards hold too much"


def test_sharding_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, source string, shard int"
    assert sharding.reshard(spark.createDataFrame([], schema), old_shard(), 16, 16).count() == 0
    out = sharding.reshard(spark.createDataFrame([(1, None, None, 9), (1, None, None, 9), (None, "é", "s", 9)], schema), old_shard(), 16, 3).collect()
    assert sorted((r.size, r.text_crc32) for r in out) == [(1, 0), (1, 0), (3, zlib.crc32("é".encode()))] and all(0 <= r.shard < 3 for r in out)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    old = F.when(F.col("doc_id") < 150, 0).otherwise(1)
    plan = sharding.plan_resharding(docs, old, 3, 2)
    sharding.rewrite_affected(docs, plan, old, f"file://{tmp_path}/out")
    assert plan.affected == [0, 1] and spark.read.parquet(f"file://{tmp_path}/out").count() == docs.count()


def test_rewritten_shards_hold_the_plan(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    some = docs.limit(40)
    docs = docs.union(some).union(some).union(spark.createDataFrame([(None, "no id", "a"), (None, "no id", "b"), (None, None, None)], docs.schema)).withColumn("slot", F.lit("clash"))
    docs.write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    old = F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 190, 1).otherwise(2)
    sizes = [r.b for r in sharding.reshard(docs, old, 3, 3).groupBy("old_shard").agg(F.sum("size").alias("b")).orderBy("old_shard").collect()]
    crc = lambda t: zlib.crc32((t or "").encode())
    for k, capacities in enumerate((None, [sizes[0], sizes[1] + 10_000, sizes[2] + 10_000], [sizes[0] - 20_000, sizes[1] + 30_000, sizes[2]])):
        plan = sharding.plan_resharding(docs, old, 3, 3, capacities=capacities)
        wanted = sharding.reshard(docs, old, 3, 3, capacities=capacities).collect()
        assert plan.affected == ([0, 1, 2], [], [0, 1])[k]
        out = sharding.resharded(docs, plan, old, f"file://{tmp_path}/{k}").collect()
        assert sorted((r.doc_id or -1, r.text or "", r.source or "", r.slot) for r in out) == sorted((r.doc_id or -1, r.text or "", r.source or "", r.slot) for r in docs.collect())
        assert sorted((r._shard, r.doc_id or -1, crc(r.text)) for r in out) == sorted((r.shard, r.doc_id or -1, r.text_crc32) for r in wanted)
        for shard in range(3):
            assert sorted(r.slot for r in wanted if r.shard == shard) == list(range(sum(r.shard == shard for r in wanted)))
    none = docs.limit(0)
    assert sharding.plan_resharding(none, old, 3, 3).affected == [] and sharding.reshard(none, old, 3, 3).count() == 0


def test_rows_alike_are_dealt(spark):
    docs = spark.createDataFrame([(7, "the same text again") for _ in range(3000)] + [(k, "x" * (k % 50)) for k in range(300)], "doc_id long, text string").repartition(4)
    out = sharding.reshard(docs, F.lit(0), 4, 4).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in out]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 60
