"""Pair-index BPE, token alignment and whitening against the libraries, plain versions and exact arithmetic."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import alignment, batches, bpe, pair_bpe, whitening
from tallyloom.llm.queries import op11_pair_bpe, op12_alignment, op13_whitening

SF = "/root/testdata/sf0.001"
WORDS, BYTES, PIECES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n  x", "a  b\t c d\x1c e\x85f", "don't IT'S we'll '''s", "naïve 日本語 👩‍👩‍👧 नमस्ते", "<|endoftext|> x<|startoftext|>y <| |>", "İstanbul ǅ ſ ß ΣΑΣ ŉ", "x" * 30_000, "1234 56.78", "é ö  ́", "\x00﻿", "Ⅷ ² ½",
    "a▁b c", "<s> </s> <unk> <0x41>", "aaaa aaaaa aaa hahahaha", "a\r b\r\n c", "   　 x y ", "ends in space ", " ", "word " * 3000,
]
ALPHABET = st.one_of(st.sampled_from(list("aAbeEthsS'.,!0 1\n\t<|>")), st.characters(exclude_categories=["Cs"]))


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(100_000 + k, t) for k, t in enumerate(ODD)]


def frame(spark, rows):
    """Documents with columns whose names are those of results."""
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids_sha256 string")


# ---- BPE by pair index


def library():
    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return t


def digest_of(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    back = lib.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_pair_bpe_gives_the_library_s_ids(spark, texts):
    lib = library()
    out = pair_bpe.round_trip_digest(frame(spark, texts), WORDS)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == {i: digest_of(lib, t) for i, t in texts}
    small = pair_bpe.round_trip_digest(frame(spark, texts), WORDS, portion=1000)
    assert small.exceptAll(out).count() == 0, "portions change nothing"


def test_op11_is_the_library_on_a_table(spark):
    lib, docs = library(), spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_pair_bpe(spark, SF).collect()} == {r.doc_id: digest_of(lib, r.text) for r in docs}


def test_pair_bpe_frames(spark, texts):
    lib = library()
    docs = frame(spark, texts).withColumn("ids", F.lit("clash"))
    out = pair_bpe.decode_ids(pair_bpe.encode_texts(docs, WORDS), WORDS)
    for r in out.collect():
        e = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == e and r.decoded == lib.decode(e, skip_special_tokens=False)
    odd = spark.createDataFrame([(None,), ([],), ([262, None, 10**6, -1],)], "ids array<int>")
    assert [r.decoded for r in pair_bpe.decode_ids(odd, WORDS).collect()] == ["", "", lib.decode([262], skip_special_tokens=False)]
    twice = pair_bpe.round_trip_digest(frame(spark, [(1, "a b"), (1, "a b"), (None, "a b")]), WORDS)
    assert twice.count() == 3 and twice.select("ids_sha256").distinct().count() == 1
    assert pair_bpe.round_trip_digest(frame(spark, [(1, "a")]).limit(0), WORDS).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return pair_bpe.PairEncoder(open(WORDS, encoding="utf-8").read(), remembered=500)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60), max_size=6))
def test_pair_encoder_on_any_texts(encoder, some):
    lib = library()
    got = encoder.encode_all(pa.array(some, pa.string()))
    assert [g.tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in some]


def test_lower_case_of_plain_letters():
    letters = [chr(c) for c in range(0x180) if not pair_bpe.pc.match_substring_regex(pa.array([chr(c)]), pair_bpe._OTHER)[0].as_py()]
    assert pair_bpe.pc.utf8_lower(pa.array(letters)).to_pylist() == [x.lower() for x in letters]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8))
def test_pair_index_merges_as_one_by_one(words, picks):
    """Random vocabularies, each merge of two earlier symbols, against merging the leftmost pair of the least rank again and again."""
    symbols, merges = ["a", "b"], []
    for x, y in picks:
        pair = (symbols[x % len(symbols)], symbols[y % len(symbols)])
        if pair[0] + pair[1] not in symbols:
            merges.append(pair)
            symbols.append(pair[0] + pair[1])
    vocab = {s: k for k, s in enumerate(symbols)}
    ids, counts = pair_bpe.PairIndex(vocab, merges).encode([w.encode() for w in words])
    rank, wanted = {m: k for k, m in enumerate(merges)}, []
    for w in words:
        parts = list(w)
        while len(parts) > 1:
            best, at = min((rank.get(p, 99), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 99:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        wanted.append([vocab[p] for p in parts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == wanted


def test_pair_index_refuses_what_it_cannot_order():
    with pytest.raises(ValueError, match="later merge"):
        pair_bpe.PairIndex({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")])


# ---- alignment


class Sides:
    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        byte = {c: k for k, c in enumerate(bpe.byte_characters())}
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}

    def piece(self, i):
        shown = self.b.id_to_piece(i)
        return bytes([int(shown[3:5], 16)]) if self.b.is_byte(i) else shown.replace("▁", " ").encode()

    def align(self, text):
        """Numbers, groups as text, and links of one text, pair by pair."""
        if not text:
            return (0, 0, 0, 0), "", []
        ia, ib = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        ba, bb = [self.a_bytes[i] for i in ia], [self.piece(i) for i in ib]
        raw = (" " + text).encode()
        if b"".join(ba) != raw or b"".join(bb) != raw:
            return (0, 0, 0, 0), "", []
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, links, p, q = [], [], 0, 0
        place_b = {e: k + 1 for k, e in enumerate(eb)}
        for k, e in enumerate(ea):
            if e in place_b:
                groups.append(f"{','.join(map(str, ia[p : k + 1]))}|{','.join(map(str, ib[q : place_b[e]]))}")
                for x in range(p, k + 1):
                    for y in range(q, place_b[e]):
                        if max(ea[x] - len(ba[x]), eb[y] - len(bb[y])) < min(ea[x], eb[y]):
                            links.append((ia[x], ib[y]))
                p, q = k + 1, place_b[e]
        return (len(ia), len(ib), len(groups), len(links)), ";".join(groups), links


def plain_alignment(rows):
    sides = Sides()
    found = [(i, *sides.align(t)) for i, t in rows]
    count = Counter(pair for *_, links in found for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(
        ((i, *numbers, sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "") for i, numbers, groups, links in found), key=str
    )


def aligned(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def models():
    return open(BYTES, encoding="utf-8").read(), open(PIECES, "rb").read()


def test_op12_against_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert aligned(op12_alignment(spark, SF)) == plain_alignment(rows)


def test_alignment_of_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "repeated row"), (3, "repeated row"), (None, "repeated id")]
    docs = spark.createDataFrame([(i, t, 7, [1]) for i, t in rows], "doc_id long, text string, portion int, pairs array<int>").repartition(3)
    wanted = plain_alignment(rows)
    assert aligned(alignment.align_corpus(docs, *models())) == wanted
    assert aligned(alignment.align_corpus(docs, *models(), portion=50)) == wanted, "portions change nothing"
    assert alignment.align_corpus(docs.limit(0), *models()).count() == 0
    assert {x[1:7] for x in aligned(alignment.align_corpus(docs.filter("text is null or text = ''"), *models()))} == {(0, 0, 0, 0, 0, 0)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("aAbeth.,;(){}=0 1\n\r\t▁")), st.characters(exclude_categories=["Cs"])), max_size=50), max_size=5))
def test_aligner_on_any_texts(some):
    sides = Sides()
    aligner = alignment.load(*models())
    numbers, groups, keys = alignment.align_texts(aligner, pa.array(some, pa.string()))
    for k, t in enumerate(some):
        n, g, links = sides.align(t)
        assert (tuple(numbers[k].tolist()), groups[k].decode(), sorted(keys[k].tolist())) == (n, g, sorted(a * 32000 + b for a, b in links))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_union_find(links):
    sets = alignment.UnionFind(31)
    if links:
        sets.unite(*np.array(links).T)
    label = list(range(31))
    for _ in range(31):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sets.label.tolist() == label


def test_decimal_texts():
    text, ends = batches.decimal_text(np.array([0, 7, 10, 49_407]), np.frombuffer(b",;|,", dtype=np.uint8))
    assert text == b"0,7;10|49407," and ends.tolist() == [2, 4, 7, 13] and batches.decimal_text(np.array([], dtype=np.int64), np.array([], dtype=np.uint8))[0] == b""


# ---- whitening


def exact(rows):
    """Exact integers of the fit list and the exact covariance."""
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, size = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(size)]
    covariance = [[sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in fit) / Fraction(n) ** 3 for b in range(size)] for a in range(size)]
    return x, n, sums, covariance


def check(out, rows, most=4, close=1e-9):
    x, n, sums, covariance = exact(rows)
    values, vectors = np.linalg.eigh(np.array(covariance, dtype=float))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(covariance[d][d] for d in range(len(sums))))
    got = {(r.vec_id, r.component): r for r in out}
    k = min(most, len(sums))
    assert set(got) == {(i, c) for i in x for c in range(1, k + 1)}
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in x])
        theirs = np.array([[Fraction(n * v - s, n) for v, s in zip(x[i], sums, strict=True)] for i in x], dtype=float) @ vectors[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < close * max(1, np.abs(theirs).max())
    for (i, c), r in got.items():
        assert r.n == n and r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[i], sums, strict=True))
        assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-9) and r.identity_error < 1e-9


def test_op13_against_exact_arithmetic(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    narrow = [(i, v[:6]) for i, v in rows]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in narrow], "vec_id long, embedding array<float>").repartition(5)
    check(whitening.whiten(df).collect(), narrow)
    out = op13_whitening(spark, SF).collect()
    white = defaultdict(dict)
    for r in out:
        white[r.vec_id][r.component] = r.whitened
    assert len(out) == 4 * len(rows) and max(r.identity_error for r in out) < 1e-10
    fit = {tuple(np.floor(256 * np.array(v, dtype=float))): i for i, v in rows}
    w = np.array([[white[i][c] for c in range(1, 5)] for i in fit.values()])
    assert np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-10


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [k * 0.5, (k * k % 7) - 3.0, -k / 3]) for k in range(12)] + [(3, [1.5, -1.0, -1.0]), (None, [9.0, 9.0, -0.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0]), (105, [-inf, 0.0, 1.0]), (106, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, n int, component string")
    out = whitening.whiten(df).collect()
    assert len(out) == 3 * len(rows) and {r.vec_id for r in out} == {i for i, _ in rows}
    keyed = [(k, v) for k, (_, v) in enumerate(rows)]
    renamed = spark.createDataFrame([(k, v) for k, v in keyed], "vec_id long, embedding array<double>")
    check(whitening.whiten(renamed).collect(), keyed)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id > 99")).count() == 2
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 0.0]) for k in range(5)], "vec_id long, embedding array<double>")).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: r.component)] == [False] * 5 + [True] * 5 and flat[0].identity_error < 1e-12
    huge = whitening.whiten(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [3e15, 0.5])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in huge} == {147456, None} and all(abs(r.whitened) < 2 for r in huge if r.component == 1)


def test_covariance_keeps_what_doubles_lose(spark):
    """Entries far from zero with small differences: sums of squares in doubles lose all of it."""
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (400, 5)) + 2**52
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(7)
    n, sums = whitening.exact_sums(df, 5)
    assert (n, sums) == (400, [int(s) for s in x.astype(object).sum(axis=0)])
    high, low = (np.array(p) for p in zip(*(whitening.parts(Fraction(s, n)) for s in sums), strict=True))
    a, b = whitening.covariance(df, 5, n, lambda batch: whitening.centred(whitening._rows(batch, "x", 5), high, low))
    shift = (x - 2**52).astype(object)
    s = shift.sum(axis=0)
    for i in range(5):
        for j in range(5):
            wanted = Fraction(int(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in shift)), n**3)
            assert abs(Fraction(float(a[i, j])) + Fraction(float(b[i, j])) - wanted) < Fraction(1, 10**22)


@settings(max_examples=300, deadline=None)
@given(st.floats(-1e100, 1e100), st.floats(-1e100, 1e100))
def test_error_free_transformations(a, b):
    s, e = whitening.two_sum(np.float64(a), np.float64(b))
    assert Fraction(float(s)) + Fraction(float(e)) == Fraction(a) + Fraction(b)
    if a and b and abs(a * b) > 1e-200:
        p, e = whitening.two_product(np.float64(a), np.float64(b))
        assert Fraction(float(p)) + Fraction(float(e)) == Fraction(a) * Fraction(b)


def test_principal_of_close_eigenvalues():
    """Two eigenvalues 1e-9 apart: the corrected vectors are the constructed ones to double precision, which LAPACK's alone aren't."""
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal beyond doubles
        q = q @ (1.5 * np.eye(12) - 0.5 * (q.T @ q))
    values = np.array([9, 8, 8 - 1e-9, 7, 6, 5, 4, 3, 2, 1, 0.5, 0.25], dtype=np.longdouble)
    m = (q * values) @ q.T
    high = m.astype(float)
    e, v = whitening.principal(high, (m - high).astype(float), 4)
    assert np.allclose(values[:4].astype(float), e, rtol=1e-15)
    off = lambda x: max(1 - abs(float(x[:, k] @ q[:, k])) + float(np.abs(x[:, k] - np.sign(float(x[:, k] @ q[:, k])) * q[:, k]).max()) for k in range(4))
    assert off(v) < 1e-9 and off(v) < off(np.linalg.eigh(high)[1][:, ::-1]) / 10
