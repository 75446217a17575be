import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import blocks, embedding_dedup, exact_dedup, line_dedup, simhash
from tallyloom.llm.components import connected_components
from tallyloom.llm.scratch import running_totals

from . import plain

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, keep_id string, id string, fp string"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)


def sample(spark, n=120):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]


ODD = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b"), (1004, "ab"), (1005, "a  b"), (1006, "A b"), (1007, "x" * 50_000), (1008, "x" * 50_000 + " "), (1009, " "), (1010, "é " * 3000)]


@pytest.mark.parametrize("bits,least,most", [(64, 1024, 4096), (3, 4, 9)])
def test_exact_groups(spark, bits, least, most):
    rows = sample(spark) + ODD
    out = exact_dedup.exact_groups(frame(spark, rows), hash_bits=bits, least=least, most=most).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in out} == plain.exact(rows)
    assert len(out) == len(rows) and all(r.kept == (r.doc_id == r.keep_id) for r in out)


def test_exact_odd_tables(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    out = exact_dedup.exact_groups(frame(spark, [(None, "a"), (5, "a"), (5, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in out if r.keep_id) == [(False, 5, 3, True), (False, 5, 3, True), (True, 5, 3, False)]
    assert [(r.group_size, r.kept) for r in out if r.keep_id is None] == [(1, True)]


def test_simhash_groups(spark):
    rng = random.Random(3)
    rows = sample(spark) + ODD
    for k in range(60):
        words = rows[k % 7][1].split()
        words[rng.randrange(len(words))] = f"w{k}"
        rows.append((2000 + k, " ".join(words)))
    out = simhash.simhash_groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == plain.simhash(rows)


@pytest.mark.parametrize("bits", [2, 3, 5, 7])
def test_close_fingerprints_are_all_linked(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base[:4]:
        for _ in range(300):
            prints.add(b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(1, bits))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"), bits, block=64).collect()
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits
    wanted = plain.components(signed, [(a, b) for a in signed for b in signed if a < b and near(a, b)])
    assert plain.components(signed, [(r.a, r.b) for r in links]) == wanted


def test_keep_one_of_each(spark):
    text = "one two three four five six seven eight"
    docs = frame(spark, [(3, text), (2, text), (2, text), (None, text), (7, "other words here altogether now"), (None, "nameless text of five words"), (None, "nameless text of five words"), (8, None), (9, "")])
    kept = simhash.keep_one_of_each(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:8]) for r in kept) == [(False, 2, "one two "), (False, 7, "other wo"), (False, 8, ""), (True, 0, "nameless")]
    assert all(r.keep_id == "a" for r in kept) and simhash.keep_one_of_each(frame(spark, [])).count() == 0


def test_eight_tenths_of_five_word_shingles_decide(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(400)]
    changed = lambda *at: " ".join("new" if k in at else w for k, w in enumerate(words))
    # each change far from the others costs five shingles of 396: 8 changes leave (396 - 40) / (396 + 40) = 0.817, 9 leave 0.796
    rows = [(2, changed()), (5, changed(*range(20, 380, 45))), (6, changed(*range(20, 380, 40))), (7, None), (8, " "), (None, "no id at all here"), (None, "no  id at all here")]
    kept = simhash.keep_one_of_each(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 2, 6, 7] and all(r.keep_id == "a" for r in kept)

    # documents 1 and 177 agree to 0.83; 106 and 185 to 0.797
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id in (1, 177, 106, 185)")
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == [1, 106, 185]


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(4)
    rows = sample(spark, 80)
    for k in range(300):
        words = rows[k % 30][1].split()
        for _ in range(rng.randint(1, 1 + len(words) // 20)):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        rows.append((2000 + k, " ".join(words)))
    roots = plain.near_copies(rows)
    assert len(set(roots.values())) < 0.8 * len(rows)
    out = simhash.near_copy_groups(frame(spark, rows)).collect()
    assert {r.id: r.component_id for r in out} == roots


def test_pairs_that_no_segment_proposes_are_linked(spark):
    """Pairs at 0.8 and more whose fingerprints share no variant of a segment, beside a passage that all texts have."""
    rng = random.Random(9)

    def proposed(a, b):
        x, y = (simhash.wide_fingerprint(simhash.shingle_hashes(t, 3)) for t in (a, b))
        bits = "".join(f"{int(p) ^ int(q):064b}"[::-1] for p, q in zip(x, y, strict=True))
        segments = [bits[o : o + 16] for o in range(0, 128, 16)] + [bits[o::8] for o in (0, 2, 4, 6)]
        return min(s.count("1") for s in segments) <= 1 and bits.count("1") <= 30

    passage = [f"p{k}" for k in range(12)]
    rows, missed = [], 0
    for k in range(20_000):
        words = [f"w{rng.random()}" for _ in range(48)] + passage
        other = list(words)
        other[5], other[6], other[7] = "x", "y", "z"  # seven of 56 shingles: 49 / 63
        if k % 2:
            other[7] = words[7]  # six: 50 / 62 = 0.806
        if k % 2 and not proposed(" ".join(words), " ".join(other)) and missed < 5:
            missed += 1
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        elif k < 150:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if missed == 5 and k >= 150:
            break
    assert missed == 5
    assert {r.id: r.component_id for r in simhash.near_copy_groups(frame(spark, rows)).collect()} == plain.near_copies(rows)


def test_a_large_group_with_members_unlike_its_hub(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(900):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((k, " ".join(words)))
    assert {r.id: r.component_id for r in simhash.near_copy_groups(frame(spark, rows)).collect()} == plain.near_copies(rows)


def test_crowded_shingles_do_not_bring_whole_sets_again(spark, monkeypatch):
    """A passage that all texts have is crowded; the sketches' own further shingles take its place."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(9)]
    rows = [(k, " ".join([f"w{rng.random()}" for _ in range(90)] + passage)) for k in range(150)]
    cut, plainly = [], simhash.materialize

    def counted(df, label, keep=False):
        out = plainly(df, label, keep)
        if label == "shingles":
            cut.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    assert len({r.component_id for r in simhash.near_copy_groups(frame(spark, rows)).collect()}) == 150
    assert sum(cut) < 15, cut


def test_pairs_are_proposed_where_most_shingles_are_crowded(spark):
    """Texts of shared passages and few words of their own, each a group of its own: no pair at the threshold may be missing."""
    rng = random.Random(13)
    passages = [[f"p{n}-{k}" for k in range(n)] for n in (20, 60)]
    texts = []
    for k in range(160):
        words = [*passages[k % 2], *(f"w{rng.random()}" for _ in range(rng.choice([3, 12, 60])))]
        texts += [" ".join(words)] * (k % 3 == 0) + [" ".join([*words[:-1], "x"]), " ".join(["y", *words])]
    sets = [simhash.shingle_hashes(t, 5).view(np.int64) for t in dict.fromkeys(texts)]
    size = [int(simhash.head_length(len(s), 0.8)) for s in sets]
    lists = [np.sort(s)[: h + simhash.spare_length(h)].tolist() for s, h in zip(sets, size, strict=True)]
    sketches = spark.createDataFrame([(k, h, simhash.odd_bits(s).tolist()) for k, (h, s) in enumerate(zip(lists, sets, strict=True))], "row long, head array<long>, odd array<long>")
    nodes = [(k, 7 * k, k, k, len(s), size[k], len(lists[k])) for k, s in enumerate(sets)]
    nodes = spark.createDataFrame(nodes, "row long, node long, t long, group long, n long, size long, listed long")
    whole = spark.createDataFrame([(7 * k, s.tolist()) for k, s in enumerate(sets)], "node long, grams array<long>")
    asked = []

    def sets_of(members):
        asked.append(members.count())
        return whole.join(members.select("node"), "node", "left_semi")

    found = {(r.a, r.b) for r in simhash.other_candidates(sketches, nodes, sets_of, 0.8, crowd=16, block=32).collect()}
    held = [set(s.tolist()) for s in sets]
    true = {(i, j) for j in range(len(held)) for i in range(j) if len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j])}
    assert asked and 0 < asked[0] < len(sets) and len(true) > 500 and true <= found


def test_a_pair_at_the_threshold_is_proposed():
    rng = np.random.default_rng(5)
    hit = 0
    for _ in range(400):
        shared, own = rng.integers(0, 1 << 63, 160, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 20), dtype=np.uint64)
        a, b = (simhash.wide_fingerprint(np.unique(np.concatenate([shared, x]))) for x in own)
        bits = "".join(f"{int(x) ^ int(y):064b}"[::-1] for x, y in zip(a, b, strict=True))
        segments = [bits[o : o + 16] for o in range(0, 128, 16)] + [bits[o::8] for o in (0, 2, 4, 6)]
        hit += min(s.count("1") for s in segments) <= 1
    assert hit / 400 > 0.94


def test_embedding_groups(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 24))
    rows = [(k, (centres[k % 5] + rng.normal(size=24) * (0.1 if k % 3 else 0.5)).tolist()) for k in range(400)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [1.0, None] * 12), (1004, [float("nan")] * 24), (1005, [float("inf")] * 24), (1006, rows[0][1]), (1007, rows[0][1]), (1008, [1.0, 2.0]), (1009, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, good string")
    out = embedding_dedup.embedding_groups(df, block=32).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == plain.vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0
    assert embedding_dedup.embedding_groups(df.filter("vec_id = 1000")).collect()[0].n_links == 0


def test_vectors_with_null_and_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1]
    df = spark.createDataFrame([(None, a), (4, b), (4, b), (None, [0.0, 1.0, 0.0]), (9, [0.0, -1.0, 0.0]), (9, [0.5, 0.5, -2.0])], "vec_id long, embedding array<float>")
    out = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_groups(df).collect())
    assert out == [(-1, 0, None, True), (-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True), (9, 0, 9, True)]


def test_rounding_stays_within_its_bound():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 24, 64, 200):
        x = rng.normal(size=(500, width)) * rng.choice([0.01, 1, 30], size=(500, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q, bound = embedding_dedup.rounded(x)
        assert (np.linalg.norm(q * np.abs(x).max(axis=1, keepdims=True) / 127 - x, axis=1) <= bound + 1e-12).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(1, keepdims=True) * x
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * n
    a, b = (embedding_dedup.polytope_codes(v, 8, 3, 7) for v in (x, y))
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.99


def lines_fixture():
    rng = random.Random(11)
    sentence = lambda n: " ".join(rng.choice("abcdefghij") * 3 for _ in range(n))
    shared = [[sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    rows = []
    for i in range(40):
        out = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.6:
                run = rng.choice(shared)
                a = rng.randrange(len(run))
                out += run[a : a + rng.randint(1, 9)]
            out += [sentence(rng.randint(0, 20)) for _ in range(rng.randint(0, 2))]
        rows.append((i, "\n".join(out)))
    long = "\n".join(sentence(60) for _ in range(40))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, long), (104, "start\n" + long + "\nend"), (105, "\n".join(["same line of words"] * 60))]


def test_repeated_line_runs(spark):
    rows = lines_fixture()
    out = line_dedup.without_repeated_runs(frame(spark, rows), removed_col="gone").collect()
    assert {r.doc_id: r.gone for r in out} == plain.repeated_lines(rows)
    assert any(r.gone for r in out) and len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        kept = None if texts[r.doc_id] is None else "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in set(r.gone))
        assert r.text == kept and r.keep_id == "a"


def test_line_runs_odd_tables(spark):
    assert line_dedup.without_repeated_runs(frame(spark, [])).count() == 0
    line = " ".join(f"w{k}" for k in range(60))
    out = line_dedup.without_repeated_runs(frame(spark, [(1, line), (1, line), (None, line), (2, line + "\nmore")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, line), (1, ""), (1, ""), (2, "more")]
    clash = frame(spark, [(1, line), (2, line)]).toDF("doc_id", "text", "_gone", "d", "t")
    assert [(r.doc_id, r.text, r._gone, r.t) for r in line_dedup.without_repeated_runs(clash).orderBy("doc_id").collect()] == [(1, line, "a", "c"), (2, "", "a", "c")]


def test_repeated_rows_with_a_passage_of_many_lines(spark):
    passage = "\n".join(" ".join(f"w{k}{n}" for n in range(10)) for k in range(5))
    for ids in ((1, 1, 2), (1, 2, 2), (None, None, 2)):
        rows = [(i, f"start {i}\n{passage}\nend {i}") for i in ids]
        out = line_dedup.without_repeated_runs(frame(spark, rows), removed_col="gone").collect()
        first = [r for r in rows if r[0] == ids[0]]
        assert sorted((r.doc_id or 0, r.gone) for r in out) == [(i or 0, [] if (i, t) in first else [1, 2, 3, 4, 5]) for i, t in rows]


def test_suffix_ranks_are_ordered(spark):
    rows = lines_fixture()
    lines = line_dedup.document_lines(frame(spark, rows))
    ranks, lengths = line_dedup.suffix_ranks(lines, 50)
    got = {(r.d, r.i): r for r in ranks.collect()}
    assert lengths[:3] == [1, 2, 4]
    texts = {i: [x.strip() for x in t.split("\n")] for i, t in rows if t is not None}
    for k in lengths:
        by = {}
        for (d, i), r in got.items():
            if r[f"r{k}"]:
                by.setdefault(r[f"r{k}"], set()).add(tuple(texts[d][i : i + k]))
        assert all(len(v) == 1 for v in by.values())
        if k > 1:  # a longer prefix only refines the order
            pairs = sorted((r[f"r{k}"], r[f"r{k // 2}"]) for r in got.values() if r[f"r{k}"])
            assert [b for _, b in pairs] == sorted(b for _, b in pairs)


def test_components_of_stars_and_chains(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (1, 0), (0, 1), (None, 3)]
    out = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    good = [(a, b) for a, b in links if a is not None and a != b]
    assert {r.node: r.component for r in out} == plain.components({x for e in good for x in e}, good)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_thinned_links_have_the_same_components(spark, kind):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] * 4 + [(1000 + a, 1000 + b) for a in range(40) for b in range(40)] + [(None, 5), (5, 5)]
    df = spark.createDataFrame(links, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind)).repartition(8)
    good = [(int(a), int(b)) for a, b in links if a is not None and a != b]
    for portion in (100, 1_000_000):
        out = blocks.thinned(df, portion).collect()
        assert len(out) < len(good) and plain.components({x for e in good for x in e}, [(int(r.a), int(r.b)) for r in out]) == plain.components({x for e in good for x in e}, good)
    assert blocks.thinned(df.limit(0)).count() == 0


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randint(0, 9)) for k in range(3000)]
    out = running_totals(spark.createDataFrame(rows, "g int, k long, v long"), "g", [F.col("k")], ["v"], "t").collect()
    sums = {}
    for g, k, v in sorted(rows):
        sums[k] = sums.get(("at", g), 0)
        sums["at", g] = sums[k] + v
    assert all(r.v_before == sums[r.k] for r in out) and len(out) == 3000
