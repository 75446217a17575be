import json
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import language_id, toxicity, url_filter
from tallyloom.llm.queries import URL_RULES, held_out, op8_toxicity, op9_language_id, page_evidence, page_language, url_redirects

from . import plain

SF = "/root/testdata/sf0.001"


def judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


URLS = [
    "http://A.Example.ORG/es/1?q#f", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/de/a", "http://x.com/it/", "http://notorg/", "http://org", "nothing",
    None, "", "http://://", "ftp://x.net?y=/z", "http://x.net#://org/", "HTTP://ÄB.net/\n/p", "http://fakeexample.org/es/", "http://a.net/1", "http://b.net/1", "http://c.net/1", "http://d.net/1", "http://e.net/1?a=1&b=2",
]


def test_rules(spark):
    rows = [(k, u, "", "x") for k, u in enumerate(URLS)] + [(0, URLS[0], None, "x")]
    out = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, host string"), URL_RULES).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, fit = judge(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fit and fit[0], fit[1] if fit else "allow"), URLS[r.page_id]
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_blocks_spread_over_links(spark):
    pages = [
        (1, "http://a.net/1", '<link rel="canonical" href="https://b.net/1#top">'),
        (2, "http://b.net/1", '<meta http-equiv="refresh" content="0; url=http://x.com/de/9">'),
        (3, "http://c.net/1", "<LINK href='/2' class=k REL='canonical'>"),
        (4, "http://c.net/2", "<p>rel canonical refresh</p>"),
        (5, "http://d.net/1", '<link rel="stylesheet" href="http://x.com/de/1">'),
        (6, "http://f.net/1", '<link rel="canonical" href="//x.com/de/7">'),
        (7, "http://g.net/1", '<link rel="canonical" href="http://f.net/1"><meta http-equiv=refresh content="5;url=http://q.org/">'),
        (8, "http://x.com/de/7", None),
        (9, "http://h.net/1", None),
    ]
    more = spark.createDataFrame([("http://h.net/1", "http://i.net/1"), ("http://i.net/1", "http://c.net/2"), ("http://c.net/1", "http://x.com/de/3"), (None, "http://x.com/de/3")], "alias string, target string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: (r.verdict, r.rule, r.component) for r in url_filter.judge_urls(df, URL_RULES, more).collect()}
    assert out[1][:2] == out[2][:2] == ("block", None) and out[1][2] == "a.net/1"
    assert [out[k][0] for k in (3, 4, 9)] == ["block"] * 3 and out[5] == ("allow", None, None)
    assert out[6][:2] == out[7][:2] == ("allow", None), "an explicit allow among the aliases goes before a block"
    assert out[8][:2] == ("block", "com/de/"), "a url's own rule stays"


def test_links_are_resolved_against_their_page(spark):
    base = "http://A.net/x/y/p.html?q=1"
    wanted = {
        "page2": "a.net/x/y/page2", "../z": "a.net/x/z", "./k/../m?n=1": "a.net/x/y/m?n=1", "?p=1": "a.net/x/y/p.html?p=1", "/top": "a.net/top", "//b.net": "b.net/", "https://C.net/u#f": "c.net/u",
        "../../../../r": "a.net/r", "..": "a.net/x/", "#f": None, "mailto:x@y.z": None, "k/": "a.net/x/y/k/",
    }
    rows = [(k, base, f'<p><link rel="icon" href="/i"><link data-a="b" rel=canonical href="{x}" /></p>') for k, x in enumerate(wanted)]
    links = url_filter.page_links(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(str(r[0]) for r in links.select(url_filter.url_node(F.col("target"))).collect()) == sorted(map(str, wanted.values()))


def test_all_links_of_a_page_count(spark):
    html = '<link rel="canonical" href="/a"><link rel="canonical" href="b"><meta http-equiv="refresh" content="0;URL=/c"><meta http-equiv="refresh" content="5"><meta http-equiv="refresh" content="1.5, url=\'d\'">'
    links = url_filter.page_links(spark.createDataFrame([("http://h.net/", html)], "url string, html string"))
    assert sorted(r.target for r in links.collect()) == [f"http://h.net/{x}" for x in "abcd"]


def test_long_broken_tags_take_linear_time(spark):
    rows = [("http://h.net/", "canonical refresh " + x) for x in ("<link " * 100_000, "<link rel=canonical href=" + " " * 500_000, "<meta http-equiv=refresh content=" + " " * 500_000 + ">", "<link " + "rel= " * 100_000 + ">")]
    began = time.perf_counter()
    assert url_filter.page_links(spark.createDataFrame(rows, "url string, html string")).count() == 0
    assert time.perf_counter() - began < 20


def test_redirects_spread_verdicts(spark):
    out = url_redirects(spark, SF).collect()
    assert len(out) == 50 and sum(r.component is not None for r in out) >= 48
    assert any(r.rule is None and r.verdict == "block" for r in url_redirects(spark, "/root/testdata/sf0.01").collect())


def test_fold_and_exceptions():
    assert toxicity.fold("1D10T М0rоn — b@d!  ＦＯＯ x​y") == " idiot moron bad foo xy "
    assert toxicity.fold(None) == toxicity.fold("…") == "  "
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " clown": 2.0, " trash ": 1.0}, ("class clown", "trash can"))
    assert lexicon.matched(toxicity.fold("Idiot idiot, clowns; class clown; idiotic trash can trash")) == 9.0
    assert lexicon.score("") == lexicon.score(None) == lexicon.score("fine words") < 0.3 < lexicon.score("you idiot")
    assert toxicity.Lexicon({}, ()).score("idiot") < 0.3


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
    for _ in range(300):
        weights = {f" {word()}" + rng.choice([" ", ""]): rng.choice([1.0, 2.5]) for _ in range(rng.randint(0, 6))}
        exceptions = tuple(f"{word()} {word()}" for _ in range(rng.randint(0, 4)))
        text = toxicity.fold(" ".join(word() for _ in range(rng.randint(0, 30))))
        every = lambda t: [(k, k + len(t) - 1) for k in range(len(text)) if text.startswith(t, k)]  # noqa: E731, B023
        spared = [s for e in exceptions for s in every(f" {e} ")]
        wanted = sum(w for t, w in weights.items() for a, b in every(t) if not any(x <= a and b <= y for x, y in spared))
        assert abs(toxicity.Lexicon(weights, exceptions).matched(text) - wanted) < 1e-9


def test_long_texts_take_linear_time():
    lexicon = toxicity.Lexicon({" trash ": 1.0, " clown": 2.0}, ("trash can",))
    began = time.perf_counter()
    assert lexicon.matched(toxicity.fold("trash can clowns " * 60_000)) == 120_000  # a text of a megabyte
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("sf,recall", [("sf0.1", 0.9), ("sf0.01", 0.9)])
def test_toxicity_on_held_out_labels(spark, sf, recall):
    folder = f"/root/testdata/{sf}"
    out = op8_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    t = out.filter("held_out").join(labels, "doc_id").agg(F.count_if(F.expr("predicted = 1 and toxic = 1")).alias("tp"), F.count_if(F.expr("predicted = 1 and toxic = 0")).alias("fp"), F.count_if(F.expr("predicted = 0 and toxic = 1")).alias("fn")).first()
    assert t.tp / (t.tp + t.fp) > 0.9 and t.tp / (t.tp + t.fn) >= recall, t
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_terms_and_exceptions_are_learned(spark):
    rng = random.Random(1)
    plain_word = lambda: "w" + "".join(rng.choice("abcdefghij") for _ in range(3))
    rows, labels = [], []
    for k in range(900):
        kind = k % 9  # one toxic in nine; as many harmless ones with the word in a fixed phrase
        said = ["grumpf"] if kind == 0 else ["grumpf", "flower"] if kind in (1, 2) else []
        body = [plain_word() for _ in range(20)]
        at = rng.randrange(20)
        rows.append((k, " ".join([*body[:at], *said, *body[at:], *(["zonkers", "zonkest"] if kind == 0 else [])])))
        labels.append((k, 1, int(kind == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit_lexicon(docs, known, lift=1.5)
    assert "grumpf flower" in lexicon.exceptions
    scores = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, lexicon).collect()}
    assert all((scores[i] >= 0.3) == bool(y) for i, _, y in labels)
    assert lexicon.score("such a GRUMPF flower here") < 0.3 < lexicon.score("z0nkers z0nkest")


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_lexicon(docs, x, ~held_out()) for x in (labels, turned))
    assert a.weights == b.weights and (a.bias, a.total, a.density) == (b.bias, b.total, b.density)


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "you idiot", 6), (2, "", 7), (2, "x" * 200_000 + " moron", 8)], "doc_id long, text string, toxicity int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit_lexicon(docs, none).weights == {}
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " moron ": 3.0})
    out = toxicity.score_toxicity(docs, lexicon).collect()
    assert [r.toxicity > 0.3 for r in out] == [False, True, False, True]
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit_lexicon(docs, odd).weights == {}
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0


def test_language_of_documents_and_pages(spark):
    out = op9_language_id(spark, SF)
    docs = out.filter("doc_id is not null").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = docs.agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.count_if("rejected"), F.count("*")).first()
    assert r[0] > 0.97 and r[1] == 0 and r[2] == 200
    assert page_language(spark, SF).filter("language = 'und' or rejected").count() == 0
    assert out.filter("page_id is not null").count() == 50


def test_declarations_withheld_from_the_judged_rows(spark):
    """Half of the rows lose their declaration, so neither the fit nor the evidence holds it; theirs are then judged."""
    folder = "/root/testdata/sf0.01"
    hidden = lambda c: F.pmod(F.xxhash64(c), F.lit(2)) == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("truth", F.col("lang")).withColumn("lang", F.when(~hidden("doc_id"), F.col("lang")))
    out = language_id.identify(docs, host=F.col("source")).filter(hidden("doc_id"))
    r = out.agg(F.avg((F.col("language") == F.col("truth")).cast("int")), F.count("*")).first()
    assert r[0] > 0.97 and r[1] > 400
    pages = page_evidence(spark.read.parquet(f"{folder}/pages.parquet")).withColumn("truth", F.col("lang")).withColumn("lang", F.when(~hidden("page_id"), F.col("lang")))
    out = language_id.identify(pages, host=F.col("host"), address=F.col("address")).filter(hidden("page_id"))
    r = out.agg(F.avg((F.col("language") == F.col("truth")).cast("int")), F.count("*")).first()
    assert r[0] > 0.95 and r[1] > 100
    # without any text, suffix and host alone decide
    bare = pages.withColumn("text", F.when(hidden("page_id"), F.lit("x")).otherwise(F.col("text")))
    out = language_id.identify(bare, host=F.col("host"), address=F.col("address")).filter(hidden("page_id"))
    assert out.agg(F.avg((F.col("language") == F.col("truth")).cast("int"))).first()[0] > 0.9


def test_posterior_against_plain_bayes(spark):
    folder = "/root/testdata/sf0.001"
    pages = page_evidence(spark.read.parquet(f"{folder}/pages.parquet")).withColumn("lang", F.when(F.col("page_id") % 3 != 0, F.col("lang"))).withColumn("text", F.left("text", F.lit(40))).collect()
    df = spark.createDataFrame(pages)
    got = {r.page_id: r for r in language_id.identify(df, host=F.col("host"), address=F.col("address"), strange=1e9).collect()}
    langs, n = language_id.LANGUAGES, len(language_id.LANGUAGES)
    declared = {p.page_id: p.lang if p.lang in langs else None for p in pages}
    counts = {x: Counter() for x in langs}
    for p in pages:
        if declared[p.page_id]:
            counts[declared[p.page_id]].update(language_id.trigrams(p.text).tolist())
    share = lambda x, t: (counts[x][t] + 0.1) / (sum(counts[x].values()) + 0.1 * language_id.BUCKETS)

    def tally(key, wanted):
        return [sum(1 for p in pages if key(p.host) == wanted and declared[p.page_id] == x) for x in langs]

    domain, top = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    suffixes = sorted({p.address for p in pages if declared[p.page_id] and p.address})
    marks = {s: [sum(1 for p in pages if p.address == s and declared[p.page_id] == x) for x in langs] for s in suffixes}
    for p in pages:
        prior = [(k + 1) / (sum(tally(lambda h: 1, 1)) + n) for k in tally(lambda h: 1, 1)]
        for key in (top, domain, lambda h: h):
            own = tally(key, key(p.host))
            prior = [(k + 20 * a) / (sum(own) + 20) for k, a in zip(own, prior, strict=True)]
        grams = language_id.trigrams(p.text).tolist()
        mass = []
        for k, x in enumerate(langs):
            log = math.log(prior[k]) + min(len(grams), 60) * sum(math.log(share(x, t)) for t in grams) / len(grams)
            if declared[p.page_id]:
                log += math.log(0.9 if declared[p.page_id] == x else 0.1 / (n - 1))
            if p.address in marks:
                log += math.log((marks[p.address][k] + 1) / (sum(m[k] for m in marks.values()) + len(suffixes) + 1))
            mass.append(log)
        mass = [math.exp(v - max(mass)) for v in mass]
        best = max(range(n), key=mass.__getitem__)
        assert got[p.page_id].language == langs[best] and abs(got[p.page_id].posterior - mass[best] / sum(mass)) < 1e-3


def test_pages_of_odd_kinds(spark):
    rows = [(1, None, None), (2, "http://x.de/de/1", ""), (2, "http://x.de/de/1", ""), (None, "nothing", "<html lang=fr>le la les des une dans pour que avec sur est pas</html>"), (3, "http://x.fr/", "<html " + "a" * 100_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, language string")
    out = language_id.identify(page_evidence(pages), host=F.col("host"), address=F.col("address")).collect()
    assert len(out) == 5 and {r.language for r in out if r.page_id is None} == {"fr"} and all(r.rejected for r in out if r.page_id in (1, 2))
    assert language_id.identify(page_evidence(pages.limit(0)), host=F.col("host"), address=F.col("address")).count() == 0


def test_text_outweighs_a_wrong_declaration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 500")
    wrong = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "fr").otherwise(F.col("lang")))
    out = language_id.identify(wrong, host=F.col("source"))
    assert out.filter("doc_id % 10 = 0").agg(F.avg((F.col("language") == F.col("truth")).cast("int"))).first()[0] > 0.9


def test_language_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, language string, row string"
    rows = [(k, "der die das und nicht mit von dem ist auch " * 3, "de-AT", "h1", "x", "y") for k in range(30)] + [(k, "the of and to in that was his it with for " * 3, "EN", "h2", "x", "y") for k in range(30, 60)]
    rows += [(100, None, "de", None, "", ""), (101, "", None, "", "", ""), (102, "123 +-*/ 456", "en", "h2", "", ""), (103, "das ist nicht", None, None, "", ""), (103, "das ist nicht", None, None, "", ""), (104, "a" * 100_000, "tlh", "h3", "", ""), (None, "with that", "en", "h2", "", "")]
    out = language_id.identify(spark.createDataFrame(rows, schema), host=F.col("source"), strange=50.0)
    got = out.collect()
    assert len(got) == len(rows) and out.columns.count("language") == 1 and "row" in out.columns
    by = {r.doc_id: (r.language, r.rejected) for r in got}
    assert by[0] == ("de", False) and by[40] == ("en", False) and by[103] == ("de", False)
    assert by[100] == by[101] == by[102] == ("und", True)
    assert language_id.identify(spark.createDataFrame([], schema), host=F.col("source")).count() == 0
    bare = language_id.identify(spark.createDataFrame([(1, "text", None, None, "", ""), (2, None, None, None, "", "")], schema))
    assert [(r.language, r.rejected) for r in bare.orderBy("doc_id").collect()] == [("und", False), ("und", True)]


def test_host_priors_are_smoothed(spark):
    rows = [("a.x.de", "de")] * 50 + [("b.x.de", "en")] + [("c.y.fr", "fr")] * 3 + [(None, "en")] * 5
    out = language_id.host_priors(spark.createDataFrame(rows, "h string, l string"), F.col("h"), F.col("l"), language_id.LANGUAGES).collect()
    prior = {r.host: dict(zip(language_id.LANGUAGES, r.prior, strict=True)) for r in out}
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in prior.values())
    assert prior["a.x.de"]["de"] > prior["b.x.de"]["de"] > prior["c.y.fr"]["de"] > 0 and None in prior


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_url_filter", "op5_exact_dedup", "op6_embedding_dedup", "url_redirects", "near_copies", "sharding_law", "packing_law", "byte_bpe_round_trip"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    from tallyloom.llm.oracle import ORACLE_SQL
    from tallyloom.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})")
    assert sorted(map(json.dumps, map(list, cursor.fetchall()))) == sorted(json.dumps([r[c] for c in columns]) for r in df.collect())


def test_plain_versions_agree_with_themselves():
    assert plain.components([1, 2, 3], [(2, 3)]) == {1: 1, 2: 2, 3: 2}
