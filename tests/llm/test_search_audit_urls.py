"""Lexical search, filter audit and URL filters on odd rows and beside plain versions of them."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tripscope.llm import filter_audit, lexical_search, url_filter

# lexical search ------------------------------------------------------------------------------------------------------------------------

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def ranked(docs, items, k):
    """{item: [(doc_id, score)]} by scoring every document."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms(text))
    out = {}
    for i, ts in wanted.items():
        rows = []
        for d, c in held:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out[i] = [(None if null else d, -s) for s, null, d in sorted(rows)[:k]]
    return {i: r for i, r in out.items() if r}


def searched(spark, docs, items, k):
    pairs = lexical_search.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string, m long, item long, terms string").repartition(3))
    out = {}
    for r in sorted(lexical_search.search(index, pairs, k).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item"], []).append((r["id"], r["score"]))
        assert len(out[r["item"]]) == r["rank"]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "漢字", "ABC", "a1b2"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([1, 2, 5, 5, 5, 30, 30, 200]))) for _ in range(n)]
    texts += [None, "", " .,;\n", "w1-W2_w3", " ".join(["w0"] * 20_000), " ".join(f"long{i}" for i in range(3000))] + [texts[5]] * 80
    docs = [(i, t, 1, 2, "x") for i, t in enumerate(texts)]
    return docs + [docs[3], docs[3], (7, "same id, other w4 text", 1, 2, None), (None, "w1 w2", 1, 2, None), (None, texts[5], 1, 2, None)]


ITEMS = [(0, "w0 w1 w1 W2"), (1, "w3, w7; été"), (2, None), (3, ""), (4, "nowhere"), (5, "long7 long8 abc"), (None, "w2 漢字"), (1, "w9"), (6, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("k", [3, 50])
def test_search_ranks_as_scoring_every_document_does(spark, k):
    docs = corpus(1, 300)
    assert searched(spark, docs, ITEMS, k) == ranked([d[:2] for d in docs], ITEMS, k)


def test_search_with_small_blocks_sets_and_first_visits(spark, monkeypatch):
    """Many blocks per stratum, several sets of items, scores in slabs, joins without broadcast, and strata left out by their bound."""
    for name, value in {"BLOCK_DOCS": 3, "TERM_PAIRS": 8, "CELLS": 4, "BROADCAST_VISITS": 0, "BROADCAST_STRATA": 0, "FIRST_DOCS": 1}.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs = corpus(2, 120)
    assert searched(spark, docs, ITEMS, 2) == ranked([d[:2] for d in docs], ITEMS, 2)


def test_search_of_nothing(spark):
    assert searched(spark, [], ITEMS, 5) == {} and searched(spark, [(1, "", 0, 0, "")], ITEMS, 5) == {}
    assert searched(spark, corpus(3, 10), [], 5) == {}


def test_index_has_every_posting_once(spark):
    docs = corpus(4, 100)
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string, m long, item long, terms string"))
    found = Counter()
    for b in index.blocks.collect():
        for t, first, end in zip(b["terms"], b["run_of"], b["run_of"][1:]):
            for r in range(first, end):
                for p in b["postings"][b["run_start"][r] : b["run_start"][r + 1]]:
                    found[(b["ids"][p], bytes(t), b["run_tf"][r])] += 1
    assert found == Counter((d[0], t, n) for d in docs for t, n in Counter(terms(d[1])).items())


# filter audit --------------------------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    good, bad = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for i, text, part in docs:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", body)) > 5 * len(body),
            "D": bool(re.search("[#$%&*|]", body)), "E": i is not None and any(j is not None and j < i and (t or "") == body for j, t, _ in docs),
        }
        rows.append((part or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in bad))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


AUDITED = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def audited(spark, docs, labels):
    table = spark.createDataFrame([(*d, 1, 2, "n") for d in docs], "doc_id long, text string, source string, n int, mask int, part string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(filter_audit.mask_counts(filter_audit.failures(table), marks), "ABCDE").collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in AUDITED] for r in rows}


def test_audit_counts_as_applying_the_filters_does(spark):
    rng = random.Random(5)
    words = ["the", "of", "and", "X", "YZ", "tail#", "é", "word"] + [f"w{i}" for i in range(80)]
    texts = [rng.choice(["", "# "]) + " ".join(rng.choices(words, k=rng.choice([3, 40, 60, 200]))) for _ in range(60)]
    texts += [None, "", " \n\t", "A" * 5000, " ".join(f"u{i}" for i in range(30_000)), "é漢字 " * 100]
    docs = [(i, rng.choice(texts), rng.choice(["a", "b", "c", None])) for i in range(150)] + [(200 + i, texts[0], "a") for i in range(60)]
    docs += [docs[4], docs[4], (4, "same id, other text", "b"), (None, texts[0], "a"), (None, "alone", None), (None, "alone", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = audited(spark, docs, labels)
    assert len(got) == 600 * 4 and got == plain_audit(docs, labels)


def test_audit_of_nothing_and_without_labels(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "x", "s")], []) == plain_audit([(1, "x", "s")], [])


def test_paths_of_the_lattice():
    assert filter_audit.forward_counts(3) == [1, 1, 1, 2, 1, 2, 2, 6]
    assert filter_audit.backward_counts(3) == [6, 2, 2, 1, 2, 1, 1, 1]
    for n in range(1, 6):
        through = Counter()
        for _, _, state, f in filter_audit.order_steps("ABCDE"[:n]):
            through[state, f] += 1
        assert {(s, f): w for s, f, w in filter_audit.lattice_edges(n)} == through
    with pytest.raises(ValueError):
        filter_audit.audit(None, "ABCDEFGH")


# URL filters ---------------------------------------------------------------------------------------------------------------------------


def judged(spark, pages, labels, how=url_filter.Mining()):
    urls = spark.createDataFrame([(*p, "h", "a", "t", 1, "v") for p in pages], "page_id long, url string, html string, anchor string, tokens string, n int, verdict string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in url_filter.judge(urls, marks, how=how).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    for name, rows in (("pages", pages), ("labels", labels)):
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(con.execute(url_filter.sql_of(how)).fetchall(), key=key)
    return got


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://User@WWW.Example.COM:80/en/x?Q=1#f", "http://example.com/en/", "http://www.example.com/en/a", "http://notexample.com/en/",
    "http://a.www.example.com/en/12", "http://x.net/es/", "http://x.net/esx/", "http://net/fr/1", "http://com", "http://com/", "http://a.com?x/en/", "x://y://z.net/es/", "http://h/" + "seg/" * 3000,
    "http://ü.org/ä?k=1;j=2&k=3", "http://a.org/1\n2/3",
]


def test_fixed_rules_on_odd_urls(spark):
    got = judged(spark, list(enumerate(ODD_URLS)) + [(1, "http://x.net/es/"), (None, "http://x.net/es/"), (None, None)], [])
    by_id = {r[0]: r[1:5] for r in got if r[0] is not None and r[0] > 1}
    assert by_id[5] == ("user@www.example.com:80", "/en/x", None, "allow")
    assert by_id[6] == ("example.com", "/en/", "example.com/en/", "block")
    assert by_id[7][2:] == ("www.example.com/en/", "allow") and by_id[9][2:] == ("www.example.com/en/", "allow")
    assert by_id[8][2:] == ("com/", "allow") and by_id[10][2:] == ("net/es/", "block") and by_id[11][2:] == (None, "allow")
    assert by_id[12][2:] == ("net/fr/", "block") and by_id[13][2:] == (None, "allow") and by_id[14][2:] == ("com/", "allow")
    assert by_id[15] == ("a.com", "", None, "allow") and by_id[16] == ("y:", "//z.net/es/", None, "allow")
    assert len(got) == len(ODD_URLS) + 3


def test_rules_mined_from_labels(spark):
    """A planted combination, pills under a shop path, is blocked wherever it stands; neither of its tokens alone is."""
    rng = random.Random(6)
    pages, labels = [], []
    for i in range(1500):
        host, place = rng.choice(["pills", "maps", "news"]), rng.choice(["shop", "blog", "help"])
        pages.append((i, f"https://{rng.choice(['m.', 'www.', ''])}cheap-{host}.site.org/{place}/{i}?{rng.choice(['ref', 'page'])}=1"))
        if i % 2:
            bad = (host, place) == ("pills", "shop") or rng.random() < 0.05
            labels.append((i, 1, int(bad)))
    labels += [(1, None, None), (7000, 0, 1), (None, 0, 1)]
    pages += [pages[2], (None, pages[3][1]), (9001, "http://pills.shop.org/blog/"), (9002, "http://pills.other.org/shop/")]
    got = judged(spark, pages, labels)
    for r in got:
        if r[0] is None or r[0] < 1500:
            assert (r[4] == "block") == ("pills" in r[1] and r[2].startswith("/shop")), r
    verdicts = {r[0]: r[4] for r in got}
    assert verdicts[9001] == "allow" and verdicts[9002] == "block"
    assert {r[5] for r in got if r[4] == "block" and r[3] is None} <= {r[5] for r in got if r[5] and "host:pills" in r[5] and "path:shop" in r[5]}


def test_low_thresholds_and_shuffled_rules_agree_with_subsets_in_sql(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    rng = random.Random(8)
    pages = [(i, f"http://{rng.choice('abc')}.{rng.choice('de')}.org/{rng.choice('fgh')}/{rng.choice('ijk')}?{rng.choice('lm')}=1") for i in range(120)]
    labels = [(i, 1, int("f" in p[1][-8:] or rng.random() < 0.2)) for i, p in enumerate(pages) if i % 2]
    got = judged(spark, pages, labels, url_filter.Mining(min_count=4, confidence_percent=90, max_items=5))
    assert {r[4] for r in got} == {"allow", "block"}


def test_url_filter_of_nothing(spark):
    assert judged(spark, [], []) == []
    assert judged(spark, [], [(1, 0, 1)]) == []
