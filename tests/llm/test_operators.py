"""Each operator on odd rows and on the smallest tables, beside plain versions of it."""

import hashlib
import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tests.llm import brute
from tripscope.llm import exact_dedup, license_rules, licenses, near_dup, packing, quality_rules, rans, sentencepiece_viterbi, sharding, suffix_dedup, tokens, toxicity
from tripscope.llm.components import components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="generated tables not present")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, rep string, key string"
PASSAGE = " ".join(f"word{i} of the shared passage" for i in range(20))
LONG = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
TEXTS = [
    None, "", "   \n ", "one", "Released under the MIT License.\nApache License, Version 2.0", "a a a a a a a a a a a a a a a a a a a a a a a a", PASSAGE, PASSAGE,
    "start " + PASSAGE + " end", LONG, LONG + " tail", "x" * 5000, "é😀漢字 " * 100, "THE\tquick  brown\r\nfox", "the quick brown fox <|endoftext|> \0 z",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    rows = [(i + 1, t, None, "s", len(t or ""), "i", "n", "r", "k") for i, t in enumerate(TEXTS)]
    rows += [(2**60 + 1, "last", "en", None, 4, None, None, None, None), (None, PASSAGE, None, None, None, None, None, None, None), (None, "alone without id", None, None, None, None, None, None, None)]
    rows += [rows[3], rows[3], (4, "same id, other text", None, None, 3, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# exact dedup ---------------------------------------------------------------------------------------------------------------------------


def test_exact_groups(odd):
    rows = pairs(odd)
    got = sorted((r["id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"], r["digest"]) for r in exact_dedup.exact_groups(odd, hash_all=True).collect())
    want = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i or -1, keep or -1, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_drop_copies_keeps_one_of_each(odd, none):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    kept = pairs(left)
    assert sorted((t or "") for _, t in kept) == sorted({(t or "") for _, t in pairs(odd)})
    assert dict((t or "", i) for i, t in kept)[PASSAGE] == 8
    assert exact_dedup.drop_copies(none).count() == 0 and exact_dedup.exact_groups(none).count() == 0


# near dedup ----------------------------------------------------------------------------------------------------------------------------


def test_components_of_links(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (9, 8), (8, 7), (7, 6), (6, 5), (10, 10)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(i, 1) for i in (1, 2, 3)] + [(i, 4) for i in (4, 5, 6, 7, 8, 9)]
    assert components(links.limit(0)).count() == 0


@needs_tables
@pytest.mark.parametrize(("words", "percent", "limit"), [(3, 85, 2048), (5, 80, 3)])
def test_near_components(small, monkeypatch, words, percent, limit):
    monkeypatch.setattr(near_dup, "NODE_LIMIT", limit)
    monkeypatch.setattr(near_dup, "CLUSTER_LIMIT", limit)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.components_of(small, words, percent).collect()}
    assert got == brute.near_components(pairs(small), words, percent)


def test_nodes_are_compared_whole_across_batches():
    rng = np.random.default_rng(3)
    rows = []
    for node, n in enumerate([2, 3, 1, 40, 8, 9, 2]):
        base = rng.integers(0, 2**32, near_dup.TOKENS, dtype=np.uint32)
        for i in range(n):
            sig = base.copy() if i % 3 else rng.integers(0, 2**32, near_dup.TOKENS, dtype=np.uint32)
            sig[: i % 3] += 1
            rows.append((node, 100 * node + i, sig.tobytes()))
    table = pd.DataFrame(rows, columns=["node", "rep", "payload"])
    whole = {}
    for node, group in table.groupby("node"):
        label = near_dup.loosely_linked(group["payload"].tolist(), 85)
        whole.update({r: (node, group["rep"].iloc[k]) for r, k in zip(group["rep"], label)})
    for step in (1, 3, 7, 100):
        batches = (table[i : i + step] for i in range(0, len(table), step))
        found = pd.concat(near_dup._compare_sorted(near_dup.loosely_linked, 85)(batches))
        lowest = {r: r for r in table["rep"]}
        for _ in range(50):
            for a, b in zip(found["root"], found["rep"]):
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
        assert {r: (r // 100, low) for r, low in lowest.items()} == whole


def _sets_of(kind, n):
    """``n`` sets: strangers that share a frequent passage, variants of one set, both and others, or their signatures."""
    rng, hot, base = np.random.default_rng(8), np.arange(1, 31), np.arange(1000, 1200)
    sets = []
    for i in range(n):
        own = rng.integers(10**6, 2**63, 200)
        if kind == "strangers" or i % 3 == 0:
            sets.append(np.concatenate([hot, own[: rng.integers(20, 80)]]))
        elif i % 3 == 1:
            sets.append(np.concatenate([np.delete(base, rng.integers(0, 200, rng.integers(0, 30))), own[: rng.integers(0, 20)]]))
        else:
            sets.append(np.concatenate([sets[rng.integers(0, i)], own[: rng.integers(0, 9)]]))
    return [np.unique(x.astype(np.uint64)) for x in sets]


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("n", [97, 600])
def test_prefixes_give_the_labels_of_all_pairs(monkeypatch, percent, n):
    sets = _sets_of("mixed", n)
    cases = [(near_dup.linked, [s.tobytes() for s in sets]), (near_dup.loosely_linked, [s.tobytes() for s in near_dup._signatures(sets)])]
    some = np.random.default_rng(n).random(n) < 0.3
    for compare, payload in cases:
        for seeds in (None, some, np.zeros(n, bool)):
            got = []
            for brute_force in (near_dup.BRUTE, n):
                monkeypatch.setattr(near_dup, "BRUTE", brute_force)
                got.append(compare(payload, percent, seeds).tolist())
            monkeypatch.undo()
            assert got[0] == got[1]
            assert (len(set(got[0])) < n) == (seeds is not None and seeds.any() or seeds is None)


def test_strangers_with_a_common_passage_are_not_compared_pair_by_pair(monkeypatch):
    n, pairs_held = 1500, []
    for name in ("_search", "_search_prefixes"):
        search = getattr(near_dup, name, None)
        if search is not None:
            counted = lambda n, alike, *rest, search=search: search(n, lambda at, others: pairs_held.append(len(others)) or alike(at, others), *rest)
            monkeypatch.setattr(near_dup, name, counted)
    sets = _sets_of("strangers", n)
    assert near_dup.linked([s.tobytes() for s in sets], 85).tolist() == list(range(n))
    near_dup.loosely_linked([s.tobytes() for s in near_dup._signatures(sets)], 85)
    assert sum(pairs_held) < n * n / 20


def test_stars_are_recognised_without_a_round(spark, monkeypatch):
    links = spark.createDataFrame([(1, 2), (3, 1), (7, 9)], "a long, b long")

    def no_round(*_):
        raise AssertionError("one more round")

    monkeypatch.setattr("tripscope.llm.components._star", no_round)
    assert sorted(map(tuple, components(links).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]


def test_near_odd_rows(odd, none):
    rows = near_dup.components_of(odd, 3, 85).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] != 4}
    assert [by_id[i]["component_id"] for i in (1, 2, 3, 7, 8, 10, 11, 2**60 + 1)] == [1, 2, 3, 7, 7, 10, 10, 2**60 + 1]
    assert by_id[1]["n_shingles"] == 0 and by_id[1]["kept"] and by_id[4 + 1]["kept"] and not by_id[8]["kept"]
    assert sorted(str(r["component_id"]) for r in rows if r["doc_id"] is None) == ["7", "None"]
    assert near_dup.components_of(none).count() == 0 and near_dup.drop_near_copies(odd).columns == odd.columns


def test_texts_under_one_id_are_apart(spark):
    """A repeated id with a unique and a near-copy text, with two near copies, and with texts that each have a copy elsewhere."""
    words = {k: [f"{k}{i}" for i in range(200)] for k in "abcdef"}
    text = {k: " ".join(w) for k, w in words.items()}
    near = {k: " ".join([*w[:-1], "other"]) for k, w in words.items()}
    rows = [(1, text["a"]), (2, near["a"]), (2, text["b"]), (5, text["c"]), (5, near["c"]), (5, text["c"].upper()), (7, text["d"]), (7, text["e"]), (8, near["d"]), (9, near["e"]), (9, text["f"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = pairs(near_dup.drop_near_copies(df, 3, 85))
    assert len(left) == 6 and sorted(p for p in left if p[0] != 5) == sorted([(1, text["a"]), (2, text["b"]), (7, text["d"]), (7, text["e"]), (9, text["f"])])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.components_of(df, 3, 85).collect())
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (5, 5, True), (5, 5, False), (5, 5, False), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (9, 9, True)])


def test_a_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE_LIMIT", 8)
    monkeypatch.setattr(near_dup, "CLUSTER_LIMIT", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(n, " ".join(base[:-1] + [f"own{n}"])) for n in range(40)] + [(100 + n, " ".join(f"u{n}x{i}" for i in range(60))) for n in range(20)]
    got = near_dup.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {n: 0 if n < 40 else n for n, _ in rows}


def test_blocks_are_not_joined_into_few_tasks(spark, monkeypatch):
    """Small blocks of two large groups come from a task for each partition that has some, not from one task for all."""
    tasks, compare = spark.sparkContext.accumulator(0), near_dup._compare

    def counted(*args):
        fn, before = compare(*args), set()

        def run(group):
            import os

            from pyspark import TaskContext

            task = (os.getpid(), TaskContext.get().taskAttemptId())
            if task not in before:
                before.add(task)
                tasks.add(1)
            return fn(group)

        return run

    monkeypatch.setattr(near_dup, "_compare", counted)
    monkeypatch.setattr(near_dup, "CLUSTER_LIMIT", 4)
    rows = [(g * 1000 + n, " ".join([f"g{g}w{i}" for i in range(100)] + [f"own{n}"])) for g in range(2) for n in range(40)]
    got = near_dup.components_of(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["component_id"] for r in got} == {0, 1000}
    assert tasks.value > 3


# suffix dedup --------------------------------------------------------------------------------------------------------------------------


def check_repeats(df):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeats(df, 200).collect())
    assert got == sorted((i or -1, *rest) for i, *rest in brute.repeats(pairs(df), 200))


@needs_tables
def test_repeats_on_the_small_table(small):
    check_repeats(small)


def test_repeats_on_odd_rows(odd, none):
    check_repeats(odd.filter("length(text) < 10000 OR text IS NULL"))
    assert suffix_dedup.repeats(none).count() == 0


def test_cut_texts_are_whole_characters(odd):
    left = suffix_dedup.cut_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    by_id = {r["doc_id"]: r for r in left.collect()}
    assert by_id[7]["text"] == "" and by_id[7]["n_chars"] == 0 and by_id[9]["text"] == "start  end" and by_id[1]["text"] is None


# packing and tokens --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "kind"), [(tokens.BYTE_BPE, "byte"), (tokens.WORD_BPE, "word")])
def test_encoder_agrees_with_the_tokenizer(name, kind):
    own = tokens.encoder(tokens.vocabulary_path(name), kind, "I")
    for text in [t for t in TEXTS if t is not None] + ["  a", "a  b", "a \n b", "don't.  stop, now ", "a\x1cb c", "é áb", "İ STRASSE ΟΔΟΣ x's 12 3", "Word, word. WORD."]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text[:40]


def check_pieces(df):
    out = packing.pack(df).toPandas()
    own = tokens.encoder(tokens.vocabulary_path(tokens.BYTE_BPE), "byte", "I")
    assert out["length"].sum() == sum(len(own.encode(t or "")) // 4 + 1 for _, t in pairs(df))
    for _, piece in out.sort_values("offset").groupby("sequence_id"):
        assert piece["offset"].tolist() == [0, *np.cumsum(piece["length"])[:-1]]
        total = piece["length"].sum()
        assert total == 1024 or total & (total - 1) == 0
    return out


@needs_tables
def test_packing(small):
    out, own = check_pieces(small), tokens.encoder(tokens.vocabulary_path(tokens.BYTE_BPE), "byte", "I")
    texts = dict(pairs(small))
    for doc_id, piece in out.sort_values("start").groupby("doc_id"):
        assert b"".join(piece["ids"]) == own.encode(texts[doc_id] or "") + bytes(4)
        assert piece["start"].tolist() == [0, *np.cumsum(piece["length"])[:-1]] and (piece["doc_tokens"] == piece["length"].sum()).all()


def test_packing_odd_rows(odd, none):
    check_pieces(odd)
    assert packing.pack(none).count() == 0


def test_costs_are_balanced():
    lengths = np.random.default_rng(1).integers(1, 600, 4000)
    doc, start, length, seq, offset = packing.assign(lengths, 1024, 1.0, 1 / 256)
    assert np.bincount(doc, length).astype(int).tolist() == lengths.tolist()
    cost = np.bincount(seq, length + length * length / 256)[np.bincount(seq, length) == 1024]
    arrival = np.array_split(np.cumsum(lengths), 1)[0] // 1024
    plain = np.bincount(arrival, lengths + lengths * lengths / 256)[:-1]
    assert cost.std() < plain.std() / 2


# token files ---------------------------------------------------------------------------------------------------------------------------


def test_blocks_round_trip_and_notice_damage():
    rng = np.random.default_rng(3)
    for n, lanes in ((1, 4), (1000, 7), (100_000, 512)):
        ids = np.minimum(rng.geometric(0.01, n), 49_000).astype(np.uint16)
        table = rans.scaled(np.bincount(ids, minlength=1 << 16))
        raw = rans.encode_block(np.array([n]), ids, table, lanes)
        block = rans.Block(raw)
        assert (block.decode(table, table.symbols()) == ids).all()
        last = len(block.marks) - 1
        grid = np.concatenate([block.stretch(k, table, table.symbols()) for k in range(last + 1)])
        assert (grid[last * rans.CHECKPOINT :] == block.stretch(last, table, table.symbols())).all()
        with pytest.raises(ValueError):
            rans.Block(raw[:-9] + bytes([raw[-9] ^ 1]) + raw[-8:])
    assert len(raw) < 2 * n


def check_files(spark, df):
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rans.read(spark, rans.write(df)).collect()]
    own = tokens.encoder(tokens.vocabulary_path(tokens.WORD_BPE), "word", "I")
    want, start = [], 0
    for i, t in sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = own.encode(t or "") + np.uint32(1).tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(got, key=lambda r: r[1]) == want


@needs_tables
def test_token_files(spark, small):
    check_files(spark, small)


def test_token_files_odd_rows(spark, odd, none):
    check_files(spark, odd)
    assert rans.read(spark, rans.write(none)).count() == 0


# SentencePiece -------------------------------------------------------------------------------------------------------------------------


def plain_search(vocabulary, word):
    score = {vocabulary.pieces[i]: (s, i) for s, i in zip(vocabulary.scores, vocabulary.ids)}
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = []
        for begin in range(max(0, end - vocabulary.longest), end):
            part = word[begin:end]
            if part in score:
                options.append((best[begin][0] + score[part][0], best[begin][1] + [int(score[part][1])]))
            elif end - begin == 1:
                options.append((best[begin][0] + vocabulary.unknown, best[begin][1] + [vocabulary.byte_ids[b] for b in part.encode()]))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][1]


def test_viterbi_agrees_with_a_plain_search():
    own = sentencepiece_viterbi.encoder(tokens.vocabulary_path(sentencepiece_viterbi.PIECES))
    for text in [t for t in TEXTS if t is not None and len(t) < 6000] + ["  a", "a  b   c ", "    int main()", "naïve café"]:
        ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
        assert ids == [i for w in sentencepiece_viterbi.words_of(text) for i in plain_search(own.vocabulary, w)], text[:40]
        assert sentencepiece_viterbi.decode(own.vocabulary, np.array(ids, int)) == text


def sentencepiece_ids(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(sentencepiece_viterbi.PIECES))
    return [model.encode(t) for t in texts]


def test_merges_give_the_ids_of_sentencepiece(spark):
    texts = [t for t in TEXTS if t is not None and len(t) < 6000] + ["des les", "  a", "a  b   c ", " " * 37, "    int main()", "▁a▁▁b", "naïve café", "abcd" * 60 + "é漢" * 40, "a\tb\nc", "\0"]
    rows = sentencepiece_viterbi.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in sorted(rows)] == sentencepiece_ids(texts)


@needs_tables
def test_merges_give_the_ids_of_sentencepiece_on_the_small_table(small):
    rows = sentencepiece_viterbi.encode(small).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == sentencepiece_ids([r["text"] or "" for r in rows])


def test_viterbi_odd_rows(odd, none):
    rows = sentencepiece_viterbi.decoded(sentencepiece_viterbi.encode(odd)).collect()
    assert len(rows) == odd.count() and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert sentencepiece_viterbi.encode(none).count() == 0


# sharding ------------------------------------------------------------------------------------------------------------------------------


def check_shards(df, shards):
    rows = sharding.shard(df, shards).collect()
    assert len(rows) == df.count()
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    return rows


@needs_tables
def test_shards_are_as_even_as_can_be(small):
    import pyspark.sql.functions as F

    rows = check_shards(small, 8)
    texts = {r["doc_id"]: r for r in small.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    sizes, shard_of = {}, {}
    for r in rows:
        k = texts[r["id"]]["k"]
        sizes[k] = sizes.get(k, 0) + r["size"]
        assert shard_of.setdefault(k, r["shard"]) == r["shard"] and r["size"] == len((texts[r["id"]]["text"] or "").encode()) + 1

    def shards_for(capacity):
        n, held = 1, 0
        for k in sorted(sizes):
            if held + sizes[k] > capacity:
                n, held = n + 1, 0
            held += sizes[k]
        return n

    largest = max(sum(r["size"] for r in rows if r["shard"] == s) for s in range(8))
    assert shards_for(largest) <= 8 and (largest == max(sizes.values()) or shards_for(largest - 1) > 8)


@pytest.mark.parametrize("hot", [0.0, 0.146, 0.33])
def test_shards_beside_a_huge_group_are_near_equal(hot):
    rng = np.random.default_rng(9)
    for _ in range(20):
        sizes = rng.integers(1, 400, 500).tolist()
        if hot:
            sizes.insert(int(rng.integers(0, 500)), int(sum(sizes) * hot / (1 - hot)))
        ranges = sharding.Ranges([(i, 0, n, True) for i, n in enumerate(sizes)])
        capacity = sharding.smallest(ranges.surely, ranges.total, 8)
        ends = sharding.even_ends(ranges, capacity, 8)
        parts = np.diff([0, *ends])
        assert ends[-1] == ranges.total and parts.max() <= capacity and set(ends) <= set(ranges.ends)
        others = sorted(parts)[:-1] if hot else parts
        # Only the shards next to the huge group may be cut short.
        assert sorted(others)[2 if hot else 0] > 0.6 * sum(others) / len(others) and min(parts) > 0


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, f"text {i} " * 20) for i in range(400)] + [(1000 + i, "copied text " * 15) for i in range(200)]
    got = check_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8)
    assert len({r["shard"] for r in got if r["id"] >= 1000}) == 1 and {r["shard"] for r in got} == set(range(8))


def test_one_huge_text_among_many(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 2 = 0, repeat('copied ', 60), concat('text ', id)) AS text")
    got = check_shards(docs.repartition(4), 8)
    by_shard = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    others = sorted(by_shard)[:-1]
    assert len({r["shard"] for r in got if r["id"] % 2 == 0}) == 1 and sum(others) < 3000 * 12 and min(others[2:]) > 0.6 * sum(others) / 7


def test_shards_odd_rows(odd, none):
    rows = check_shards(odd, 3)
    assert len({r["shard"] for r in rows if r["id"] in (7, 8)}) == 1
    check_shards(odd.limit(1), 8)
    assert sharding.shard(none, 8).count() == 0


# quality -------------------------------------------------------------------------------------------------------------------------------


def test_measures_and_policies(odd, none):
    entries = quality_rules.apply_policies(quality_rules.ledger(odd))
    by_id = {r["doc_id"]: r for r in entries.collect()}
    assert by_id[1]["n_words"] == 0 and not by_id[1]["kept_base_v1"] and by_id[6]["n_repeat_words"] == 24 and by_id[14]["word_chars"] == 16
    for r in by_id.values():
        for p in quality_rules.POLICIES:
            assert r[f"kept_{p.name}_v{p.version}"] == (r["failed"] & quality_rules.mask_of(p.rules) == 0)
    assert quality_rules.ledger(none).count() == 0


def test_ablations(odd):
    entries = quality_rules.ledger(odd)
    masks = [r["failed"] for r in entries.collect()]
    for r in quality_rules.ablations(entries).collect():
        policy = next(p for p in quality_rules.POLICIES if (p.name, p.version) == (r["policy"], r["version"]))
        every, one = quality_rules.mask_of(policy.rules), quality_rules.mask_of((r["rule"],))
        assert (r["n_rejected"], r["n_failed"], r["n_alone"], r["n_without"]) == (
            sum(m & every != 0 for m in masks), sum(m & one != 0 for m in masks), sum(m & every == one for m in masks), sum(m & every & ~one != 0 for m in masks)
        )


# licences ------------------------------------------------------------------------------------------------------------------------------


def plain_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined, found = " ".join(words), []
    for label, keyword, priority, regex, base in licenses.rules():
        if keyword in joined:
            for m in re.finditer(f"(?<![^ ])(?:{regex})(?![^ ])", joined):
                start = joined[: m.start()].count(" ")
                found.append((start, start + m[0].count(" ") + 1, priority, label, base))
    kept = [d for d in found if d[4] or not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[0] - e[1], e[2], e[3], e[4]) < (d[0] - d[1], d[2], d[3], d[4]) for e in found)]
    return len(words), sorted(f[:4] for f in found), sorted(k[3] for k in kept)


LICENSED = [
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0\nsee https://www.apache.org/licenses/LICENSE-2.0",
    "Released under the MIT License, also UNDER the mit license; cc-by-nc, CC BY-NC-SA 4.0", "public-domain dedication and all rights reserved", "GPL-2.0-or-later or gpl v3, BSD 3-Clause license",
]


def test_scan_agrees_with_a_plain_one(spark, odd, none):
    rows = pairs(odd) + [(1000 + i, t) for i, t in enumerate(LICENSED)] + [(2000, " ".join(LICENSED * 300))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, found string")
    want = sorted((i or -1, *plain_scan(t)) for i, t in rows if i != 2000)
    got = [(r["id"] or -1, r["n_words"], sorted((d["start"], -d["longest"], d["priority"], d["label"]) for d in r["found"]), sorted(d["label"] for d in r["kept"])) for r in licenses.scan(df).collect() if r["id"] != 2000]
    assert sorted(got) == want
    assert licenses.scan(none).count() == 0


def test_every_keyword_passes_the_gate():
    gate = re.compile("|".join(license_rules.STEMS), re.I)
    for label, keyword, _, regex, _ in licenses.rules():
        assert gate.search(keyword) or gate.search(regex), (label, keyword)


# toxicity ------------------------------------------------------------------------------------------------------------------------------


def test_grammar_reads_clauses():
    grammar = toxicity.Grammar({}, {})
    kind = {k: i for i, k in enumerate(toxicity.KINDS)}
    assert grammar.matches("you are an idiot")[kind["aimed"]] > grammar.matches("an idiot")[kind["insult"]] > 0
    assert grammar.matches("you are not an idiot")[kind["negated"]] > 0 == grammar.matches("you are not an idiot")[kind["aimed"]]
    assert grammar.matches("he said idiot")[kind["reported"]] > 0 and grammar.matches("he said. idiot")[kind["insult"]] > 0
    assert grammar.matches("i will kill you")[kind["menace-after"]] > 0
    assert not grammar.matches("").any() and not grammar.matches(None).any() and not grammar.matches("quiet words").any()


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns
    assert toxicity.scored(none, toxicity.learn(none, labels.limit(0))).count() == 0


@needs_tables
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="generated tables not present")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.transducer_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) > 0.7 * len(toxic) and sum(r["predicted"] for r in clean) < 0.03 * len(clean)


# pipeline ------------------------------------------------------------------------------------------------------------------------------


@needs_tables
def test_pipeline_beside_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, None
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, SF)
        if name == "packing":
            break
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), out.schema)
        had, now = pairs(before), pairs(out)
        if name == "exact dedup":
            best = {}
            for i, t in had:
                best[t or ""] = max(best.get(t or "", i), i)
            assert sorted(i for i, _ in now) == sorted(best.values())
        if name == "near dedup":
            assert sorted(i for i, _ in now) == sorted(i for i, (_, _, kept) in brute.near_components(had, 5, 80).items() if kept)
        if name == "suffix dedup":
            want = {i: removed for i, _, removed, _, _ in brute.repeats(had, 200)}
            lost = {i: len((dict(had)[i] or "").encode()) - len((t or "").encode()) for i, t in now}
            assert all(want[i] <= lost[i] <= want[i] + 6 * (want[i] > 0) for i in want)
        rows = now
    assert out.agg({"length": "sum"}).first()[0] == sum(len(tokens.encoder(tokens.vocabulary_path(tokens.BYTE_BPE), "byte", "I").encode(t or "")) // 4 + 1 for _, t in rows)


def test_pipeline_odd_rows(spark, odd, none):
    labels_dir = SF
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, labels_dir)
    assert docs.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, labels_dir).count() == 0


def test_stages_keep_columns_whatever_their_names(spark):
    """Rows with every name that a stage might use inside come out with their values."""
    names = ["__digest", "__gone", "__gone_text", "__key", "__own", "__kept", "digest", "runs", "text_key", "id", "g", "d", "r"]
    near = " ".join(f"near{i}" for i in range(300))
    texts = ["alone " + LONG[:300], PASSAGE, PASSAGE, near, near + " more", None, "", "before " + LONG[:3000] + " after", "x " + LONG[:3000] + " y"]
    rows = [(i, t, len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    docs = docs.union(docs.filter("doc_id = 1"))
    kept = {}
    for stage in (exact_dedup.drop_copies, near_dup.drop_near_copies, suffix_dedup.cut_repeats):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        for r in got:
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
            assert r["n_chars"] == len(r["text"] or "")
        kept[stage.__name__] = sorted(r["doc_id"] for r in got)
    assert kept["drop_copies"] == [0, 2, 3, 4, 6, 7, 8] and kept["cut_repeats"] == [0, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert 3 in kept["drop_near_copies"] and 4 not in kept["drop_near_copies"]
