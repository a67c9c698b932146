"""Near duplicates by a chosen-path set similarity join (after Christiani, Pagh and Sivertsen, "Scalable and Robust Set Similarity
Join", 2018), and their connected components.

A document's set holds the 64-bit hashes of its word shingles. Minwise hashing turns the set into ``TOKENS`` tokens. Each of ``trees``
independent trees branches every set at its root into the nodes named by two of its tokens; two sets meet in a node when they share the
token. Nodes above ``NODE_LIMIT`` branch again by two further tokens, chosen by the node's name, down to ``DEPTH`` levels. The sets that
meet in a node are compared exhaustively, at last on their full shingle sets, so no false link arises. A pair at the threshold s misses a tree
with probability q(d) = (1 - s (1 - q(d-1)))^2, q(0) = 0: below 0.031 for s = 0.85 and below 0.06 for s = 0.8 at any depth, which four
trees turn into 1e-6 and six trees into 5e-8. A pair is also missed where fewer than 17 (s = 0.85) or 15 (s = 0.8) of its tokens agree: by the
binomial tail 3.5e-06 and 6.6e-06 at the threshold, the larger term.

What keeps it whole and bounded:

* Equal sets are one set with a number of its own (``rep``); a group of copies of any size costs one row. Document ids name sets nowhere
  before the end, when each component gets the smallest id in it.
* Sets that meet are first held against each other by their signatures of ``TOKENS`` tokens, which are small. Sets whose signatures agree
  nearly as often as those of linked sets form clusters; only these fetch their full sets, once and for clusters of all sizes, and are compared on them.
* Nodes and clusters are compared by breadth-first search: each step holds one set against those not reached yet and adds its links to
  the component, so a node of alike sets ends after few steps. It yields a forest of links, at most one per set, never its pairs.
  Of more than ``BRUTE`` sets, only those are held against each other that have one of their rarest tokens in common, as linked ones must:
  sets that merely meet in a frequent token cost no pairs. Full sets are compared only where bits of their most frequent tokens allow a link.
* A node above ``NODE_LIMIT`` at the last level, or a cluster above ``CLUSTER_LIMIT``, is cut into blocks that each also get its first
  set. What is not connected to that set after this is compared with every block in a second pass. No set is dropped.
* Nodes with the same members are compared once.

Defined cases: a null, empty or blank text has an empty set, links with nothing and is its own component; a text with fewer words than
a shingle is one shingle; rows without an id take the component of an equal set that has one, else null; rows that repeat an id are
treated as one document per text, each in the component of its own text (two components can then have the same smallest id), and one of
the texts that share a component and its smallest id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from tripscope.llm.common import documents, per_arrow_batch, per_batch, written
from tripscope.llm.components import components
from tripscope.plans.registry import Book

BOOK = Book()
TOKENS = 32
DEPTH = 3
NODE_LIMIT = 4096
CLUSTER_LIMIT = 2048
#: Nodes of at most this many sets are compared pair by pair, many nodes at once.
FEW = 8
#: Up to this many sets are held against each other without looking for common tokens first.
BRUTE = 96
#: Of so many tokens, the most frequent ones of a cluster, each set has a bit.
WIDE = 512
_RNG = np.random.default_rng(20190117)
_MUL = _RNG.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3, on 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased, words split at ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _STEP[i] + h[i : i + n])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Least hash of each set (none empty) under each function, all sets at once."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((len(sets), TOKENS), np.uint32)
    for i in range(TOKENS):
        low[:, i] = np.minimum.reduceat(flat * _MUL[i] + _ADD[i], starts) >> np.uint64(32)
    return low


def _describe(words: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, key, sig = [], [], []
        texts = batch.column("text").to_pylist()
        for at in range(0, len(texts), 500):
            sets = [shingle_set(t, words) for t in texts[at : at + 500]]
            low = iter(_signatures(some)) if (some := [s for s in sets if len(s)]) else iter(())
            for s in sets:
                n.append(len(s))
                key.append(blake2b(s.tobytes(), digest_size=16).hexdigest())
                sig.append(next(low).tobytes() if len(s) else None)
        arrays = [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(key, pa.string()), pa.array(sig, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_shingles", "set_key", "sig"])

    return fn


def _children(node: np.ndarray, sig: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the two nodes below ``node`` that a set goes to: by its tokens at two places."""
    rows = np.arange(len(node))
    return tuple(_mixed(_mixed(node * np.uint64(64) + place.astype(np.uint64)) + sig[rows, place].astype(np.uint64)) for place in (first, second))


def _tokens(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint32).reshape(len(col), TOKENS)


def _roots(trees: int):
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        sig, ids, nodes = _tokens(batch["sig"]), [], []
        for tree in range(trees):
            root = np.full(len(batch), tree + 1, np.uint64)
            a, b = (np.full(len(batch), (2 * tree + i) % TOKENS) for i in (0, 1))
            for child in _children(root, sig, a, b):
                nodes.append(child)
                ids.append(batch["rep"].to_numpy())
        return pd.DataFrame({"rep": np.concatenate(ids), "node": np.concatenate(nodes).view(np.int64)})

    return fn


def _branches(batch: pd.DataFrame) -> pd.DataFrame:
    node, sig = batch["node"].to_numpy().view(np.uint64), _tokens(batch["sig"])
    a = (_mixed(node) % np.uint64(TOKENS)).astype(np.int64)
    b = (a + 1 + (_mixed(node + np.uint64(1)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
    below = _children(node, sig, a, b)
    return pd.DataFrame({"rep": np.tile(batch["rep"].to_numpy(), 2), "node": np.concatenate(below).view(np.int64)})


def _meeting(reps: DataFrame, trees: int) -> DataFrame:
    """(rep, node, size) of the nodes in which two or more sets are to be compared."""
    level = written(per_batch(reps.select("rep", "sig"), _roots(trees), "rep long, node long"), "roots")
    parts = []
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("members")).filter("size > 1")
        last = depth == DEPTH
        small = sizes if last else sizes.filter(f"size <= {NODE_LIMIT}")
        # Of nodes with the same members, one is enough.
        chosen = small.groupBy("members", "size").agg(F.min("node").alias("node"))
        parts.append(level.join(chosen.select("node", "size"), "node"))
        if not last:
            large = level.join(sizes.filter(f"size > {NODE_LIMIT}").select("node"), "node", "left_semi")
            level = written(per_batch(large.join(reps.select("rep", "sig"), "rep"), _branches, "rep long, node long"), "branches")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _search(n: int, alike: Callable[[int, np.ndarray], np.ndarray], seeds: np.ndarray | None) -> np.ndarray:
    """Labels of connected components by breadth-first search; ``alike(at, others)`` gives the others that ``at`` is linked to.

    With ``seeds`` (a mask), only pairs with a seed on one side are compared.
    """
    label, waiting = np.full(n, -1, np.int64), np.arange(n)  # waiting: not reached yet
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first] = first
        waiting = waiting[waiting != first]
        queue = [first]
        while queue and len(waiting):
            at = queue.pop()
            near = waiting if seeds is None or seeds[at] else waiting[seeds[waiting]]
            hit = alike(at, near) if len(near) else near
            if len(hit):
                label[hit] = first
                waiting = waiting[label[waiting] < 0]
                queue.extend(hit.tolist())
    return label


def _prefixes(token: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, token) of the first ``lengths`` tokens of each set, rarest first, that two or more sets have there.

    ``token`` has the numbers of the distinct tokens of one set after the other. Two sets that share all but ``lengths - 1`` tokens of each,
    or more, have one of their first tokens in common, as all order their tokens alike.
    """
    count = np.bincount(token)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    key = np.sort(owner * len(count) + rank[token])
    place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner, first = np.divmod(key[place < lengths[owner]], len(count))
    some = np.bincount(first, minlength=len(count))[first] > 1
    return owner[some], first[some]


def _search_prefixes(n: int, alike: Callable[[int, np.ndarray], np.ndarray], seeds: np.ndarray | None, prefixes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The same labels as ``_search``, where only sets with a common token in their ``prefixes`` can be linked: others are never held against each other."""
    owner, token = prefixes
    label = np.arange(n)
    label[owner] = -1
    _, token = np.unique(token, return_inverse=True)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    # By token, and all of them: sets that are not reached yet, or were not when last looked at. What is no seed is apart, as only seeds look for it.
    waiting: list[list[np.ndarray]] = []
    for part in [np.ones(n, bool)] if seeds is None else [seeds, ~seeds]:
        mine = part[owner]
        by = np.argsort(token[mine], kind="stable")
        lists = np.split(owner[mine][by], np.cumsum(np.bincount(token[mine], minlength=token.max(initial=-1) + 1))[:-1])
        waiting.append([*lists, np.flatnonzero(part & (label < 0))])
    seen = np.zeros(n, bool)
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first] = first
        queue = [first]
        while queue:
            at = queue.pop()
            own = token[bounds[at] : bounds[at + 1]].tolist()
            for lists in waiting if seeds is None or seeds[at] else waiting[:1]:
                # All at once where the lists are longer together.
                for t in own if sum([len(lists[t]) for t in own]) < len(lists[-1]) else [-1]:
                    lists[t] = lists[t][label[lists[t]] < 0]
                    seen[lists[t]] = True
            others = np.flatnonzero(seen)
            if len(others):
                seen[others] = False
                hit = alike(at, others)
                label[hit] = first
                queue.extend(hit.tolist())
    return label


def _bits(token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set: which of the ``WIDE`` most frequent tokens it has, as bits, and how many of the other tokens that come more than once."""
    count = np.bincount(token)
    column = np.full(len(count), -1)
    often = np.argsort(-count, kind="stable")[:WIDE]
    column[often] = np.arange(len(often))
    owner, place = np.repeat(np.arange(len(sizes)), sizes), column[token]
    has = np.zeros((len(sizes), WIDE), bool)
    has[owner[place >= 0], place[place >= 0]] = True
    rest = np.bincount(owner[(place < 0) & (count[token] > 1)], minlength=len(sizes))
    return np.packbits(has, axis=1).view(np.uint64), rest


def linked(payload: list[bytes], percent: int, seeds: np.ndarray | None = None) -> np.ndarray:
    """Components of sets, where 100 * intersection >= percent * union links two."""
    sets = [np.frombuffer(b, np.uint64) for b in payload]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(token.max() + 1, bool)
    many = len(sets) > BRUTE
    bits, rest = _bits(token, sizes) if many else (None, None)

    def enough(common: np.ndarray, at: int, others: np.ndarray) -> np.ndarray:
        return 100 * common >= percent * (sizes[at] + sizes[others] - common)

    def alike(at: int, others: np.ndarray) -> np.ndarray:
        near = others[(100 * sizes[others] >= percent * sizes[at]) & (100 * sizes[at] >= percent * sizes[others])]
        if many:  # no more tokens than these can be in common
            most = np.bitwise_count(bits[near] & bits[at]).sum(axis=1, dtype=np.int64) + np.minimum(rest[near], rest[at])
            near = near[enough(most, at, near)]
        if not len(near):
            return near
        mine = token[starts[at] : starts[at] + sizes[at]]
        held[mine] = True
        lengths = sizes[near]
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        places = np.repeat(starts[near] - offsets, lengths) + np.arange(lengths.sum())
        common = np.add.reduceat(held[token[places]].astype(np.int64), offsets)
        held[mine] = False
        return near[enough(common, at, near)]

    if not many:
        return _search(len(sets), alike, seeds)
    # Linked sets share at least percent / 100 of the tokens of each.
    return _search_prefixes(len(sets), alike, seeds, _prefixes(token, sizes, sizes + 1 + (-percent * sizes) // 100))


def _least(percent: int) -> int:
    """How many tokens of linked sets agree, less 4.6 standard deviations."""
    share = percent / 100
    return int(TOKENS * share - 4.6 * (TOKENS * share * (1 - share)) ** 0.5)


def loosely_linked(payload: list[bytes], percent: int, seeds: np.ndarray | None = None) -> np.ndarray:
    """Components of sets whose signatures agree as often as those of linked sets do, less 4.6 standard deviations."""
    sig, least = np.frombuffer(b"".join(payload), np.uint32).reshape(len(payload), TOKENS), _least(percent)

    def alike(at: int, others: np.ndarray) -> np.ndarray:
        return others[np.bitwise_count((sig[others] == sig[at]).view(np.uint64)).sum(axis=1) >= least]

    if len(sig) <= BRUTE:
        return _search(len(sig), alike, seeds)
    _, token = np.unique(sig.astype(np.uint64) * np.uint64(TOKENS) + np.arange(TOKENS, dtype=np.uint64), return_inverse=True)
    each = np.full(len(sig), TOKENS)
    return _search_prefixes(len(sig), alike, seeds, _prefixes(token.ravel(), each, each - least + 1))


def _loose_pairs(payload: list[bytes], starts: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that ``loosely_linked`` links within each of many nodes, which begin at ``starts``."""
    sig, least = np.frombuffer(b"".join(payload), np.uint32).reshape(len(payload), TOKENS), _least(percent)
    left, right = [], []
    for i in range(int(sizes.max(initial=0)) - 1):
        for j in range(i + 1, int(sizes.max())):
            at = starts[sizes > j]
            hit = at[(sig[at + i] == sig[at + j]).sum(axis=1) >= least]
            left.append(hit + i)
            right.append(hit + j)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compare(compare, percent: int):
    def fn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lead", "rep"], ascending=[False, True]).drop_duplicates("rep")
        reps, seeds = group["rep"].to_numpy(), group["seed"].to_numpy()
        label = compare(group["payload"].tolist(), percent, None if seeds.all() else seeds)
        return pd.DataFrame({"rep": reps, "root": reps[label], "node": group["node"].to_numpy()})

    return fn


def _compare_sorted(compare, percent: int):
    """The same for whole nodes, which come one after the other, without a call for each node.

    Of nodes with up to ``FEW`` sets, pairs of signatures are compared for all of a batch at once; these yield their pairs.
    """

    def links(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.drop_duplicates(["node", "rep"])
        node, reps, payload = nodes["node"].to_numpy(), nodes["rep"].to_numpy(), nodes["payload"].tolist()
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.append(starts, len(node)))
        some = (sizes <= FEW) if compare is loosely_linked else np.zeros(len(sizes), bool)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if some.any():
            left, right = _loose_pairs(payload, starts[some], sizes[some], percent)
            a.append(left)
            b.append(right)
        for at, n in zip(starts[~some].tolist(), sizes[~some].tolist()):
            if n > 1:
                a.append(at + compare(payload[at : at + n], percent))
                b.append(np.arange(at, at + n))
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"rep": reps[b], "root": reps[a], "node": node[b]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of the last node so far
        for batch in batches:
            if not len(batch):
                continue
            last = batch["node"].to_numpy() == batch["node"].iat[-1]
            if held and held[-1]["node"].iat[-1] == batch["node"].iat[-1]:
                held.append(batch)
                continue
            whole = pd.concat([*held, batch[~last]])
            held = [batch[last]]
            if len(whole):
                yield links(whole)
        if held:
            yield links(pd.concat(held))

    return run


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """By ``keys``, in a number of partitions that AQE leaves alone: it joins small ones by their bytes, and blocks take long for these."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _forest(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], limit: int, compare, percent: int) -> DataFrame:
    """(a, b): links that connect what ``compare`` links within each node of ``members(node, size, rep)``.

    ``fetch`` adds the payload to compare. Nodes of up to ``limit`` members are compared whole, node after node in a task. Larger ones are cut into blocks that all
    get the node's first member; members that this does not connect to the first are then held against every block.
    """
    yes, no = F.lit(True), F.lit(False)
    schema = "rep long, root long, node long"
    small = fetch(members.filter(F.col("size") <= limit)).select("node", "rep", "payload")
    found = small.repartition("node").sortWithinPartitions("node", "rep").mapInPandas(_compare_sorted(compare, percent), schema)
    firsts = members.filter(F.col("size") > limit).groupBy("node").agg(F.min("rep").alias("first"))
    if firsts.limit(1).count():
        blocks = F.ceil(F.col("size") / limit).cast("int")
        large = written(fetch(members.filter(F.col("size") > limit)).join(firsts, "node").withColumn("blocks", blocks), "large-nodes")
        lead = F.col("rep") == F.col("first")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
        copied = large.filter(lead).select("node", every, "rep", yes.alias("seed"), yes.alias("lead"), "payload")
        dealt = large.filter(~lead).select("node", own, "rep", yes.alias("seed"), no.alias("lead"), "payload")
        within = written(_spread(copied.union(dealt), "node", "block").groupBy("node", "block").applyInPandas(_compare(compare, percent), schema), "within-blocks")
        apart = within.join(firsts, "node").filter("root <> first").select("node", "rep").distinct()
        cells = apart.groupBy("node").agg(F.ceil(F.count("*") / limit).cast("int").alias("cells"))
        others = large.join(cells, "node").select("node", own, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "rep", no.alias("seed"), no.alias("lead"), "payload")
        cell = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cells")).cast("int").alias("cell")
        seeds = large.join(apart, ["node", "rep"], "left_semi").join(cells, "node").select("node", every, cell, "rep", yes.alias("seed"), yes.alias("lead"), "payload")
        across = _spread(others.union(seeds), "node", "block", "cell").groupBy("node", "block", "cell").applyInPandas(_compare(compare, percent), schema)
        found = found.union(within).union(across)
    return found.filter("root <> rep").select(F.col("root").alias("a"), F.col("rep").alias("b"))


def _sets(words: int):
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, words).tobytes() for t in batch["text"]]
        return pd.DataFrame({"node": batch["node"], "size": batch["size"], "rep": batch["rep"], "payload": sets})

    return fn


def _links(docs: DataFrame, reps: DataFrame, words: int, percent: int, trees: int) -> DataFrame:
    """(a, b): links that connect representatives whose sets are alike."""
    meeting = written(_meeting(reps, trees), "meeting")
    signed = reps.select("rep", F.col("sig").alias("payload"))
    loose = components(_forest(meeting, lambda m: m.join(signed, "rep").select("node", "rep", "size", "payload"), NODE_LIMIT, loosely_linked, percent))
    # Each set is now in one cluster, and is fetched once.
    clusters = written(loose.select(F.col("id").alias("rep"), F.col("component").alias("node")), "clusters")
    members = clusters.join(clusters.groupBy("node").agg(F.count("*").alias("size")), "node")

    def fetch(m: DataFrame) -> DataFrame:
        keyed = m.join(reps.select("rep", "doc_id", "text_key"), "rep")
        # By the text as well: another text under the same id is another set.
        texts = docs.join(keyed, ["doc_id", "text_key"])
        return per_batch(texts.select("rep", "text", "node", "size"), _sets(words), "node long, size long, rep long, payload binary")

    return _forest(written(fetch(members), "cluster-sets"), lambda m: m, CLUSTER_LIMIT, linked, percent)


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _labelled(docs: DataFrame, words: int, percent: int, trees: int | None) -> DataFrame:
    """One row per input row: (doc_id, text_key, n_shingles, component_id, kept)."""
    trees = trees or (4 if percent >= 85 else 6)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("text_key"))
    base = written(per_arrow_batch(docs, _describe(words), "doc_id long, text_key binary, n_shingles long, set_key string, sig binary"), "sets")
    some = base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    lowest = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "sig")).alias("m"))
    # Numbers are unique, and fixed once written.
    reps = written(lowest.select("set_key", "m.doc_id", "m.text_key", "m.sig", F.monotonically_increasing_id().alias("rep")), "reps")
    own = F.struct("doc_id", "text_key")
    comps = written(components(_links(docs, reps, words, percent, trees)).withColumnRenamed("id", "rep").join(reps, "rep").select("rep", "component", own.alias("own")), "components")
    firsts = written(comps.groupBy("component").agg(F.min("own").alias("first")), "firsts")
    of = reps.join(comps.join(firsts, "component").select("rep", "first"), "rep", "left").select("set_key", F.coalesce("first", own).alias("first"))
    out = base.drop("sig").join(of, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    kept = (F.col("doc_id") == component) & ((F.col("n_shingles") == 0) | (F.col("text_key") == F.col("first.text_key")))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(kept, F.lit(False)).alias("kept"))


def components_of(docs: DataFrame, words: int = 5, percent: int = 80, trees: int | None = None) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept)."""
    return _labelled(docs, words, percent, trees).drop("text_key")


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, one text of each component, with all their columns."""
    gone = _labelled(docs, words, percent, None).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id", "text_key").distinct()
    key = F.unhex(F.md5(F.col("d.text").cast("binary")))
    return docs.alias("d").join(gone.alias("g"), (F.col("d.doc_id") == F.col("g.doc_id")) & (key == F.col("g.text_key")), "left_anti")


@BOOK.query("op8_chosen_path_near_dedup")
def chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` whose sets of 3-word shingles have a similarity of 0.85 or more."""
    return components_of(documents(spark, sf_dir), words=3, percent=85)
