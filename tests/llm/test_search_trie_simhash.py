"""Ranked search, prefix trie and fingerprint links on awkward tables against plain restatements."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from footfall.llm import search, simhash, trie
from footfall.llm.queries import QUERIES
from tests.llm import corpus as C

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [(r[0], r[1]) for r in C.documents()]
ITEMS = [(1, DOCS[0][1]), (2, "the THE on nowhere"), (3, None), (4, ""), (4, "日本 éeau"), (None, DOCS[1][1][:300]), (7, DOCS[1][1][:300]), (8, "zzzz--qqqq"), (9, "a b c")]
BY_TEXT = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(C.documents(), C.SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*r, "own") for r in ITEMS], "item_id long, text string, rank string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(turns_of_all(), TURNS).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


# --- search ----------------------------------------------------------------------

def ranked(docs, items, k=50):
    found = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    sizes = [sum(c.values()) for c in found]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for (key, _), c, size in zip(docs, found, sizes):
            m = 100 - 50 + 50 * size * n // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, r, key, -s) for r, (s, _, _, key) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_search(spark, folder):
    got = QUERIES["op11_hybrid_search"](spark, folder)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=BY_TEXT) == sorted(ranked(DOCS, ITEMS), key=BY_TEXT)


def test_search_in_small_segments_and_blocks(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    table = search.index(docs, segment_bytes=3000)
    assert table.where("term IS NULL").count() > 20
    got = search.search(table, spark.read.parquet(f"{folder}/benchmark.parquet"), k=7, block_bytes=300)
    assert sorted(map(tuple, got.collect()), key=BY_TEXT) == sorted(ranked(DOCS, ITEMS, 7), key=BY_TEXT)


@pytest.mark.parametrize("window", [8, 64, 4096])
def test_skipping_keeps_the_best(window):
    rnd = np.random.default_rng(3)
    for size in (1, 50, 900):
        for _ in range(30):
            lists = []
            for _ in range(rnd.integers(1, 12)):
                d = np.flatnonzero(rnd.random(size) < rnd.choice([0.01, 0.1, 0.5, 1.0]))
                if len(d):
                    lists.append((d, rnd.integers(1, rnd.choice([3, 50, 1000]), len(d))))
            if not lists:
                continue
            total = np.zeros(size, np.int64)
            for d, g in lists:
                total[d] += g
            for k in (1, 5, 40):
                want = [x for x in np.lexsort((np.arange(size), -total)) if total[x] > 0][:k]
                docs, scores = search.best(lists, size, k, window)
                assert docs.tolist() == want and scores.tolist() == total[want].tolist()


# --- trie ------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string, node string, a string, pos string"


def turns_of_all():
    rnd = np.random.default_rng(5)
    rows = []
    for c in [*range(0, 60), *range(98, 130), 200, 201, 255, 399, 1000, 1001, -1, -99, -100, -101, -205]:
        for t in range(int(rnd.integers(0, 9))):
            rows.append((c, t, ("user", "assistant")[t % 2], f"turn {rnd.integers(0, 3)} ü😀" if t < 3 else f"own {rnd.integers(0, 40)}"))
    rows += [(500, t, "user", f"line {t}") for t in range(150)] + [(501, t, "user", f"line {t}") for t in range(130)]
    rows += [(3, None, "user", "before all"), (3, None, None, "before all"), (4, 1, None, None), (4, 1, "", ""), (5, 2, "user", "x" * 50000)]
    rows += [rows[7], rows[7], (None, 1, "user", "nobody's"), (None, None, None, None)]
    return [(*r, "c", "l", "a", "s") for r in rows]


def trie_of(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (role or "").encode(), (text or "").encode()))
    for c in own:
        own[c].sort()
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        seq = tuple(x[1:] for x in own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own_members in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(own_members) - 1) * len(p[-1][1].decode()) if p else 0
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()]


def test_prefix_trie(spark, folder):
    got = QUERIES["op12_prefix_trie"](spark, folder)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=BY_TEXT) == sorted(trie_of([r[:4] for r in turns_of_all()]), key=BY_TEXT)


def test_only_turnless_conversations(spark):
    rows = [(100 + k, 0, "user", "only") for k in range(100) if zlib.crc32(str(100 + k).encode()) % 6 > 0 and k]
    assert len(rows) > 50
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert list(map(tuple, got)) == trie_of(rows)


def test_digest_of_a_node_with_many_members(spark):
    rows = [(7, 2, int(x)) for x in np.random.default_rng(1).permutation(30000) - 5]
    got = trie.member_digests(spark.createDataFrame(rows + [(7, 3, 1)], "node long, depth long, conv_id long").repartition(5)).collect()
    want = hashlib.sha256(",".join(map(str, range(-5, 29995))).encode()).hexdigest()
    assert {tuple(r) for r in got} == {(7, 2, want), (7, 3, hashlib.sha256(b"1").hexdigest())}


# --- fingerprints ----------------------------------------------------------------

def fingerprint_of(text):
    w = (text or "").encode().translate(C.LOWER).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(prints, distance=3):
    f = np.array(prints, np.uint64)
    label = list(range(len(f)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= distance):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(f))]


def test_fingerprints_and_components(spark, folder):
    rows = sorted(DOCS, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [fingerprint_of(t) for _, t in rows]
    want = [(key, f"{p:016x}", rows[top][0]) for (key, _), p, top in zip(rows, prints, classes_of(prints))]
    got = QUERIES["op13_pigeonhole_simhash"](spark, folder)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=BY_TEXT) == sorted(want, key=BY_TEXT)


@pytest.mark.parametrize("parts,large", [(2, 2048), (3, 2048), (4, 2048), (4, 20), (3, 5)])
def test_no_link_is_lost(spark, parts, large):
    rnd = np.random.default_rng(parts)
    centres = rnd.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = []
    for c in centres:  # chains and clouds around each centre, in few of the bits or in all
        bits = rnd.choice(64, int(rnd.integers(6, 64)), replace=False)
        for _ in range(60):
            x = c
            for b in rnd.choice(bits, int(rnd.integers(0, 6)), replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            near.append(x)
    f = np.unique(np.concatenate([near, rnd.integers(0, 1 << 63, 300, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    classes = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fingerprint long")
    got = simhash.links(classes, len(f), parts, large).collect()
    place = {int(x): i for i, x in enumerate(f.view(np.int64))}
    label = list(range(len(f)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in got:
        a, b = place[r.a], place[r.b]
        assert int(np.bitwise_count(f[a] ^ f[b])) <= 3 and a != b
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(f))] == classes_of(f)


def test_links_of_a_dense_bucket_are_a_forest():
    f = np.arange(2048, dtype=np.uint64) << np.uint64(20)
    assert len(simhash._forest(f, 3)) == 2047


def test_thresholds_are_the_cheapest():
    rnd = np.random.default_rng(2)
    costs = rnd.random((40, 4, 3)).cumsum(axis=2)
    costs[:, :, 0] = 0
    got = simhash.thresholds(costs)
    every = [t for t in np.ndindex(3, 3, 3, 3) if sum(t) == 4]
    for c, t in zip(costs, got):
        assert sum(t + 1) == 4
        assert math.isclose(sum(c[i, t[i] + 1] for i in range(4)), min(sum(c[i, x[i]] for i in range(4)) for x in every))


def test_correlated_bits_share_a_part():
    rnd = np.random.default_rng(4)
    source = rnd.random((500, 4)) < 0.5
    order = rnd.permutation(64)
    bits = np.empty((500, 64))
    bits[:, order] = np.repeat(source, 16, axis=1)
    masks = simhash.parts_of(np.abs(np.corrcoef(bits.T)), 4)
    assert {frozenset(simhash.bits_of(m)) for m in masks} == {frozenset(order[k * 16 : k * 16 + 16]) for k in range(4)}


@pytest.mark.parametrize("name", ["op11_hybrid_search", "op12_prefix_trie", "op13_pigeonhole_simhash"])
def test_empty_tables(spark, tmp_path, name):
    for table, schema in (("documents", C.SCHEMA), ("benchmark", "item_id long, text string"), ("conversations", TURNS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
