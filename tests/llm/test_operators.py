"""Every operator's query on awkward documents against plain restatements."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import anchors, automata, bpe, common, language, maxent, mixing, near_dup, pii, quality, repeats, run_index, sketch
from footfall.llm.queries import QUERIES, vocabulary
from tests.llm import corpus as C


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(C.documents(), C.SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], C.SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


ROWS = C.documents()
KEYED = [(r[0], r[1]) for r in ROWS]


def rows_of(spark, folder, name):
    query = next(q for n, q in QUERIES.items() if n.startswith(name + "_"))
    return query(spark, folder).collect()


def same(got, want):
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, want), key=order)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if int(n[2:].split("_")[0]) <= 10))
def test_empty_table(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_personal_data(spark, folder):
    got = rows_of(spark, folder, "op1")
    want = []
    for key, text in KEYED:
        spans = C.base_spans(text)
        n = Counter(k for k, _, _ in spans)
        want.append((key, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    same([r[:6] for r in got], want)
    texts = {k: t for k, t in KEYED}
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in C.base_spans(texts[r.doc_id])} <= {":".join(s) for s in spans} or r.doc_id is None
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1]), int(s[2])))


def test_reliabilities_find_the_better_labeler():
    # two good labelers against one that votes at random
    counts = {(0, "++0000"): 40.0, (0, "--0000"): 40.0, (0, "+++000"): 40.0, (0, "--+000"): 40.0, (0, "+-0000"): 2.0}
    post, rates = pii.reliabilities(counts)
    assert post[0, "++0000"] > 0.9 and post[0, "--+000"] < 0.1
    good, poor = rates[0][1][0, "+"], rates[0][1][2, "+"]
    assert good[0] / good[1] > 5 and 0.5 < poor[0] / poor[1] < 2


def test_masking(spark):
    docs = spark.createDataFrame([(1, "write a@b.co or +49 30 123456 ok", 5, "own"), (2, None, None, "own"), (3, "clean", 5, "own")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert got[1].text == "write <EMAIL> or <PHONE> ok" and got[1].n_chars == len(got[1].text) and got[1].spans == "own"
    assert got[2].text is None and got[3].text == "clean" and got[3].n_chars == 5


def test_language_model(spark, folder):
    got = rows_of(spark, folder, "op2")
    tokens = [(k, (t or "").encode().translate(C.LOWER).split() + [None]) for k, t in KEYED]
    counts = Counter(w for k, ws in tokens if not C.held_out(k, 5, 1) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = []
    for k, ws in tokens:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want.append((k, C.held_out(k, 5, 1), len(ws), sum(counts[w] > 0 for w in ws), n, f"{base:.4f}"))
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.4f}") for r in got], want)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert all(r.score <= 0 for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_group_and_class_factors_sum_to_one():
    import numpy as np

    rnd, n = np.random.default_rng(1), maxent.CLASSES
    w = maxent.Weights(maxent.Model(np.arange(n), np.arange(n), np.zeros(0, np.uint64)))
    w.groups[:], w.classes[:] = rnd.normal(size=w.groups.shape), rnd.normal(size=w.classes.shape)
    rows = np.array([[0, maxent.BUCKETS[0], maxent.ROWS - 1]] * maxent.GROUPS)
    one, two = maxent.probabilities(rows, np.arange(maxent.GROUPS), w)
    assert abs((one[0][:, None] * two).sum() - 1) < 1e-5


def test_small_class_probabilities_are_not_cut_off():
    w = maxent.Weights(maxent.Model(np.ones(maxent.CLASSES, np.int64), np.ones(maxent.CLASSES, np.int64), np.zeros(0, np.uint64)))
    rows = np.array([[0, maxent.BUCKETS[0], sum(maxent.BUCKETS[:2])]] * maxent.CLASSES)
    w.groups[0, 1:] -= 150.0
    w.classes[0:maxent.GROUPS, 1:] -= 40.0
    got = maxent.log_class(rows, np.arange(maxent.CLASSES), w)
    one = np.array([0.0] + [-150.0] * (maxent.GROUPS - 1))
    two = np.array([0.0] + [-40.0] * (maxent.WIDE - 1))
    want = (one - np.log(np.exp(one).sum()))[:, None] + two - np.log(np.exp(two).sum())
    np.testing.assert_allclose(got, want.ravel() / np.log(10), rtol=1e-5, atol=1e-5)
    assert got.min() < -80


def test_a_worker_keeps_the_tables_of_the_operator_at_work():
    with open(vocabulary(), encoding="utf-8") as file:
        spec = file.read()
    encoder = bpe._encoder(spec)
    assert bpe._encoder(spec) is encoder
    words = common.worker_table("quality", common.WordHashes)
    assert common.worker_table("quality", common.WordHashes) is words and list(common._tables) == ["quality"]


@pytest.mark.parametrize("limit, join", [(1 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_texts_stay_in_place_while_the_names_looked_up_are_few(spark, limit, join):
    names = spark.createDataFrame([("a", 1), (None, 2)], "_host string, _text long")
    texts = spark.createDataFrame([("a", 1), ("a", 2), (None, 2), ("b", 1), (None, None)], "_host string, _text long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = quality.same(texts, quality.small_side(names, "names", limit), "_text", "left_semi")
        assert {tuple(r) for r in got.collect()} == {("a", 1), (None, 2)}
        assert join in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_line_quality(spark, folder):
    got = rows_of(spark, folder, "op3")
    want = []
    for key, text in KEYED:
        f = C.line_figures(text)
        want.append((key, *f, f[0] < 10 or 100 * f[4] > 20 * f[0]))
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], want)
    assert not any(r.kept for r in got if r.base_failed)
    removed = {r.doc_id: r for r in got if r.n_removed_words}
    line = "All rights reserved by the holder."
    assert {k for k, t in KEYED if t and line in t} == set(removed) and all(r.n_removed_words == 6 for r in removed.values())
    own = next(k for k, t in KEYED if t and t.startswith(line + "\nand"))
    assert not removed[own].kept and all(r.kept for k, r in removed.items() if r.n_words > 40)


def test_copies_do_not_make_boilerplate(spark):
    text = "\n".join(" ".join(f"w{k}{j}" for j in range(7)) for k in "abcdefgh")
    docs = spark.createDataFrame([(k, text.replace("wd3", f"edit{k}"), "s") for k in range(60)], "doc_id long, text string, source string")
    assert all(r.kept for r in quality.judge(docs).collect())


@pytest.mark.parametrize("n", [1, 2, 7, 20, 40])
def test_template_lines_are_counted_by_pages(spark, n):
    # n lines on every page of a host, and one line of the page's own
    template = [" ".join(f"t{t}x{j}" for j in range(7)) for t in range(n)]
    pages = [(k, "\n".join([*template, " ".join(f"p{k}x{j}" for j in range(12))]), f"s{k % 3}") for k in range(300)]
    pages += pages[:40]  # copies of pages
    got = quality.judge(spark.createDataFrame(pages, "doc_id long, text string, source string")).collect()
    assert len(got) == 340 and all(r.n_removed_words == 7 * n for r in got)


def test_pages_of_a_form_are_documents(spark):
    # pages that differ in one word, or three, of their own line
    template = [f"this is line {k} of every page here" for k in "abcde"]
    for own in ("Item {0} is in stock today and ships very soon", "Item {0} is {0}x in stock {0}y today and ships"):
        pages = [(k, "\n".join([*template, own.format(f"n{k}")]), "shop") for k in range(500)]
        got = quality.judge(spark.createDataFrame(pages, "doc_id long, text string, source string")).collect()
        assert len(got) == 500 and all(r.n_removed_words == 40 for r in got)


def test_documents_and_hosts_are_counted_in_one_unit(spark):
    # 21 of 400 texts have the line; but 380 of them are copies with a word exchanged in one line or another
    text = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(30)]
    copies = ["\n".join(x.replace(f"w{k % 30}x{k % 9}", f"edit{k}") for x in text) for k in range(380)]
    pages = ["the common line has seven words here\n" + " ".join(f"p{k}x{j}" for j in range(12)) for k in range(21)]
    rows = [(k, t, None) for k, t in enumerate(copies + pages)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.n_removed_words for r in got} == {k: 7 if k >= 380 else 0 for k in range(401)}


def test_cleaning_removes_lines_and_keeps_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns
    got = cleaned.collect()
    assert got and not any("All rights reserved by the holder." in r.text for r in got)


def test_near_duplicates(spark, folder):
    got = rows_of(spark, folder, "op4")
    want = C.near_components(KEYED)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicate_stage_takes_five_words(spark):
    # edits that leave 0.8 of the two-word shingles but not of the five-word ones; and very short texts
    rows = []
    for k in range(24):
        base = [f"d{k}w{j}" for j in range(60)]
        rows.append((2 * k, " ".join(base)))
        for e in range(k % 6):
            base[5 + 10 * e] = "edit"
        rows.append((2 * k + 1, " ".join(base).upper()))
    rows += [(100 + k, t) for k, t in enumerate(["a b c d", "A b  c d", "a b c", "b a c", "a b", "b a", "a", "a", "", None, "a b c d e", "a b c d e e"])]
    sets = {}
    for key, text in rows:
        w = (text or "").lower().split()
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent = {k: min(parent[a], parent[b]) if p in (parent[a], parent[b]) else p for k, p in parent.items()}
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates.__wrapped__(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(parent.values()))


def test_near_duplicates_block_by_block(spark, folder):
    # tiny blocks, and the way without a broadcast, must not change the outcome
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    old, near_dup.BROADCAST_CLASSES = near_dup.BROADCAST_CLASSES, 0
    try:
        got = near_dup.near_duplicates(docs, block=3).collect()
    finally:
        near_dup.BROADCAST_CLASSES = old
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], C.near_components(KEYED))


def test_links_of_a_unit_are_a_spanning_forest():
    import random

    import numpy as np

    rnd = random.Random(4)
    base = np.array(sorted(rnd.sample(range(1 << 40), 100)), np.uint64)
    sets = []
    for k in range(60):  # copies that differ from each other by about the threshold
        w = base.copy()
        w[rnd.sample(range(100), 11)] = np.array(rnd.sample(range(1 << 40), 11), np.uint64)
        sets.append(np.sort(w))
    rows = [(1, 0, 0, 0, k, near_dup.packed_set(x)) for k, x in enumerate(sets)]
    assert all((near_dup.unpacked_set(r[5]) == x).all() for r, x in zip(rows, sets))
    found, parent = near_dup.merge(rows, matches=20), list(range(60))

    def root(x, up):
        while up[x] != x:
            x = up[x]
        return x

    plain = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * both >= 80 * (200 - both):
                plain[root(i, plain)] = root(j, plain)
    for a, b in found:
        assert root(a, parent) != root(b, parent)
        parent[root(a, parent)] = root(b, parent)
    groups = lambda up: {frozenset(k for k in range(60) if root(k, up) == r) for r in {root(k, up) for k in range(60)}}
    assert groups(parent) == groups(plain) and len(found) == 60 - len(groups(plain))


def test_one_document_of_each_group_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = near_dup.without_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({k for k, n, c in C.near_components(KEYED) if k is not None and k == c})


def test_language(spark, folder):
    got = rows_of(spark, folder, "op5")
    texts, langs = {r[0]: r[1] for r in ROWS}, {r[0]: r[2] for r in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == C.held_out(r.doc_id, 3, 1)
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
            assert 0 <= r.score <= 1
    judged = [r for r in got if r.held_out and len(C.words(texts[r.doc_id])) > 15 and langs[r.doc_id]]
    assert judged and sum(r.lang_pred == langs[r.doc_id] for r in judged) >= 0.95 * len(judged)


def test_sample_of_rows_without_an_id_is_bounded(spark, monkeypatch):
    # a third of the rows would do; rows that share an id or have none must not all be taken, nor all copies of one
    sizes = []
    monkeypatch.setattr(language, "SAMPLE", 200)
    monkeypatch.setattr(language, "MAX_SAMPLE", 300)
    learn = language.features
    rows = [(None, f"the text number {k}", "en") for k in range(3000)] + [(5, f"der text nummer {k}", "de") for k in range(3000)]
    rows += [(None, "the same text", "en")] * 1500
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(language, "features", lambda t, idf: (seen.add(1), learn(t, idf))[1])
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sizes.append(seen.value)
    assert model["labels"] == ["de", "en"] and 150 < sizes[0] <= 450


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert [r.lang_pred for r in language.predict(docs, model).collect()] == ["und"]


def test_long_texts_are_read_in_pieces():
    text = "abcde " * 50
    whole = language.grams(text)
    old, language.PIECE = language.PIECE, 7
    try:
        assert (language.grams(text) == whole).all() and whole.sum() == 3 * len(text) - 3
    finally:
        language.PIECE = old


def test_sketches(spark, folder):
    got = rows_of(spark, folder, "op6")
    down = sorted(((k, t or "") for k, t in KEYED), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    want, prints = [], {}
    for i, (k, text) in enumerate(down):
        half = len(text) // 2
        edited = text[: len(text) - half] + down[(i + 1) % len(down)][1][:half]
        want.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    same([r[:3] for r in got], want)
    assert len(set(down)) < len(down) and sum(k is None for k, _ in down) > 1
    texts = {(k, len(t)): t for k, t in down}
    for r in got:
        text = texts[r.doc_id, r.n_chars]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == "") == (not C.words(text))
        assert prints.setdefault(" ".join(C.words(text)), r.fingerprint) == r.fingerprint


def test_every_row_without_an_id_is_sketched(spark):
    rows = [(1, "one text of its own"), (1, "another text with that id"), (None, "no id here"), (None, "nor here"), (2, "two")]
    got = sketch.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    same(got, rows)


def test_containment_of_unequal_documents(spark):
    big = " ".join(f"w{k}" for k in range(40000))
    small = " ".join(f"w{k}" for k in range(10000, 14000))
    row = spark.createDataFrame([(big, small, "other " + " ".join(f"x{k}" for k in range(4000)))], "a string, b string, c string").select(
        *[sketch.sketch(F.col(c)).alias(c) for c in "abc"]).select(
        sketch.containment(F.col("a"), F.col("b")).alias("inside"), sketch.containment(F.col("a"), F.col("c")).alias("outside"),
        (F.size("a") / 39996).alias("part")).first()
    assert row.inside > 0.97 and row.outside == 0 and abs(row.part - 1 / 16) < 0.01


def test_neighbours_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BLOCK_ROWS", 7)
    ids = [k * k * (-1) ** k for k in range(60)] + [1 << 60, -(1 << 60)]
    got = {r._id: r._next for r in sketch.neighbours(spark.createDataFrame([(i, 1) for i in ids], "_id long, n_chars long")).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: b for a, b in zip(down, down[1:] + down[:1])}


def test_byte_pairs(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    want = []
    for k, t in KEYED:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    same(rows_of(spark, folder, "op7"), want)


def test_encode_and_decode(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("token_ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    assert out.columns == [*docs.columns, "decoded"]
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_never_split_a_token():
    with open(vocabulary(), encoding="utf-8") as file:
        encoder = bpe.ForcedBoundaryBpe(file.read())
    assert not any(encoder.boundaries(t.removesuffix("</w>")) for t in list(encoder.ids)[::37])
    word = "thequickbrownfoxjumpsoverthelazydog" * 3
    assert encoder._merge_long([*word[:-1], word[-1] + "</w>"]) == encoder.merge([*word[:-1], word[-1] + "</w>"]) or len(word) > bpe.SHORT


def targets(sizes):
    sources = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sources if s not in capped)
        goal = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / free for s in sources}
        over = {s for s in sources if s not in capped and goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_mixing(spark, folder):
    got = rows_of(spark, folder, "op8")
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(C.words(r[1]))
    goal, taken = targets(sizes), Counter()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and all(0 <= p <= 1 for p in placed)
    assert [tuple(r) for r in got] == [tuple(r) for r in rows_of(spark, folder, "op8")]


def test_rows_without_an_id_spread_over_blocks(spark):
    rows = [(None if k % 2 else 3, f"word{k} and more", "s") for k in range(2000)]
    docs = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = mixing.curriculum(docs).select("size", "taken", "positions", "text").collect()
    assert len(plan) == 2000 and sum(r.taken for r in plan) == 9000 and len({r.text for r in plan}) == 2000
    assert len({r.positions[0] for r in plan if r.positions}) == sum(bool(r.positions) for r in plan)
    again = mixing.curriculum(docs.repartition(7)).select("text", "positions").collect()
    assert {r.text: r.positions for r in again} == {r.text: r.positions for r in plan}


def test_mixed_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    got, plan = Counter(), Counter()
    for r in out.collect():
        got[r.doc_id] += len(C.words(r.text))
        assert r.n_chars == len(r.text) or r.doc_id is None
    for r in rows_of(spark, folder, "op8"):
        plan[r.doc_id] += r.taken
    assert got == +plan


def test_schedule_is_inverted(spark):
    row = spark.range(101).select(mixing.position(F.col("id") / 100, F.lit(-0.5)).alias("t"), "id").collect()
    assert all(abs(r.t + -0.5 * (r.t - r.t**2) - r.id / 100) < 1e-9 for r in row)


def test_repeated_words(spark, folder):
    same(rows_of(spark, folder, "op9"), C.repeated_words(KEYED))


def test_repeated_bytes(spark, folder):
    same(rows_of(spark, folder, "op10"), C.repeated_bytes(KEYED))


@pytest.mark.parametrize("words", [True, False])
def test_hot_anchors_take_the_exact_way(spark, folder, words):
    # every anchor with two contents counts as hot: its windows are compared one by one
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    if words:
        same(automata.removal_digests(docs, repeats.Repeats(13, 3, True, True, hot=1)).collect(), C.repeated_words(KEYED))
    else:
        same(run_index.removal_digests(docs, repeats.Repeats(200, 32, False, False, hot=1)).collect(), C.repeated_bytes(KEYED))


def test_many_small_slices(spark, folder, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 3000)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in automata.removal_digests(docs).collect()]
    same(rows, C.repeated_words(KEYED))


def test_cleaned_texts_and_spans(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {(k, h) for k, _, _, h in C.repeated_words(KEYED)}
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in automata.without_repeats(docs).collect()} == want
    spans = {(r.doc_id, r.n_bytes, sum(r.span_ends) - sum(r.span_starts), len(r.span_starts)) for r in run_index.repeated_spans(docs).collect()}
    assert spans == {(k, n, g, s) for k, n, g, s, _ in C.repeated_bytes(KEYED)}


def test_suffix_automaton_against_substrings():
    import random

    rnd = random.Random(3)
    texts = [[rnd.randrange(3) for _ in range(rnd.randint(0, 30))] for _ in range(40)]
    machine = automata.SuffixAutomaton()
    for k, t in enumerate(texts):
        machine.add(t, k)
    for t in texts + [[rnd.randrange(4) for _ in range(20)] for _ in range(20)]:
        want = [next((k for k, u in enumerate(texts) if any(u[j : j + 4] == t[i : i + 4] for j in range(len(u) - 3))), -1) for i in range(len(t) - 3)]
        assert machine.stream(t, 4) == want


def test_run_index_against_substrings():
    import random

    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(10, 60))) for _ in range(30)]
    texts[3] = texts[2][5:] + b"zz"
    got, at = run_index.repeated_windows(texts, 9), 0
    seen = Counter(t[i : i + 9] for t in texts for i in range(len(t) - 8))
    for t in texts:
        for i in range(len(t) - 8):
            assert got[at + i] == (seen[t[i : i + 9]] > 1)
        at += len(t)
    assert run_index.RunIndex([b"abcabcabc" * 40]).runs < 40


def test_anchors_agree_wherever_a_run_stands():
    import numpy as np

    rnd = np.random.default_rng(2)
    run = rnd.integers(97, 123, 230).astype(np.uint8)
    docs = [np.concatenate([rnd.integers(97, 123, n).astype(np.uint8), run, rnd.integers(97, 123, 50).astype(np.uint8)]) for n in (3, 80, 400)]
    keys = []
    for d in docs:
        s = anchors.segments(anchors.byte_hashes(d, 32), np.array([len(d)]), 200, 32)
        at = len(d) - 280
        keys.append([int(s.key[np.flatnonzero((s.first <= at + i) & (s.last >= at + i))[0]]) for i in range(31)])
    assert keys[0] == keys[1] == keys[2]


def test_pipeline(spark, folder, empty):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*corpus_pipeline.COLUMNS, "token_ids"]
    rows = out.collect()
    text = {r[0]: r[1] for r in ROWS}
    components = {k: c for k, _, c in C.near_components([r for r in KEYED])}
    assert rows and not any(len(C.words(text[r.doc_id])) < 10 for r in rows)
    assert not any("@mail.example.com" in r.text or "555-4510" in r.text for r in rows)
    edited = [r.doc_id for r in rows if components.get(r.doc_id) == components[1]]
    assert len(set(edited)) <= 1
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "personal data", "mixing", "tokens"]


@pytest.mark.parametrize("rule", [automata.RULE, run_index.RULE])
def test_cuts_are_read_as_written(rule):
    texts = [b"", b"a b " * 200, b"a b " * 200]
    order = np.arange(len(texts))[::-1].copy()
    cuts, key, content = rule.cut(order.tolist(), order, texts)
    again = repeats.Cuts.unpacked(cuts.packed(), order)
    for name in ("ends", "first", "last", "doc", "entry", "count", "least"):
        assert (getattr(cuts, name) == getattr(again, name)).all(), name
    # entries are in the order of their places, however many places there are
    for shards in (1, 7, 200, 100_000):
        place = repeats.place_of(key, shards)
        assert (np.diff(place) >= 0).all() and place.min() >= 0 and place.max() < shards
    # equal segments, and only they, are one entry
    assert len(set(zip(key.tolist(), content.tolist(), strict=True))) == len(key) == len(cuts.count)


def test_words_are_laid_out_and_hashed_as_arrays():
    import numpy as np

    long = b"x" * (common.LONG + 5)
    texts = [b"", b" \t\n", b"a", b"  b\r\n\x0bcc\x0cd ", b"\x1c \xc2\xa0 \xe2\x80\x83", long + b" " + long[:-1] + b" a", b"", b"cc b" * 3]
    split = [t.split() for t in texts]
    items = repeats.Items.of(texts, True)
    assert items.documents() == [b"".join(w + b" " for w in ws) for ws in split]
    assert items.ends.tolist() == np.cumsum([len(ws) for ws in split]).tolist()
    flat = [w for ws in split for w in ws]
    assert [items.data[a:b].tobytes() for a, b in zip(items.start, items.stop, strict=True)] == flat
    again = repeats.Items.laid(items.data, items.ends)
    assert (again.start == items.start).all() and (again.stop == items.stop).all()
    hashes = common.word_hashes(items.data, items.start).tolist()
    assert len(set(hashes)) == len(set(flat)) == len(set(zip(hashes, flat, strict=True)))


def test_automaton_answers_only_what_other_documents_need():
    # a text that one document has, and that begins nowhere else, needs no answer
    alone, first, later = [1, 1, None], [2, 1, None], [3, 1, None]
    words = [b"w%d" % i for i in range(20)]
    automata.look_up([[(b" ".join(words[:13]), alone)], [(b" ".join([b"p", *words]), first), (b" ".join([*words, b"q"]), later)]], 13)
    assert alone[2] == [] and first[2] == [(1, 2, 1)] and later[2] == [(0, 1, 1), (1, 8, 2)]


def test_contexts_lie_by_feature_and_a_step_sums_per_row():
    import numpy as np

    texts = [b"A b a b c", b"", b"b", b"x y"]
    t = maxent.tokens(maxent._coded([1, None, 3, 4], texts), 5, maxent.Split())
    assert (np.diff(t.shard) >= 0).all() and (t.shard == repeats.place_of(common.mixed(t.words), 5)).all()
    features = maxent.contexts(t)
    assert features.T.flags.c_contiguous  # a feature's rows are read one after the other
    h, want = t.words[t.at], []
    for a, b in zip([0, *t.ends[:-1]], t.ends, strict=True):
        for i in range(a, b):
            one, two = (h[i - k : i - k + 1] if i - k >= a else np.array([maxent.BEGIN]) for k in (1, 2))
            mix = [common.mixed(one), common.mixed(two ^ np.uint64(0x51ED270B)), common.mixed(one * np.uint64(31) + common.mixed(two))]
            want.append([sum(maxent.BUCKETS[:f]) + int(m[0]) % maxent.BUCKETS[f] for f, m in enumerate(mix)])
    assert features.tolist() == want

    rnd, n = np.random.default_rng(4), maxent.CLASSES
    w = maxent.Weights(maxent.Model(np.arange(n), np.arange(n), np.zeros(0, np.uint64)))
    rows = np.array([rnd.integers(0, 3, 50) + sum(maxent.BUCKETS[:f]) for f in range(3)]).T
    kinds = rnd.integers(0, n, 50)
    group = kinds // maxent.WIDE
    one = w.group_bias - np.log(np.exp(w.group_bias).sum())
    two = w.class_bias[group] - np.log(np.exp(w.class_bias[group]).sum(axis=1, keepdims=True))
    maxent.learn(rows, kinds, w)
    last = rows[:, 2]  # of the last feature: each of its rows takes one step
    for p, own, at, got in ((np.exp(one)[None].repeat(50, 0), group, last, w.groups), (np.exp(two), kinds % maxent.WIDE, last * maxent.GROUPS + group, w.classes)):
        gradients = p.astype(float) - np.eye(maxent.WIDE)[own]
        for k in np.unique(at):
            total = gradients[at == k].sum(axis=0)
            np.testing.assert_allclose(got[k], -maxent.RATE * total / np.sqrt((total**2).sum() + 1e-6), rtol=1e-3, atol=1e-4)
