"""Nearest neighbours, near duplicates, language model and pipeline."""

import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from amperoute.llm import components, language_model, near_duplicates, neighbours, packing
from amperoute.llm.oracles import ORACLES
from amperoute.llm.queries import QUERIES

from .conftest import prose, public, texts


def test_neighbours_reach_the_recall_and_handle_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + rng.normal(size=24) * 0.6).tolist(), i) for i in range(1200)]
    rows += [(1200, rows[0][1], 0), (1201, None, 0), (1220, [0.0] * 24, 0), (1240, [float("nan")] * 24, 0), (1260, [1.0, None] + [0.0] * 22, 0), (1280, [1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    asked = F.col("vec_id") % 20 == 0
    got = {}
    for r in neighbours.search(vectors, asked).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    true = dict(neighbours.exact_search(vectors.where("vec_id <> 1280"), asked))
    assert set(got) == set(true)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in best}) for q, best in true.items())
    assert hits >= 0.9 * sum(map(len, true.values()))
    for q, best in got.items():
        assert [r for r, *_ in sorted(best)] == list(range(1, 21)) and all(v != q for _, v, _ in best)
        order = [(-s, v) for _, v, s in sorted(best)]
        assert order == sorted(order)
    few = neighbours.search(vectors.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4
    assert neighbours.search(vectors.limit(0), asked).count() == 0


def test_stop_ratio_is_a_chi_square_quantile():
    ratio = neighbours.stop_ratio(0.05, 8)
    sample = np.random.default_rng(1).chisquare(8, 200_000)
    assert abs((sample > ratio).mean() - 0.05) < 0.003


def brute_components(rows):
    sets = []
    for i, t in rows:
        words = (t or "").encode().translate(language_model._LOWER).split()
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        sets.append((i, grams))
    root = list(range(len(sets)))
    for _ in range(len(sets)):
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets[:a]):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    named = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            named[root[k]] = min(named.get(root[k], i), i)
    return sorted((i or -1, len(s), i if not s else named.get(root[k])) for k, (i, s) in enumerate(sets))


def near_rows():
    """Chains of edits around the threshold, groups that share a passage, copies."""
    rng = random.Random(9)
    passage = prose(77, 30).split(" ")
    rows = texts()[:-3]
    for g in range(6):
        words = prose(100 + g, rng.choice([6, 12, 40, 90])).split(" ")
        for k in range(5):
            rows.append((1000 + g * 10 + k, " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    rows += [(2000 + k, " ".join([*prose(300 + k, 25).split(" "), *passage])) for k in range(12)]
    return rows


@pytest.mark.parametrize(("part_rows", "block_rows", "hubs", "mark_bits"), [(20_000, 4_096, 4, 25), (2, 2, 1, 16)])
def test_components_equal_brute_force(frame, empty, part_rows, block_rows, hubs, mark_bits, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PART_ROWS", part_rows)
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(near_duplicates, "HUBS", hubs)
    monkeypatch.setattr(near_duplicates, "MARK_BITS", mark_bits)
    rows = near_rows()
    got = near_duplicates.link(frame(rows).repartition(3)).collect()
    assert sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute_components(rows), key=str)
    assert near_duplicates.link(empty).count() == 0


@pytest.mark.parametrize("operator", [near_duplicates.link, near_duplicates.one_of_each])
def test_no_plan_brings_an_earlier_one_along_many_times(frame, operator, monkeypatch):
    made, sizes = frame(near_rows()), []
    kept = type(made).checkpoint

    def checkpoint(self, *args, **options):
        sizes.append(len(re.findall(r"\b(?:Aggregate|Join) ", self._jdf.queryExecution().optimizedPlan().toString())))
        return kept(self, *args, **options)

    monkeypatch.setattr(type(made), "checkpoint", checkpoint)
    operator(made)
    assert len(sizes) > 5 and max(sizes) < 20


def test_further_links_tie_components(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, root long")
    links = spark.createDataFrame([(2, 6), (6, 7), (3, 4), (8, 9)], "a long, b long")
    got = {r.root: r.least for r in near_duplicates.further_roots(roots, links).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 3: 3, 4: 3}
    assert near_duplicates.further_roots(roots, links.limit(0)).count() == 0


def test_marks_let_all_wanted_ids_through_and_few_others(spark):
    docs = spark.range(20_000).selectExpr("case when id > 0 then id end as doc_id", "cast(id as string) as text")
    wanted = docs.where("doc_id is null or doc_id % 10 = 3").select("doc_id")
    got = {r.doc_id for r in near_duplicates.marked_only(docs, wanted).select("doc_id").collect()}
    assert {None, *range(3, 20_000, 10)} <= got and len(got) < 2_010
    assert near_duplicates.marked_only(docs, wanted.limit(0)).count() == 0


def brute_stays(rows):
    """One row of each component, the least by (no id, id, row hash); rows without words all stay. Rows are (id, text, hash)."""
    lone, least = [], {}
    # Every row gets an id of its own, so components are told apart whatever the ids of the rows are.
    for (i, t, h), (_, n, root) in zip(rows, sorted(brute_components([(k, t) for k, (_, t, _) in enumerate(rows)])), strict=True):
        if n:
            least[root] = min(least.get(root, (True, 1 << 62, 0, None)), (i is None, i or 0, h, t))
        else:
            lone.append((i, t))
    return sorted(lone + [(None if none else i, t) for none, i, _, t in least.values()], key=str)


def test_one_row_of_each_component_stays(frame, empty):
    base, other = prose(1, 60), prose(800, 50)
    rows = near_rows() + [(31, base)] * 40 + [(None, other)] * 5 + [(None, other + " tail"), (40, prose(801, 30)), (40, base), (41, other), (42, None), (42, None), (None, "")]
    made = frame(rows).withColumn("row_hash", F.lit("kept")).withColumn("ROW_HASH_", F.lit("kept too"))
    hashed = made.select("doc_id", "text", F.xxhash64(*[F.col(c) for c in made.columns]).alias("h")).collect()
    got = near_duplicates.one_of_each(made.repartition(4))
    assert got.columns == made.columns
    kept = got.collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=str) == brute_stays([(r.doc_id, r.text, r.h) for r in hashed])
    assert {(r.row_hash, r["ROW_HASH_"]) for r in kept} == {("kept", "kept too")}
    assert near_duplicates.one_of_each(empty).count() == 0


@pytest.mark.parametrize("operator", [near_duplicates.link, near_duplicates.one_of_each, lambda docs: packing.pack(docs, public.path("word_bpe_49k.json"))])
def test_long_texts_travel_to_workers_in_small_batches(spark, empty, operator):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    operator(empty)
    long = spark.range(300, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    sizes = [r.size for r in long.mapInArrow(lambda batches: (b.from_pydict({"size": [b.nbytes]}) for b in batches), "size long").collect()]
    assert sum(sizes) >= 30_000_000 and max(sizes) <= 3_000_000


def test_sketches_bound_differences_and_pigeonhole_holds():
    rng = np.random.default_rng(4)
    for n in (1, 3, 7, 8, 40, 63, 64, 300, 700, 5000):
        for _ in range(8):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            out = rng.integers(0, max(1, n // 4) + 1)
            b = np.unique(np.concatenate([a[out:], rng.integers(0, 2**64, rng.integers(0, max(1, n // 5) + 1), dtype=np.uint64)]))
            if not len(b):
                continue
            assert near_duplicates.hamming(near_duplicates.bit_sketch(a), near_duplicates.bit_sketch(b)) <= len(np.setxor1d(a, b))
            if near_duplicates.linked(a, b):
                cells = []
                for x in (a, b):
                    own = [near_duplicates.keys(near_duplicates.cells(x, k), k) for k in near_duplicates.bands(len(x))]
                    cells.append({v for keys in own for v in np.sort(keys)[: near_duplicates.chosen(len(x))].tolist()})
                assert cells[0] & cells[1]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 299)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 299: 299, 300: 299}


def test_model_probabilities_sum_to_one_and_every_id_is_scored_once():
    rng = np.random.default_rng(6)
    counts = np.zeros(1500)
    counts[:1200] = rng.integers(1, 50, 1200)
    listed = language_model.Listed(counts)
    model = language_model.Model(listed, rng.integers(0, 4, (language_model.LISTED + 1,) * 2).astype(float))
    model.weights["read"] = rng.normal(0, 0.3, model.weights["read"].shape).astype(np.float32)
    for n in (1, 2, 31, 32, 33, 56, 57, 200):
        places = [p for at, skip in language_model.windows(n) for p in range(at + skip, min(at + language_model.WINDOW, n))]
        assert places == list(range(n))
    head = rng.integers(0, 1499, 40)
    every = model.score([np.append(np.append(head, last), 1499) for last in range(1500)])
    without = model.score([np.append(head, 1499)])
    # Texts that differ in one id before the end: their probabilities, without the end, make up that of the head.
    end = [model.score([np.append(np.append(head, last), 1499)])[0] for last in (0, 700, 1400)]
    assert np.allclose(end, every[[0, 700, 1400]], rtol=1e-5)
    given = listed.place_of[np.append(1499, head)][-language_model.STRIDE // 3 :]
    assert given.max() <= language_model.LISTED and np.isfinite(without).all()
    table, within = np.exp(model.table), np.exp(model.within)
    assert np.allclose(table.sum(1), 1, atol=1e-3)
    shares = np.exp(listed.share[listed.place_of == language_model.LISTED]).sum()
    assert abs(shares - 1) < 1e-3
    assert np.allclose(np.stack([np.bincount(listed.class_of, row, language_model.CLASSES) for row in within])[:, : language_model.OWN_CLASSES], 1, atol=1e-3)


def test_gradients_match_differences():
    rng = np.random.default_rng(8)
    listed = language_model.Listed(rng.integers(1, 9, 1300).astype(float))
    model = language_model.Model(listed, rng.integers(0, 3, (language_model.LISTED + 1,) * 2).astype(float))
    model.weights = {n: rng.normal(0, 0.3, w.shape) for n, w in model.weights.items()}
    given, target = rng.integers(0, 50, (3, 9)), rng.integers(0, language_model.CLASSES, (3, 9))

    def loss():
        z = model.forward(given)[-1] @ model.weights["read"] + model.table[given]
        z = z - z.max(-1, keepdims=True)
        return -(z - np.log(np.exp(z).sum(-1, keepdims=True)))[np.arange(3)[:, None], np.arange(9), target].mean()

    gradients = model.train_step(given, target)
    for name, g in gradients.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = model.weights[name][at]
        model.weights[name][at] = kept + 1e-5
        up = loss()
        model.weights[name][at] = kept - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))
        model.weights[name][at] = kept


def test_all_windows_train_and_all_ids_keep_their_pairs(frame, monkeypatch):
    rng = np.random.default_rng(9)
    listed = language_model.Listed(rng.integers(1, 9, 1300).astype(float))
    for n in (1, 5, language_model.WINDOW, 3 * language_model.WINDOW + 7):
        ids = rng.integers(0, 1300, n).astype(np.int32)
        given, target, prior = language_model.training_windows(ids, listed)
        assert (target >= 0).sum() == n and given.shape == target.shape == prior.shape
        assert target[target >= 0].tolist() == listed.class_of[listed.place_of[ids]].tolist()
        assert prior.ravel()[:n].tolist() == [ids[-1], *ids[:-1]]
    # Words of one id each; the last forty are too rare to be listed and always stand in one order.
    vocabulary = public.path("byte_bpe_50k.tiktoken")
    subwords = language_model.Subwords(vocabulary, public.PATTERN)
    with open(vocabulary, "rb") as lines:
        words = [w.decode()[1:] for w in (base64.b64decode(line.split()[0]) for line in lines) if w[:1] == b" " and w[1:].isalpha() and w[1:].islower()][1000:2200]
    assert all(len(subwords.sequence([w.encode()])) == 2 for w in words)
    common, rare = words[:-40], words[-40:]
    rows = [(i, " ".join(common[(i * 40 + k) % len(common)] for k in range(80))) for i in range(100)] + [(i, " ".join(rare)) for i in (501, 502, 503)]
    assert not any(zlib.crc32(str(i).encode()) % 7 == 2 for i in (501, 502, 503))
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(held[0], " ".join(rare)), (held[1], " ".join(rare[::-1])), (900, "a"), (901, None)]
    scores = []
    for limit in (10**6, 2000, 0):
        monkeypatch.setattr(language_model, "FREQUENT_PAIRS", limit)
        got = language_model.score(frame(rows).coalesce(1), vocabulary, public.PATTERN).collect()
        scores.append({r.row.doc_id: r.score for r in got})
    assert all(np.allclose(scores[0][i], s[i], rtol=1e-5) for s in scores for i in scores[0])
    assert scores[0][held[0]] > scores[0][held[1]] + 20


def test_every_text_is_encoded_once(frame, tmp_path, monkeypatch):
    kept, calls = language_model.Subwords.of, str(tmp_path / "calls")

    def of(self, words):
        with open(calls, "a") as log:
            log.write("x")
        return kept(self, words)

    monkeypatch.setattr(language_model.Subwords, "of", of)
    rows = [(i, prose(i, 30)) for i in range(40)]
    assert language_model.score(frame(rows), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 40
    with open(calls) as log:
        assert len(log.read()) == 40


@pytest.mark.parametrize("scale", [0.3, 40.0])
def test_scoring_sees_the_states_that_training_sees(scale):
    rng = np.random.default_rng(12)
    listed = language_model.Listed(rng.integers(1, 9, 1300).astype(float))
    model = language_model.Model(listed, rng.integers(0, 3, (language_model.LISTED + 1,) * 2).astype(float))
    model.weights |= {n: model.weights[n] * scale for n in ("query", "key")}
    given = rng.integers(0, language_model.LISTED, (5, language_model.WINDOW))
    tables = model.tables()
    assert tables[-1] == (scale < 1)
    x, q, k, v, a, o, h = model.forward(given)
    assert np.isfinite(h).all() and np.allclose(a.sum(-1), 1, atol=1e-4) and not np.triu(a, 1).any()
    exponents = (x.astype(float) @ model.weights["query"]) @ (x @ model.weights["key"]).transpose(0, 2, 1) / 4
    plain = np.exp(exponents - np.where(np.tril(np.ones_like(exponents)) > 0, exponents, -1e9).max(-1, keepdims=True)) if scale < 1 else None
    if plain is not None:
        plain = np.tril(plain)
        assert np.allclose(a, plain / plain.sum(-1, keepdims=True), atol=1e-4)
    assert np.allclose(model.hidden(given, tables), h, rtol=1e-2, atol=1e-3)


def test_class_likelihoods_of_all_ids_sum_to_one():
    rng = np.random.default_rng(10)
    n, counts = 1500, rng.integers(0, 9, 1500).astype(float)
    listed = language_model.Listed(counts)
    table = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.1)
    table[1200] = 0
    left, right = np.nonzero(table)
    c = table[left, right]
    cls = listed.class_of[listed.place_of[right]]
    grouped = np.zeros((n, language_model.CLASSES))
    np.add.at(grouped, (left, cls), c - language_model.DISCOUNT)
    some = np.nonzero(grouped)
    every = language_model.Pairs(counts, listed, table.sum(1), (table > 0).sum(1), (*some, grouped[some]), left.astype(np.int64) << 32 | right, c)
    assert np.allclose(every.classes.sum(1), 1, atol=1e-3)
    for a in (3, 1200, 1499):
        ids = np.arange(n)
        each, _ = every.local(np.full(n, a), ids, np.zeros(n, np.int64), 1)
        assert np.allclose(np.bincount(every.class_of, np.exp(each), language_model.CLASSES), 1, atol=1e-3)


def test_base_scores_and_training_help(frame, empty):
    rows = texts() + [(100 + i, prose(800 + i, 400)) for i in range(120)]
    vocabulary = public.path("byte_bpe_50k.tiktoken")
    got = language_model.score(frame(rows).repartition(2), vocabulary, public.PATTERN).collect()
    words = [(i, [*(t or "").encode().translate(language_model._LOWER).split(), b""]) for i, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for (_, own), o in zip(words, out, strict=True) if not o for w in own)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or -1, o, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6)) for (i, own), o in zip(words, out, strict=True))
    assert sorted((r.row.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 300]
    assert held and all(r.score < 0 for r in got)
    assert language_model.score(empty, vocabulary, public.PATTERN).count() == 0


def test_training_raises_held_out_scores_above_pair_counts_and_unigrams():
    subwords = language_model.Subwords(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    sequences = [subwords.sequence(language_model.tokens(prose(2000 + i, 300))) for i in range(240)]
    counts = np.bincount(np.concatenate(sequences[40:]), minlength=subwords.end + 1)
    listed, side = language_model.Listed(counts), language_model.LISTED + 1
    pairs, given, target = np.zeros(side * side), [], []
    for s in sequences[40:]:
        c = listed.place_of[s]
        before = np.concatenate([c[-1:], c[:-1]])
        pairs += np.bincount(before * side + c, minlength=side * side)
        for at in range(0, len(c) - language_model.WINDOW + 1, language_model.WINDOW):
            given.append(before[at : at + language_model.WINDOW])
            target.append(listed.class_of[c[at : at + language_model.WINDOW]])
    model = language_model.Model(listed, pairs.reshape(side, side))
    untrained = model.score(sequences[:40]).sum()
    model.train(np.stack(given), np.stack(target))
    shares = np.log((counts + 0.5) / (counts.sum() + 0.5 * len(counts)))
    assert model.score(sequences[:40]).sum() > untrained > sum(shares[s].sum() for s in sequences[:40])


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows = [(i, prose(i, 70)) for i in range(30)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " more"), (102, "junk " * 50), (103, prose(60, 60) + " password=abcdefghijklmnop"), (104, None)]
    rows += [(200 + i, " ".join(w + "%%%" for w in prose(700 + i, 60).split())) for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    state, after = docs, []
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        after.append(state)
        if name != "packing":
            assert state.columns == docs.columns
    ids = [sorted(r.doc_id for r in s.select("doc_id").distinct().collect()) for s in after]
    assert ids[0] == [*range(30), 100, 101, 103] and ids[1] == ids[2] == ids[3] == [*range(30), 103]
    masked = after[2].where("doc_id = 103").first()
    assert masked.text.endswith(" [SECRET]") and masked.n_chars == len(masked.text)
    kinds = lambda frame: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in frame.collect())
    totals = lambda frame: {r.doc_id: r.n for r in frame.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert totals(corpus_pipeline.run(spark, str(tmp_path))) == totals(after[3]) and len(kinds(after[3])) >= 31
    alone = packing.pack(after[2], public.path("word_bpe_49k.json"))
    assert totals(alone) == totals(after[3])


def test_registered_queries():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
