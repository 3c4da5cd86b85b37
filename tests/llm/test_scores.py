import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lithic.llm import labelled, mixing, quality, topk, toxicity

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"
SPEC = "doc_id long, text string, lang string, source string, n_chars long, score string"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", s, len(t or ""), "x") for k, t, s in texts], SPEC)


def plain(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["op1_chat_formatting", "op4_html_extraction", "op6_source_mixing", "op9_exact_top_k"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want)


# ---- classifiers -------------------------------------------------------------


def made_corpus(spark, n=240):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 80))]
        toxic, good = int(k % 4 == 0), int(k % 5 != 0)
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["nasty", "nastier", "vile"])
        if not good:
            text = [w + "###" for w in text]
        rows.append((k, " ".join(text), "s"))
        labels.append((k, good, toxic, "x"))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def accuracy(rows, truth, held):
    own = [(r.predicted, truth(r.doc_id)) for r in rows if r.held_out == held]
    return sum(p == t for p, t in own) / len(own)


def test_classifiers_learn(spark):
    docs, labels = made_corpus(spark)
    tox = toxicity.score_toxicity(docs, labels).collect()
    assert accuracy(tox, lambda k: int(k % 4 == 0), True) >= 0.9
    good = quality.score_quality(docs, labels).collect()
    assert accuracy(good, lambda k: int(k % 5 != 0), True) >= 0.9
    assert all(0 <= r.score <= 1 for r in tox + good)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == sum(r.predicted for r in good)


def test_held_out_rows_teach_nothing(spark):
    docs, labels = made_corpus(spark, 120)
    fold = labelled.fold_of(F.col("doc_id"), 3)
    other = labels.withColumn("toxic", F.when(fold == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (plain(toxicity.score_toxicity(docs, x).collect()) for x in (labels, other))
    assert a == b
    assert labelled.training_rows(docs, labels, "toxic", 3, 1, 5).count() == 10


def test_classifier_edges(spark):
    docs, labels = made_corpus(spark, 60)
    odd = docs.unionByName(docs_of(spark, [(None, None, None), (1000, "", "s"), (1001, " \n", "s"), (1001, " \n", "s"), (1002, "z" * 300_000, "s")]))
    messy = labels.unionByName(spark.createDataFrame([(None, 1, 1, "x"), (3, None, None, "x"), (4, 7, 7, "x"), (5, 0, 0, "x")], labels.schema))
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = score(odd, messy).collect()
        assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (None, 1000, 1001)}) == 1
        assert score(docs.limit(0), labels).count() == 0
        assert len({r.score for r in score(odd, labels.limit(0)).collect()}) == 1


@pytest.mark.skipif(not Path(MORE).exists(), reason="no test data")
def test_held_out_accuracy_on_data(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    for name, label in (("op5_toxicity", "toxic"), ("op8_quality_classifier", "quality")):
        rows = [r for r in __spark_entry__.queries()[name](spark, MORE).collect() if r.held_out and r.doc_id in labels]
        assert np.mean([r.predicted == labels[r.doc_id][label] for r in rows]) >= 0.93


def test_filters_edges(spark):
    """Filtering stages: nulls, empty, very long and repeated texts, columns of any names, no rows."""
    docs, labels = made_corpus(spark, 60)
    odd = docs.unionByName(docs_of(spark, [(None, None, None), (1000, "", "s"), (1001, " \n", "s"), (1001, " \n", "s"), (1002, "z " * 200_000, "s"), (None, "word1 word2", "s")]))
    odd = odd.withColumn("predicted", F.lit("p")).withColumn("label", F.lit(7)).withColumn("held_out", F.lit(None).cast("int"))
    for keep, score in ((toxicity.drop_toxic, lambda r: r.predicted == 0), (quality.keep_good, lambda r: r.predicted == 1)):
        scored = (toxicity.score_toxicity if keep is toxicity.drop_toxic else quality.score_quality)(odd, labels).collect()
        kept = keep(odd, labels)
        assert kept.columns == odd.columns and kept.schema == odd.schema
        assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (r.doc_id for r in scored if score(r))))
        assert {r.predicted for r in kept.collect()} == {"p"}
        assert keep(odd.limit(0), labels).count() == 0 and keep(odd, labels.limit(0)).count() in (0, odd.count())


def test_training_rows_are_bounded(spark):
    """However often a document is repeated, one row of it teaches."""
    docs, labels = made_corpus(spark, 30)
    many = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit(" again"))))
    rows = labelled.training_rows(many, labels, "toxic", 3, 1, 100).collect()
    assert len(rows) == len({r.doc_id for r in rows}) and len(rows) == labelled.training_rows(docs, labels, "toxic", 3, 1, 100).count()


def test_all_labelled_rows_teach(spark, monkeypatch):
    """Both classifiers learn from every labelled document outside of the held-out fold, however many there are."""
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id") % 7).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    seen = []

    def told(rows, *_):
        seen.append(rows.count())
        raise StopIteration

    for module, name, folds, held_out in ((quality, "train", 5, 0), (toxicity, "context_counts", 3, 1)):
        monkeypatch.setattr(module, name, told)
        with pytest.raises(StopIteration):
            module.fit(docs, labels)
        assert seen.pop() == labels.where(labelled.fold_of(F.col("doc_id"), folds) != held_out).count()


def test_shards_and_shares(spark):
    """The quality model is the mean of its shards', each learned by itself; shares of the contexts make up all of them."""
    docs, labels = made_corpus(spark, 90)
    rows = docs.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").select("doc_id", "text", "label")
    own = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    at = sorted(own.select("shard", F.xxhash64(F.lit(1), "doc_id"), "text", "label").collect())
    w = np.zeros((1 << quality.BITS) + 1)
    for shard in range(3):
        model = quality.FollowTheRegularisedLeader(1 << quality.BITS)
        for _, _, text, y in (r for r in at if r[0] == shard):
            found, _ = quality.features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
            where, many = np.unique(found, return_counts=True)
            model.learn(where, many * (quality.SCALE / len(found)), y)
        w += model.weights() / 3
    weights, bias = quality.train(rows, steps=30)
    assert np.allclose(weights, w[:-1]) and np.isclose(bias, w[-1]) and len({r[0] for r in at}) == 3
    cells = rows.withColumn("part", F.lit(0))
    whole, parts = toxicity.context_counts(cells), [toxicity.context_counts(cells, k, 4) for k in range(4)]
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r) for x in parts for r in x.collect())


def test_regularised_leader_step_by_step():
    """Follow-the-regularised-leader against its definition in plain Python, on ten rows."""
    import math

    rng = random.Random(3)
    rows = [([rng.randrange(6) for _ in range(4)], rng.randrange(2)) for _ in range(10)]
    model = quality.FollowTheRegularisedLeader(6)
    z, n = [0.0] * 7, [0.0] * 7

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for found, y in rows:
        x = {k: found.count(k) * quality.SCALE / len(found) for k in sorted(set(found))} | {6: 1.0}
        p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
        own = {k: weight(k) for k in x}
        for k, v in x.items():
            g = (p - y) * v
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * own[k]
            n[k] += g * g
        at, many = np.unique(found, return_counts=True)
        model.learn(at, many * (quality.SCALE / len(found)), y)
        assert np.allclose(model.z, z) and np.allclose(model.n, n) and np.allclose(model.weights(), [weight(k) for k in range(7)])


def test_kneser_ney_by_dictionaries(spark, monkeypatch):
    """Counts of contexts and every probability of both models against plain dictionaries; each distribution adds up."""
    import re
    from collections import Counter, defaultdict

    import pyarrow as pa

    monkeypatch.setattr(toxicity, "G2", 0.0)
    monkeypatch.setattr(toxicity, "RATIO", 1e-9)  # so that every expression is an entry of its class
    rng = random.Random(11)
    vocabulary = ["alpha", "alphabet", "beta", "gamma", "gammas", "de", "été", "ét"]
    texts = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 12))), k % 2) for k in range(20)]
    rows = spark.createDataFrame([(t, c, k % toxicity.PARTS) for k, (t, c) in enumerate(texts)], "text string, label int, part int")
    model = toxicity.train(toxicity.context_counts(rows))[toxicity.PARTS]
    triples = [set(), set()]
    for t, c in texts:
        words = re.findall(r"\w+", t)
        for a, b, w in zip(["", "", *words][: len(words)], ["", *words][: len(words)], words, strict=True):
            triples[c].add((a, b, w))
    pairs = [Counter((b, w) for _, b, w in x) for x in triples]
    words = [Counter(w for _, w in x) for x in pairs]
    stems = [Counter(w[: toxicity.STEM] for w in x) for x in words]
    d, both = toxicity.DISCOUNT, sum(sum(x.values()) for x in stems)
    known = sorted({w for x in words for w in x})
    of_stem = defaultdict(float)
    for w in known:
        of_stem[w[: toxicity.STEM]] += words[0][w] + words[1][w]

    def probability(c, before, w):
        less = lambda n, counts: max(n - d, 0) / max(1, sum(counts.values()))
        s = w[: toxicity.STEM]
        left = 1 - sum(less(n, stems[c]) for n in stems[c].values())
        by_stem = less(stems[c][s], stems[c]) + left * (stems[0][s] + stems[1][s] + 0.5) / both
        rest = 1 - sum(less(n, words[c]) for n in words[c].values())
        by_word = less(words[c][w], words[c]) + rest * by_stem * (words[0][w] + words[1][w] + 0.5) / (of_stem[s] + 0.5)
        own = Counter({x: n for (b, x), n in pairs[c].items() if b == before})
        spent = {x: less(n, own) for x, n in own.items()}
        return spent.get(w, 0) + (1 - sum(spent.values())) * by_word

    text = " ".join(known)
    hashes, before, stem, _ = toxicity.word_events(*[x for _, *x in toxicity.text_slices(toxicity._lower(pa.array([text])))][0])
    name = dict(zip(known, hashes.tolist(), strict=True)) | {"": 0}
    for b in ["", *known]:
        previous = np.full(len(known), name[b], np.uint64)
        want = [[probability(c, b, w) for w in known] for c in (0, 1)]
        assert np.allclose(model.log_ratio(hashes, previous, stem), np.log(want[1]) - np.log(want[0]))
        # All of it is spent but for what smoothing by halves adds.
        assert all(1 - 1e-9 <= sum(x) <= 1.35 for x in want)


# ---- mixing ------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in full}
        open_ -= full
    return target


def test_mixing(spark):
    rng = random.Random(2)
    texts = [(k, " ".join(["w"] * rng.randrange(0, 400)), rng.choice(["a"] * 20 + ["b", "c", "d", "é", None, "B"])) for k in range(300)]
    texts += [(7, None, "a"), (None, "x y", "zz"), texts[0], (900, "w " * 60_000, "b"), (901, "", "empty")]
    docs = docs_of(spark, texts)
    got = mixing.mix_sources(docs, block=64).collect()
    assert len(got) == len(texts)
    source = {}
    for k, t, s in texts:
        source[s] = source.get(s, 0) + len((t or "").split())
    want = brute_targets(source)
    of = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        of.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    goal = {}
    for s in source:
        goal.setdefault((source[s], round(float(want[s]), 6)), []).append(want[s])
    assert set(of) == set(goal)
    for key, taken in of.items():
        assert abs(sum(taken) - sum(goal[key])) <= 0.5 * len(goal[key]) + 1e-6
    again = mixing.mix_sources(docs.repartition(7), block=64).collect()
    assert plain(map(tuple, got)) == plain(map(tuple, again))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixture_itself(spark):
    texts = [(k, " ".join(f"w{j}" for j in range(k % 50)), f"s{k % 4}" if k % 3 else "big") for k in range(200)]
    docs = docs_of(spark, texts)
    out = mixing.apply_mix(docs, block=64)
    assert out.columns == docs.columns
    words = out.select(F.sum(mixing.word_count(F.col("text"))).alias("n")).first().n
    assert words == mixing.mix_sources(docs, block=64).agg(F.sum("taken")).first()[0]
    known = {k: t for k, t, _ in texts}
    for r in out.collect():
        assert known[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)


def test_mixture_follows_the_schedule(spark):
    """Any stretch of the slots has the sources near their shares; the golden ratio does that, slots in a row don't."""
    texts = [(k, " ".join(f"w{j}" for j in range(5 + k % 30)), f"s{k % 5}") for k in range(1500)]
    docs = docs_of(spark, texts)
    rows = [(r.slot, r.source, len(r.text.split())) for r in mixing.mixture(docs, block=16).collect()]
    whole = sum(n for *_, n in rows)
    share = {s: sum(n for _, x, n in rows if x == s) / whole for s in {x for _, x, _ in rows}}
    top = max(r[0] for r in rows)
    for k in range(8):
        part = [r for r in rows if k * top // 8 <= r[0] < (k + 1) * top // 8]
        for s, want in share.items():
            assert abs(sum(n for _, x, n in part if x == s) / sum(n for *_, n in part) - want) < 0.08, (k, s)
    slots = mixing.mix_sources(docs, block=16).where("taken > 0")
    assert slots.where("first_slot is null or last_slot < first_slot").count() == 0
    assert {r.first_slot for r in slots.collect()} <= {s for s, *_ in rows}
    # Partitions are stretches of the schedule, in order.
    spread = mixing.mixture(docs, block=16).groupBy(F.spark_partition_id().alias("p")).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).orderBy("p").collect()
    assert len(spread) > 1 and all(a.hi < b.lo for a, b in zip(spread, spread[1:]))


def test_mixture_edges(spark):
    spec = "doc_id long, text string, source string, row string, cut int, taken int, slot string, n_chars string"
    rows = [(k % 40 if k % 7 else None, " ".join(["a", "b", "c"] * (k % 11)) if k % 13 else None, "big" if k % 3 else None, "r", 1, 2, "s", "x") for k in range(400)]
    rows += [(1000, " \n", "big", "r", 1, 2, "s", "x"), (1001, "", "none", "r", 1, 2, "s", "x"), (1002, "w " * 40_000, "long", "r", 1, 2, "s", "x")] + [rows[5]] * 30
    docs = spark.createDataFrame(rows, spec)
    found = mixing.apply_mix(docs, block=32)
    assert found.columns == docs.columns and mixing.apply_mix(docs.limit(0)).count() == 0
    kept = found.collect()
    assert {(r.row, r.cut, r.taken, r.slot) for r in kept} == {("r", 1, 2, "s")}
    words = sum(len(r.text.split()) for r in kept)
    sums = mixing.mix_sources(docs, block=32)
    assert sums.count() == len(rows) and words == sums.agg(F.sum("taken")).first()[0]
    known = {(i, " ".join((t or "").split()), s) for i, t, s, *_ in rows}
    assert all(any(i == r.doc_id and s == r.source and t.startswith(" ".join(r.text.split())) for i, t, s in known) for r in kept)
    assert all(r.n_chars == "x" or int(r.n_chars) == len(r.text) for r in kept)


def test_equal_rows_are_spread(spark, monkeypatch):
    """More equal rows than a range holds go to ranges of their own; targets hold all the same."""
    monkeypatch.setattr(mixing, "RANGE", 10)
    texts = [(None, "x y z", "a")] * 300 + [(k, "u v " * (k % 9), "ab"[k % 2]) for k in range(200)]
    docs = docs_of(spark, texts)
    placed, _ = mixing._streams(docs, 3)
    rows = placed.where("size > 0").collect()
    for source in "ab":
        at = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: r.before):
            assert r.before == at
            at += r.size
    got = mixing.mix_sources(docs, block=16).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.5 for r in got)


def test_word_counts():
    import pyarrow as pa

    texts = ["", " ", "a", " a", "a ", "a\tb\r\nc", None, "é\u00a0ü x", "x" * 10, "\x0b\x0c", "a  b", "b", None, "", "c"]
    want = [len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]) for t in texts]
    assert mixing.word_counts(pa.array(texts)).tolist() == want
    assert mixing.word_counts(pa.array([], pa.string())).tolist() == []


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(k, k * 997) for k in range(1, 9)], "source_no long, take long")
    slots = sorted(map(tuple, mixing.schedule(targets, 10).collect()))
    for k in range(1, 9):
        own = [(r, f) for _, s, r, f in slots if s == k]
        assert sorted(r for r, _ in own) == list(range(-(-k * 997 // 10))) and sum(f for _, f in own) == k * 997
    half = slots[: len(slots) // 2]
    for k in range(1, 9):
        share = sum(f for _, s, _, f in half if s == k) / sum(f for *_, f in half)
        assert abs(share - k / 36) < 0.01


# ---- top-k -------------------------------------------------------------------


def brute_top(rows, k):
    clean = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(clean, key=lambda r: [-x for x in r[1]]) if i % 5 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("n, scale", [(120, 1.0), (3, 1.0), (60, 1e5)])
def test_top_k(spark, n, scale):
    rng = np.random.default_rng(n)
    rows = [(int(k), [float(x) * scale for x in rng.normal(size=8)]) for k in range(n)]
    rows += [(200 + k, rows[1][1]) for k in range(30)]  # one vector many times: ties go to the smaller id
    rows += [(300, None), (305, [1.0, None] + [0.0] * 6), (310, [float("nan")] * 8), (315, [float("inf")] + [0.0] * 7), (None, rows[0][1]), rows[1], (400, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string").repartition(5)
    got = topk.top_k(df, df.where("vec_id % 5 = 0"), k=4)
    want = [r for r in brute_top([(i, (v + [0.0] * (8 - len(v))) if v is not None else None) for i, v in rows], 4)]
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=6)]) for k in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_VALUES", 24)
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 5 = 0"), k=3).collect())) == brute_top(rows, 3)


# ---- toxicity's entries ------------------------------------------------------


def test_all_entries_are_kept(spark):
    """A level has as many entries as differ between the classes, the most frequent first."""
    n, alike = 200_500, 500
    cells = {f"n{p}_{c}": (F.when(F.col("pair") < alike, 30).otherwise(c * 30 + F.col("pair") % 2)).cast("long") for p, c in toxicity._CELLS}
    df = spark.range(n + alike).select((F.col("id")).alias("pair")).withColumns(cells)
    keys, counts, kept, column = toxicity._entries(df, np.full((toxicity.PARTS + 1, 2), 1e9), "pair")
    assert len(keys) == n and kept.all() and counts.shape == (n, toxicity.PARTS + 1, 2)
    odd = [k for k in range(alike, n + alike) if k % 2]
    assert keys[: len(odd)].tolist() == odd and set(column["pair"].tolist()) == set(range(alike, n + alike))


# ---- pipeline ----------------------------------------------------------------


def test_stages_edges(spark, tmp_path):
    """Every stage on nulls, empty, very long and repeated texts, ties, extra columns of any names, and on no rows."""
    import corpus_pipeline

    docs, labels = made_corpus(spark, 60)
    names = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long", "slot": "string", "score": "double", "component_id": "string", "sequence_id": "string"}
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "a", 0.5, "c", "q") for r in docs.collect()]
    rows += [(None, None, None, None, None, None, None, None, None), (700, "", "en", "s", 0, "a", 0.5, "c", "q"), (701, " \n", "en", None, 2, "a", 0.5, "c", "q")]
    rows += [rows[1]] * 3 + [(702, " ".join(f"word{k % 300}" for k in range(30_000)), "en", "t", 1, "a", 0.5, "c", "q"), (None, "word1 word2 word3", "en", "t", 1, "a", 0.5, "c", "q")]
    odd = spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in names.items()))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    known = {(r[0], r[1]) for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        if name != "packing":
            assert out.columns == odd.columns, name
        if name in ("toxicity", "quality_classifier", "minhash_near_dedup"):
            assert {(r.doc_id, r.text) for r in out.collect()} <= known and out.count() <= len(rows), name
        assert out.count() > 0 and stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, odd, str(tmp_path)).collect()}
    assert {700, 701, 702, None} <= kept


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns, name
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert out.agg(F.sum("length")).first()[0] > 0


def test_stages_as_plain_python(spark, tmp_path):
    """Each stage's rows, and run()'s, against plain versions on a small corpus."""
    import corpus_pipeline
    import public_tokenizers
    import pyarrow as pa
    from test_dedup import brute
    from tokenizers import Tokenizer

    docs, labels = made_corpus(spark)
    rows = [tuple(r)[:5] for r in docs.collect()]
    # Near and exact copies of some, in two sources.
    rows += [(1000 + k, rows[k][1] + (" copy" if k % 2 else ""), "en", "t", 0) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet").cache()
    stages, held = dict(corpus_pipeline.STAGES), lambda df: [(r.doc_id, r.text) for r in df.collect()]
    for name, module, keep in (("toxicity", toxicity, lambda x: x < 0.7), ("quality_classifier", quality, lambda x: x >= 0.3)):
        before = held(at)
        score = module.scores(pa.array([t for _, t in before]), module.fit(at, labels))
        at = stages[name](spark, at, str(tmp_path)).cache()
        assert sorted(held(at)) == sorted(d for d, x in zip(before, score, strict=True) if keep(x)), name
        assert 0 < at.count() < len(before), name
    before = held(at)
    at = stages["minhash_near_dedup"](spark, at, str(tmp_path)).cache()
    assert sorted(i for i, _ in held(at)) == sorted(i for i, _, _, kept in brute(before, 5) if kept)
    assert at.count() < len(before)
    sizes, texts = {}, dict(held(at))
    for r in at.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    at = stages["source_mixing"](spark, at, str(tmp_path)).cache()
    mixed = at.collect()
    assert all(texts[r.doc_id].startswith(r.text) for r in mixed)
    taken = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in sizes}
    assert taken == {s: int(t + 0.5) for s, t in brute_targets(sizes).items()}
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    want = {}
    for r in mixed:
        want[r.doc_id] = want.get(r.doc_id, 0) + len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    for out in (stages["packing"](spark, at, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        got = {}
        for r in out.collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert got == want
