import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithic.llm import fingerprint, minhash, store
from lithic.llm.components import connected_components
from lithic.llm.words import shingles_of, text_slices, words_of

SPEC = "doc_id long, text string, lang string, source string, n_chars long, kept string, label int"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x", 1) for k, t in texts], SPEC)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(texts, width):
    sets = [shingle_set(t, width) for _, t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)), i is not None and least.get(find(k)) == i) for k, (i, _) in enumerate(texts)]


def edited_copies(rng, n_base, copies, length):
    """Originals with copies of every degree of change, most of them about as far away as links reach."""
    out = []
    for b in range(n_base):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        out.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("keys", [minhash.min_max_bands, fingerprint.band_keys])
def test_same_groups_as_brute_force(spark, keys):
    rng = random.Random(5)
    texts = edited_copies(rng, 4, 40, 90) + ["", None, " \n", "One two", "one TWO", "One two three", "É é", "é É"] + ["same words over and over again"] * 12
    rows = [(k * 3 % 1000, t) for k, t in enumerate(texts)]
    got = minhash.near_duplicates(docs_of(spark, rows), 4, 80, keys).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, 4), key=repr)


def test_pairs_of_a_crowd_follow_its_size(spark, monkeypatch):
    """Copies beyond the threshold of a crowd's original aren't compared with all of its copies within."""
    rng = random.Random(21)
    base, texts = [f"w{k}" for k in range(150)], [" ".join(f"w{k}" for k in range(150))]
    for _ in range(700):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    rows, made, pairs = list(enumerate(texts)), [], minhash._pairs
    monkeypatch.setattr(minhash, "_pairs", lambda *a: made.append(pairs(*a).count()) or pairs(*a))
    got = minhash.near_duplicates(docs_of(spark, rows).repartition(3), 5, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, 5), key=repr)
    assert len(made) > 2 and sum(made[2:]) <= 2 * len(rows)


def test_an_exploded_table_is_not_broadcast(spark, monkeypatch):
    """Spark takes the bands' size from a file with a list of them for each set, so the driver would hold all bands as rows."""
    n, executions, of = 2_000, spark._jsparkSession.sharedState().statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    monkeypatch.setattr(store, "GUESSED_BYTES", 8 * 1024, raising=False)
    was = spark.conf.get(limit)
    spark.conf.set(limit, "256k")
    # Of every two texts 8 of 10 shingles are shared.
    text = "concat_ws(' ', transform(sequence(0, 11), k -> md5(concat(if(k = 11, id + 100000, id div 2), ',', k))))"
    before = max([e.executionId() for e in of(executions.executionsList())], default=-1)
    got = minhash.near_duplicates(spark.range(n).select(F.col("id").alias("doc_id"), F.expr(text).alias("text")), 4, 80).agg(F.count("*"), F.count_if("kept")).first()
    assert tuple(got) == (n, n // 2)
    assert (spark.conf.get(limit), spark.conf.get(measured, None)) == ("256k", None)
    spark.conf.set(limit, was)
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows = []
    for run in [e.executionId() for e in of(executions.executionsList()) if e.executionId() > before]:
        found = of(executions.executionMetrics(run))
        metrics = [m for node in of(executions.planGraph(run).allNodes()) if node.name() == "BroadcastExchange" for m in of(node.metrics())]
        rows += [int(found[m.accumulatorId()].replace(",", "")) for m in metrics if m.name() == "number of output rows" and m.accumulatorId() in found]
    assert rows and max(rows) <= 2 * n


def test_near_groups_as_brute_force(spark):
    rng = random.Random(12)
    texts = edited_copies(rng, 4, 25, 90) + ["", None, " \n", "One two", "one TWO", "One two three"] + ["same words over and over again"] * 5
    rows = [(k * 7 % 1000, t) for k, t in enumerate(texts)]
    got = fingerprint.near_groups(docs_of(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, fingerprint.SHINGLE), key=repr)


def test_edge_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (3, "A B c d e f"), (9, None)]
    got = sorted(map(tuple, minhash.near_duplicates(docs_of(spark, rows)).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(7, 3, False), (7, 3, False), (None, 3, False), (None, None, False), (3, 3, True), (9, 9, True)], key=repr)
    kept = minhash.deduplicate(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, 3), (False, 9)]
    assert kept.count() == 3
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0 and minhash.deduplicate(docs_of(spark, [])).count() == 0


def test_dedup_edges(spark):
    """Very long texts count whole, and columns may have the result's names."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    other = long.rsplit(" ", 9_000)[0] + " " + " ".join(f"x{k}" for k in range(9_000))
    near = long.replace(" w1", " y1", 300)
    rows = [(1, long), (2, other), (3, near), (4, long + " "), (5, None), (6, " \n"), (None, long), (8, "short one"), (8, "short one")]
    docs = docs_of(spark, rows).withColumn("component_id", F.lit("c")).withColumn("n_shingles", F.lit(1.5)).withColumn("group_key", F.lit(None).cast("string")).withColumn("again", F.lit(True))
    got = minhash.near_duplicates(docs, 4, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, 4), key=repr)
    kept = minhash.deduplicate(docs, 4, 80)
    assert kept.columns == docs.columns
    want = sorted([i for i, _, _, k in brute(rows, 4) if k and i != 8] + [8])
    assert sorted(r.doc_id for r in kept.collect()) == want and {r.component_id for r in kept.collect()} == {"c"}
    assert minhash.deduplicate(docs.limit(0)).columns == docs.columns and minhash.deduplicate(docs.limit(0)).count() == 0


def test_min_and_max_of_each_permutation():
    """The signature by plain Python: one hash gives two values."""
    shingles = np.random.default_rng(4).integers(0, 2**63, 50, dtype=np.uint64)
    a, b = minhash.permutations(minhash.PERMUTATIONS)
    sig = minhash.min_max_signatures(shingles, np.array([20, 0, 30]))
    for row, own in ((0, shingles[:20]), (2, shingles[20:])):
        for k in range(minhash.PERMUTATIONS):
            values = [((int(s) * int(a[k]) + int(b[k])) % 2**64) >> 32 for s in own]
            assert (sig[row, 2 * k], sig[row, 2 * k + 1]) == (min(values), max(values))
    assert not sig[1].any()


def test_long_text_and_slices():
    text = "word" * 400_000 + " tail of it"
    array = pa.array(["a b", text, None, "c"])
    found = [np.concatenate(x) for x in zip(*(words_of(d, o) for _, d, o in text_slices(array)), strict=True)]
    assert found[1].tolist() == [2, 4, 0, 1]
    one = words_of(*[x for _, *x in text_slices(pa.array(["c"]))][0])
    assert found[0][-1] == one[0][0]
    shingles, counts = shingles_of(np.arange(7, dtype=np.uint64), np.array([2, 0, 5]), 4)
    assert counts.tolist() == [1, 0, 2] and len(shingles) == 3


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    both, a, b = rng.integers(0, 2**63, (3, 400), dtype=np.uint64)
    sig = minhash.min_max_signatures(np.concatenate([both, a, both, b]), np.array([800, 800]))
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.13


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    # Any graph, with names that have nothing to do with its edges.
    names = rng.sample(range(10**6), 400)
    edges = [(names[k], names[k + 1 if k % 9 else rng.randrange(400)]) for k in range(399)]
    parent = {n: n for n in names}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for e in edges for x in e}}


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [(k * 5, " ".join(rng.choice(["ab", "cd", "ef", "é", "gh"]) + str(rng.randrange(99)) for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    texts += [(11, texts[3][1]), (12, None), (13, ""), (14, "x" * 300_000), (12, None)]
    rng.shuffle(texts)
    found = fingerprint.fingerprint_documents(docs_of(spark, texts).repartition(5)).collect()
    assert len(found) == len(texts)
    import hashlib

    order = sorted(texts, key=lambda r: (r[0], r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, f = t or "", order[(k + 1) % len(order)][1] or ""
        want.append((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == sorted(want)
    by_text = {}
    for r in found:
        by_text.setdefault({i: t or "" for i, t in texts}[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    # Likeness against the true Jaccard similarity of the five-word shingles.
    text_of = {i: t or "" for i, t in order}
    for k, (i, t) in enumerate(order[:40]):
        a, b = shingle_set(t, 5), shingle_set(fingerprint.edited(t or "", order[k + 1][1] or ""), 5)
        true = len(a & b) / len(a | b) if a | b else 1.0
        est = next(r.near_edited for r in found if r.doc_id == i)
        assert abs(est - true) < 0.22
    assert text_of and fingerprint.fingerprint_documents(docs_of(spark, [])).count() == 0
    clashing = docs_of(spark, texts).withColumn("fingerprint", F.lit("x")).withColumn("near_next", F.lit(None)).withColumn("kind", F.lit(1))
    again = fingerprint.fingerprint_documents(clashing.repartition(3)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.edited_sha256) for r in again) == sorted((r.doc_id, r.fingerprint, r.edited_sha256) for r in found)
    one = fingerprint.fingerprint_documents(docs_of(spark, [(1, "abcd")])).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
