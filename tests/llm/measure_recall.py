"""Recall of near-duplicate links against all exact ones, on a generated table; run by hand:

    python tests/llm/measure_recall.py [documents]

Families are an original and its copies, each edited in up to a fourth of its words, so links lie on both sides of the
threshold; one family is a crowd.  Originals share no shingle, so all exact pairs are within families.
"""

import random
import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__  # noqa: E402
from lithic.llm import minhash  # noqa: E402

WIDTH, PERCENT = 4, 80


def family(rng: random.Random, name: int, copies: int, length: int) -> list[str]:
    base = [f"f{name}w{rng.randrange(10**6)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(0, length // 12)):
            own[rng.randrange(length)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def exact(texts: list[str]) -> list[tuple[int, int]]:
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + WIDTH]) for k in range(len(w) - WIDTH + 1)})
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= PERCENT * (len(a) + len(sets[j]) - both):
                out.append((j, i))
    return out


def main(n: int) -> None:
    rng = random.Random(17)
    families = [family(rng, 0, n // 10, 60)]
    while sum(map(len, families)) < n:
        families.append(family(rng, len(families), rng.choice([0, 0, 1, 2, 5, 30]), rng.randrange(20, 200)))
    rows, pairs = [], []
    for texts in families:
        pairs += [(len(rows) + a, len(rows) + b) for a, b in exact(texts)]
        rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    __spark_entry__._ship(spark)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), WIDTH, PERCENT).collect()}
    parent = {k: k for k, _ in rows}

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    groups = defaultdict(set)
    for k in parent:
        groups[find(k)].add(k)
    kept = sum(found[a] == found[b] for a, b in pairs)
    same = sum(found[k] == find(k) for k in parent)
    print(f"{len(rows)} documents, {len(pairs)} exact pairs, {sum(len(g) > 1 for g in groups.values())} groups, the largest of {max(map(len, groups.values()))}")
    print(f"pairs found {kept / max(1, len(pairs)):.6f}, documents with the exact component_id {same / len(rows):.6f}")


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 20_000)
