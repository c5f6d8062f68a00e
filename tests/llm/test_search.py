"""Hard negatives, exact top k and the Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import merkle, negatives, threshold, vectors
from tablescope.llm.queries import QUERIES

ROWS = "vec_id bigint, embedding array<float>, label int, q string, ask string, id string"


def rows(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [float(np.float32(x + rng.gauss(0, spread))) for x in c], rng.randrange(4)))
    hot = out[3][1]
    out += [(n + i, hot, i % 3) for i in range(n // 2)]  # copies of one vector: ties
    nan, inf = float("nan"), float("inf")
    out += [(2 * n, None, 1), (2 * n + 50, [nan] * dim, 1), (2 * n + 51, [inf] * dim, 1), (2 * n + 52, [None] + [0.5] * (dim - 1), 1),
            (2 * n + 53, [0.25] * dim, None), (2 * n + 54, [0.0] * dim, 2), (None, [0.5] * dim, 1), (2 * n + 55, [-1.0] * dim, 0), (100, [3.0] * dim, 3), (7, out[7][1], out[7][2])]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in data], ROWS).repartition(5)


def usable(data, with_label):
    found = {}
    for i, v, label in data:
        if i is None or v is None or any(x is None or not isfinite(x) for x in v) or (with_label and label is None):
            continue
        row = (label if with_label else 0, [floor(256 * x) for x in v])
        found[i] = min(found.get(i, row), row)
    return found


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("part_bytes", [vectors.PART_BYTES, 2000])
def test_top_k_matches_brute_force(spark, monkeypatch, part_bytes):
    data = rows(120, 6, 1)
    plain = vectors.query_parts
    monkeypatch.setattr(threshold, "query_parts", lambda v: plain(v, part_bytes))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in threshold.top_k(frame(spark, data), F.col("vec_id") % 10 == 0, k=5).collect()}
    use, want = usable(data, False), {}
    for q in use:
        if q % 10 == 0:
            best = sorted((-dot(use[q][1], v), i) for i, (_, v) in use.items() if i != q)[:5]
            want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want


def test_lists_stop_before_the_end_where_the_bound_allows_it():
    rng = np.random.default_rng(0)
    rows_ = (rng.pareto(1.5, (20_000, 4)) * 100).astype(np.int64)
    ask = np.eye(4, dtype=np.int64)[:2] * 3 + 1
    ids, names = np.arange(20_000), np.array([-1, -2])
    best = vectors.Best(2, 5, int((rows_ ** 2).sum(axis=1).max()))
    scored = threshold.scan_lists(ask, names, rows_, ids, best)
    assert scored < 0.2 * 2 * len(rows_)
    for n in range(2):
        want = sorted(zip(-(rows_ @ ask[n]), ids))[:5]
        assert [(-s, i) for s, i in want] == list(zip(best.scores[n], best.ids[n]))


@pytest.mark.parametrize("scale", [256, 1 << 18])
def test_negatives_match_brute_force(spark, scale):
    data = rows(120, 6, 2, spread=0.6)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    got = sorted(tuple(r) for r in negatives.mine_negatives(frame(spark, data), F.col("vec_id") % 10 == 0, label, scale=scale).collect())
    use = {}
    for i, v, c in data:
        if not (i is None or v is None or c is None or any(x is None or not isfinite(x) for x in v)):
            row = ((c + 1) % 4 if i % 7 == 0 else c, [floor(scale * x) for x in v])
            use[i] = min(use.get(i, row), row)
    want = []
    for a, (c, v) in use.items():
        if a % 10:
            continue
        scored = sorted((-dot(v, w), i, d) for i, (d, w) in use.items() if i != a)
        for s, p in [(-s, i) for s, i, d in scored if d == c][:5]:
            near = [(i, -t) for t, i, d in scored if d != c and 50 * s <= -100 * t <= 95 * s][:3]
            want += [(a, p, r + 1, i, s, t) for r, (i, t) in enumerate(near)]
    assert got == sorted(want) and len({r[:2] for r in want}) > 20


@pytest.mark.parametrize("dim,size", [(1, 5), (64, 300), (3000, 20), (64, 1 << 20), (5, 1 << 24)])
def test_residue_product_is_exact(dim, size):
    rng = np.random.default_rng(dim)
    a, b = (rng.integers(-size, size + 1, (7, dim)) for _ in range(2))
    a[0], b[0] = size, -size
    bound = dim * size * size
    system = negatives.Residues(dim, bound)
    assert (system.product(system.split(a), system.split(b)) == a @ b.T).all()
    assert all(all(p % d for d in range(2, p)) for p in system.primes) and len(set(system.primes)) == len(system.primes)


def test_searches_on_empty_tables_lone_rows_and_long_vectors(spark):
    empty = frame(spark, [])
    assert threshold.top_k(empty, F.lit(True)).count() == 0
    assert negatives.mine_negatives(empty, F.lit(True), F.col("label")).count() == 0
    one = frame(spark, [(50, [1.0], 1)])
    assert threshold.top_k(one, F.lit(True)).count() == 0 and negatives.mine_negatives(one, F.lit(True), F.col("label")).count() == 0
    few = frame(spark, [(1, [1.0] * 9000, 1), (2, [2.0] * 8999, 1), (3, [], 1)])
    got = sorted(tuple(r) for r in threshold.top_k(few, F.col("vec_id") == 1).collect())
    assert got == [(1, 1, 2, 256 * 512 * 8999), (1, 2, 3, 0)]
    with pytest.raises(ValueError):
        threshold.top_k(frame(spark, [(1, [3e38], 1)]), F.lit(True))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root and, per leaf, [(place, others)] from the leaf up."""
    at, paths, last = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(last) > 1:
        for k, p in enumerate(at):
            run = last[p - p % 3:p - p % 3 + 3]
            paths[k].append((p % 3, run[:p % 3] + run[p % 3 + 1:]))
        at, last = [p // 3 for p in at], [sha("".join(last[i:i + 3])) for i in range(0, len(last), 3)]
    return last[0], paths


def brute(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[d[1]].append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        groups[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        subs[s] = tree([leaf(d) for d in groups[s]])
    root, tops = tree([subs[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for d, path in zip(groups[s], subs[s][1]):
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None
            node = leaf((*d[:4], d[4].replace("\n", ""))) if changed else leaf(d)
            for place, others in path + top:
                node = sha("".join(others[:place]) + node + "".join(others[place:]))
            out.append((d[0], leaf(d), subs[s][0], root, sha("".join(x for _, o in path + top for x in o)), node, node == root))
    return sorted(out, key=str)


def corpus(sizes):
    rng, out, i = random.Random(4), [], 0
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "é\nü", "one line", "two\nlines", "x" * 200_000]) if i < 40 else f"row {i}\n"
            out.append((i * 3, s, rng.choice([None, "en", "日本"]), rng.choice([None, 5]), text))
            i += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes,levels", [
    ({"a": 1}, 5), ({"a": 3, None: 4, "": 1}, 5), ({"z": 61, None: 9, "ä": 2, "b": 27, "B": 1, "": 28, "c": 10}, 1),
    ({f"s{k}": k % 5 + 1 for k in range(40)} | {"hot": 250}, 2), ({"all": 244}, 5)])
def test_manifest_matches_brute_force(spark, monkeypatch, tmp_path, sizes, levels):
    docs = corpus(sizes)
    if len(docs) > 3:
        docs += [docs[0], (None, docs[0][1], None, None, "no id\n")]  # a repeated row and one without id
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumn("proof", F.lit("clash")).withColumn("_n", F.lit(1)).write.parquet(path)
    plain = merkle.prove
    monkeypatch.setattr(merkle, "prove", lambda items, fanout=3: plain(items, fanout, levels))
    got = sorted((tuple(r) for r in QUERIES["op13_merkle_manifest"][0](spark, str(tmp_path)).collect()), key=str)
    assert got == brute(docs)


def test_manifest_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op13_merkle_manifest"][0](spark, str(tmp_path)).count() == 0
