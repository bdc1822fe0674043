import numpy as np
import pytest

from scriptorium.llm import maxscore as M


def brute(rows, k=5, every=50):
    clean = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    out = []
    for at, (q, own) in enumerate(clean):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for other, (i, v) in enumerate(clean) if other != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_one_vector_far_longer_than_the_rest(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=int(n)).tolist()) for i, n in enumerate(rng.integers(0, 20, 300))]
    rows += [(1000, rng.normal(size=200_000).tolist()), (1001, rng.normal(size=70_000).tolist()), (1050, rng.normal(size=3000).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole, shards = M.dealt(M.usable(df), 8192, 1 << 12)
    sizes = {}
    for r in M.pack(whole, shards).collect():
        lengths = np.frombuffer(r["sizes"], np.int64)
        sizes[r["shard"]] = len(lengths) * int(lengths.max())
    assert sum(v > 1 << 14 for v in sizes.values()) == 2  # those that hold one of the two long ones alone
    assert sorted(tuple(r) for r in M.top_k(df, shard_values=1 << 12).collect()) == brute(rows)
    assert sorted(tuple(r) for r in M.top_k(df, block_values=1 << 16).collect()) == brute(rows)


@pytest.mark.parametrize("scale", [1, 1000, 10**6, 10**9])
def test_every_kind_of_number_is_exact(scale):
    rng = np.random.default_rng(scale % 97)
    v = np.floor(scale * 100 * rng.normal(size=(900, 9))).astype(np.int64)
    v[rng.random(v.shape) < 0.3] = 0
    ids = rng.permutation(900)
    own = np.array([3, 900, 17])
    q = np.floor(scale * 100 * rng.normal(size=(3, 9))).astype(np.int64)
    q[1] = 0
    scores = [max(M.LOW, min(M.HIGH, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for x in q for y in v]  # held at the limits of 64 bits
    want = [sorted((-s, int(i)) for s, i in zip(scores[n * 900 : n * 900 + 900], ids, strict=True))[:5] for n in range(3)]
    found = [[], [], []]
    for part in np.array_split(np.arange(900), 4):
        found = M.Shard(ids[part], v[part], np.ones(len(part), np.int64)).search(own, q, 5, found)
    assert found == want


def test_a_vector_that_a_third_of_the_rows_share(spark):
    rng = np.random.default_rng(2)
    common = rng.normal(size=8).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(400)] + [(50, common)] * 90
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in M.top_k(df, shard_rows=40).collect()) == brute(rows)
