import numpy as np
import xxhash

from scriptorium.llm import simhash as S


SPREAD = list(range(10)) + [62, 63]


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(values):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_fingerprint():
    for text in (None, "", " \n", "One", "one TWO", "ÀB c d e", "a b c " * 50, "x\x0by\x1cz w"):
        assert S.fingerprint(text) == brute(text)
    assert S.fingerprint("A B C D") == S.fingerprint("a b\nc\td") and S.fingerprint("É b c") != S.fingerprint("é b c")


def test_nearby_in_each_way(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = [np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in rng.integers(0, 12, rng.integers(1, 7))]) for _ in range(300)]
    x = np.unique(np.array([base[i % 4] ^ f for i, f in enumerate(flips)], np.uint64))
    want = closure([int(v) for v in x])
    assert len(x) > 64 and S.nearby(x).tolist() == want
    monkeypatch.setattr(S, "COMPARED", 64)
    assert S.nearby(x).tolist() == want
    assert S.nearby(x[:40]).tolist() == closure([int(v) for v in x[:40]])


def test_groups(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(40, 120))) for _ in range(60)]
    for i in range(60):
        words = texts[i % 20].split()
        words[rng.integers(0, len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0]] * 30 + [None, "", " ", "only two", "Only  TWO"]
    rows = [(1000 - i, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(df).collect()}
    label = closure([brute(t) for t in texts])
    smallest = {}
    for (i, _, _), k in zip(rows, label, strict=True):
        smallest[k] = min(i, smallest.get(k, i))
    assert got == {i: smallest[k] for (i, _, _), k in zip(rows, label, strict=True)}


def test_crowded_keys(spark, monkeypatch):
    """Fingerprints that crowd under few keys are split and linked as by brute force."""
    rng = np.random.default_rng(8)
    base = [int(v) for v in rng.integers(0, 2**63, 3, dtype=np.uint64)]
    spread = [sum(1 << int(b) for b in rng.choice(SPREAD, rng.integers(0, 9), replace=False)) for _ in range(400)]
    values = sorted({base[i % 3] ^ f for i, f in enumerate(spread)} | {0, 7, (1 << 64) - 1})
    df = spark.createDataFrame([(S.signed(v),) for v in values], "fp long")
    label = closure(values)

    def components():
        edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in S.close_fingerprints(df).collect()]
        parent = {v: v for v in values}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(parent[a], parent[b])
                changed |= parent[a] != low or parent[b] != low
                parent[a] = parent[b] = low
        return [parent[v] for v in values]

    want = [values[k] for k in label]
    assert components() == want and len(set(want)) > 3
    for most in (100, 10, 2):
        monkeypatch.setattr(S, "COMPARED", most)
        assert components() == want


def test_finer_masks():
    """Close fingerprints that agree on a mask share a finer key; a finer key leaves at most 18 bits free."""
    rng = np.random.default_rng(2)
    for mask in S.masks():
        free = [b for b in range(64) if not mask >> b & 1]
        finer = S.finer_masks(mask)
        assert all(m & mask == mask and 64 - (m % 2**64).bit_count() <= 18 for m in finer)
        for _ in range(50):
            diff = sum(1 << int(b) for b in rng.choice(free, 3, replace=False))
            assert any(not m & diff for m in finer)


def test_small_inputs(spark):
    schema = "doc_id long, text string"
    assert S.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    same = S.near_duplicates(spark.createDataFrame([(2, "a b c"), (2, "a b c"), (None, "a b c"), (None, "z y x w")], schema))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in same.collect()) == [("2", "2"), ("2", "2"), ("None", "2"), ("None", "None")]


def test_blocks_cover_every_pair():
    masks = [m & (1 << 64) - 1 for m in S.masks()]
    rng = np.random.default_rng(1)
    for _ in range(500):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & diff for m in masks)


def test_tied_hubs_and_chains(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(80)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(400)} == {0} and {got[1000 + i] for i in range(81)} == {1000}
