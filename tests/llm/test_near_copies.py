import numpy as np

from scriptorium.llm import near_copies as N


def brute(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def closure(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def varied():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(25)]
    for i in range(75):
        words = texts[i % 25].split()
        for _ in range(1 + i % 4):
            words[rng.integers(0, len(words))] = "changed"
        texts.append(" ".join(words))
    return [*texts, *[texts[0]] * 20, None, "", " ", "only two", "Only  TWO"]


def test_components(spark):
    texts = varied()
    df = spark.createDataFrame([(1000 - i, t, 7) for i, t in enumerate(texts)] + [(None, texts[0], 7)], "doc_id long, text string, sid int")
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(df).collect()}
    label = closure([brute(t) for t in texts])
    smallest = {}
    for i, k in enumerate(label):
        smallest[k] = min(1000 - i, smallest.get(k, 1000))
    assert got == {1000 - i: smallest[k] for i, k in enumerate(label)}
    assert N.near_copies(df.limit(0)).count() == 0


def test_pairs_that_a_hub_misses(spark):
    # Two copies of one text, changed at either end: each near the middle one, not near each other.
    words = [f"w{i}" for i in range(104)]
    middle, left, right = " ".join(words), " ".join([f"x{i}" for i in range(9)] + words[9:]), " ".join(words[:95] + [f"y{i}" for i in range(9)])
    assert N.similarity(N.shingle_set(left), N.shingle_set(right)) < 0.8 <= N.similarity(N.shingle_set(left), N.shingle_set(middle))
    df = spark.createDataFrame([(1, left), (2, right), (3, middle), (4, "else " * 30)], "doc_id long, text string")
    assert sorted(tuple(r) for r in N.near_copies(df).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_stage_leaves_no_pair_of_the_rule(spark):
    import corpus_pipeline as C
    from scriptorium.llm.simhash import fingerprint

    texts = [t for t in varied() if t and t.strip()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"], r["text"]) for r in C.near_dedup(spark, docs, "").collect())
    label = closure([brute(t) for t in texts])
    assert [i for i, _ in kept] == sorted({k: i for i, k in reversed(list(enumerate(label)))}.values())
    assert any(label[i] == label[j] and (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 3 for i in range(100) for j in range(i))
