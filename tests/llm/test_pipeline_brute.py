"""The pipeline against plain second implementations of its stages, one after another, over a whole small table."""

import hashlib
import os
import re
from collections import defaultdict

import pytest

from scriptorium.llm import mixing as X
from scriptorium.llm import site_quality as S
from tests.llm.test_language_and_quality_brute import plain_languages, plain_quality
from tests.llm.test_mixing_targets import plain_topics
from tests.llm.test_near_copies import brute, closure

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
FOLDER = "/root/testdata/sf0.001"


def plain_targets(share, margin):
    given = {k: margin.weights[k] for k in share if k in margin.weights}
    own = {k: v**margin.power for k, v in share.items()}
    others = sum(v for k, v in own.items() if k not in given) if margin.weights else sum(own.values())
    left = 1 - others / sum(own.values()) if given else 0.0
    raw = {k: given[k] * left / sum(given.values()) if k in given else own[k] / sum(own.values()) for k in share}
    most = {k: v / X.FRACTION for k, v in share.items()}
    whole = set()
    while True:  # the levels that are smaller than their target are taken whole, until none is left
        scale = (1 - sum(most[k] for k in whole)) / max(1e-300, sum(raw[k] for k in raw if k not in whole))
        more = {k for k in raw if k not in whole and scale * raw[k] > most[k]}
        if not more:
            return {k: most[k] if k in whole else scale * raw[k] for k in raw}
        whole |= more


def plain_mix(rows):
    topic = plain_topics([t for _, t, _, _ in rows])
    told = [(i, (source, lang, topic(t)), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, lang, source in rows]
    cells = defaultdict(int)
    for _, cell, n in told:
        if n:
            cells[cell] += n
    total = sum(cells.values())
    targets = []
    for i, m in enumerate(X.MARGINS):
        share = defaultdict(float)
        for cell, n in cells.items():
            share[cell[i]] += n / total
        targets.append(plain_targets(share, m))
    weight = {c: n / total for c, n in cells.items()}

    def sums(i):
        out = defaultdict(float)
        for c, w in weight.items():
            out[c[i]] += w
        return out

    for r in range(X.ROUNDS):
        for i in range(3):
            held = sums(i)
            weight = {c: min(cells[c] / total / X.FRACTION, w * targets[i][c[i]] / held[c[i]]) for c, w in weight.items()}
        if r % X.CHECKED == X.CHECKED - 1 and max(abs(held / targets[i][k] - 1) for i in range(3) for k, held in sums(i).items()) <= X.NEAR:
            break
    kept = []
    for i, cell, n in told:
        p = min(1.0, weight[cell] * X.FRACTION * total / cells[cell]) if n else 1.0
        if int(hashlib.md5(f"{X.SEED}:{i}".encode()).hexdigest()[:12], 16) / 2**48 < p:
            kept.append(i)
    return kept


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
def test_run_equals_the_plain_stages(spark):
    import corpus_pipeline as C

    docs = {r["doc_id"]: (r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    left = [docs[i] for i, near, _ in plain_languages([(i, t, lang) for i, t, lang, _ in docs.values()]) if near]
    left = [docs[i] for i, _, _, _, posterior in plain_quality(left, labels) if posterior >= S.LEAST_POSTERIOR]
    groups = defaultdict(list)
    for row, label in zip(left, closure([brute(t) for _, t, _, _ in left]), strict=True):
        groups[label].append(row[0])
    left = [docs[i] for i in sorted(min(g) for g in groups.values())]
    kept = plain_mix(left)
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(docs[i][1]) for i in kept}
    got = {r["doc_id"]: list(r["ids"]) for r in C.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(want) < len(left) < len(docs)
