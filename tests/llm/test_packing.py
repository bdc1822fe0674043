import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import packing as P


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(P.default_tokenizer())
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def words():
    with open(P.default_tokenizer(), encoding="utf-8") as file:
        return P.Words(file.read())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def checked(words, library, texts):
    ids, sizes = words.of(pa.array(texts, pa.string()))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    for text, part in zip(texts, parts, strict=True):
        assert part.tolist() == ids_of(library, text), text[:80]


ODD = ["", " ", "a", "It's we'll they'd.I'm", "a,b.c;d:e!f?g", "x.̸y a,̀b", "été ́a", "İstanbul ΑΣΣ ß ﬁ", "\x1c\x1d\x85 a b", "<|startoftext|> <|endoftext|>", "12,345.67 #$%", "日本語 テキスト", "🙂🙂 a🙂", "don't.stop 's 't", "a" * 300 + " " + "b" * 80 + ".", "\t\n\x0b\x0c\r", "가각 각", "a\x00b"]


def test_ids_are_the_librarys(words, library):
    checked(words, library, ODD)
    checked(words, library, ODD[::-1] * 2)  # from what is remembered
    checked(words, library, [x + y for x in ODD[:14] for y in ODD[:14]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aAé.,'!?; \n\t019<|>́İ")), st.characters(exclude_categories=("Cs",))), max_size=60), min_size=1, max_size=8))
def test_ids_of_any_texts(words, library, texts):
    checked(words, library, texts)


def test_what_is_remembered_is_bounded(library, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 50)
    with open(P.default_tokenizer(), encoding="utf-8") as file:
        words = P.Words(file.read())
    for k in range(6):
        checked(words, library, [f"word{i} {'x' * 70}{i} other{i % 3}" for i in range(k * 40, k * 40 + 40)])
    assert words.used <= 200


def best_fit(sizes, length):
    """One piece after another, longest first, each into the fullest sequence that has room."""
    room = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, left in enumerate(room) if left >= size]
        at = min(fitting, key=lambda i: room[i], default=None)
        if at is None:
            room.append(length - size)
        else:
            room[at] -= size
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=120))
def test_plan_is_best_fit(sizes):
    counts = Counter(sizes)
    steps, made = P.planned(counts.items(), 24)
    assert made == best_fit(sizes, 24)
    held = defaultdict(list)
    for size, n in counts.items():
        own = sorted(s for s in steps if s[0] == size)
        assert own[0][1] == 0
        for rank in range(n):
            _, first, sequence, each, place = max(s for s in own if s[1] <= rank)
            within = rank - first
            held[sequence + within // each].append((place + within % each * size, size))
    assert sorted(held) == list(range(made))
    for parts in held.values():
        at = 0
        for place, size in sorted(parts):
            assert place == at
            at += size
        assert at <= 24


def test_plan_stays_small():
    rng = np.random.default_rng(1)
    counts = [(n, int(c)) for n, c in enumerate(rng.integers(1, 10**9, 2048), 1)]
    steps, made = P.planned(counts, 2048)
    assert len(steps) < 40_000
    assert made < 1.02 * sum(n * c for n, c in counts) / 2048  # no length here is rare enough to fill gaps as it likes
    short = [(n, c) for n, c in counts if n < 700]
    assert P.planned(short, 2048)[1] < 1.0001 * sum(n * c for n, c in short) / 2048


def test_pieces_and_slots(spark, library):
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(rng.choice(["stone", "river.", "Été", "x,y", "don't", "unfathomably"], n))
    rows = [(i, draw(int(n))) for i, n in enumerate(rng.integers(0, 60, 150))] + [(200, None), (201, ""), (None, "no id"), (3, "again"), (3, "again"), (300, draw(2000))]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, piece string, sequence_id int").repartition(5)
    found = P.pack(df, length=64).collect()
    expected = Counter()
    for i, t in rows:
        ids = [*ids_of(library, t), 0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            expected[i, k // 64, k, len(part), np.array(part, "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in found) == expected
    held = defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    assert len(held) == best_fit([r["length"] for r in found], 64)
    for parts in held.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    again = P.pack(df, length=64, carry={"crc": F_crc()})
    assert sorted(zlib.crc32(r[4]) for r in expected.elements()) == sorted(r["crc"] for r in again.collect())
    whole = {r["sequence_id"]: r for r in P.sequences(P.pack(df, length=64)).collect()}
    assert sum(r["n_tokens"] for r in whole.values()) == sum(len(r["ids"]) // 4 for r in whole.values()) == sum(r["length"] for r in found)
    assert P.pack(df.limit(0), length=64).count() == 0


def F_crc():
    from pyspark.sql import functions as F

    return F.crc32("ids")


def test_query_over_whole_table(spark, library):
    from scriptorium.llm.queries import op11_packing

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = op11_packing(spark, "/root/testdata/sf0.001").collect()
    expected = set()
    for i, t in docs.items():
        ids = np.array([*ids_of(library, t), 0], "<u4")
        expected |= {(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    assert len(found) == len(expected)
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == expected
    assert len({r["sequence_id"] for r in found}) == best_fit([r["length"] for r in found], 2048)
