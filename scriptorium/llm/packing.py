"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

A document is its token ids and an end mark. What is longer than a sequence is cut into whole sequences and a last
piece. Pieces of one length are alike to a packer, so best-fit (longest first, into the fullest sequence that has room)
runs over the counts of lengths: a step puts as many pieces of a length as there are, or as there is room for, into
a run of sequences that are filled alike. The plan is a list of such steps: so many pieces of this length, from this rank on, so
many to each sequence from that one on, at this place in them. A run is filled again only by pieces that are shorter than what was left, which
halves it at least, so the plan has at most some tens of thousands of steps for 2,048 lengths, whatever the number of documents.

Pieces take their slots by their rank within their length: a tokenising task numbers its pieces of each length and
writes them; the numbers that earlier tasks have given are added; and the rank's step is looked up in the plan, which is broadcast. Token ids are not shuffled
where only columns made of them are asked for (`carry`); `sequences` brings the ids of a sequence together.

Words between white space are tokenised by the tokenizers library once and remembered, as its splitting never goes over
white space nor from a Latin letter to a stop behind it. A worker remembers about REMEMBERED of them, and forgets those first that it has not met again.

Cases: a null or empty text is the end mark alone; repeated rows and ids are packed each by itself; ties need no rule, as
any piece of a length may take any of its slots; an empty table has no sequences; a text of any length is cut and packed whole;
strings of special tokens in a text are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LENGTH, END = 2048, 0
#: Words whose ids a worker remembers; when there are more it starts anew.
REMEMBERED = 1 << 19
#: Longer words are encoded each time.
LONGEST = 64
#: Characters that are tokenised at a time.
AT_ONCE = 1 << 22
#: A letter that is one in every version of Unicode, and a stop behind it: no piece goes over these.
STOP = r"([A-Za-zÀ-ÖØ-öø-ſ])([.,;:!?])"
#: Fixed value: how the tokenizer splits lower-cased ASCII words.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PIECE = "task long, local long, piece int, start long, length long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Token ids of texts, by way of those of their words."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        model = self.library.get_vocab()
        self.ends = np.zeros(max(model.values()) + 1, bool)
        self.ends[[i for token, i in model.items() if token.endswith("</w>")]] = True
        self.clear()

    def forget(self) -> None:
        """Keep words that were met again, those met most, and at most half as many as may be remembered."""
        kept = np.flatnonzero(self.met[: self.used] > 1)
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argpartition(-self.met[kept], REMEMBERED // 2)[: REMEMBERED // 2]])
        names = list(self.number)
        starts, sizes, ids, met = self.starts[kept], self.sizes[kept], self.ids, self.met[kept] // 2
        self.clear()
        first = np.cumsum(sizes) - sizes
        self.add([names[i] for i in kept.tolist()], ids[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))], sizes)
        self.met[: self.used] = met

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.sizes, self.met, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.ids, self.filled = np.zeros(4096, np.uint32), 0

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(words) > len(self.starts):
            self.starts, self.sizes, self.met = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes, self.met))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        own = slice(self.used, self.used + len(words))
        self.starts[own], self.sizes[own], self.met[own] = self.filled + np.cumsum(sizes) - sizes, sizes, 0
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.number.update(zip(words, range(own.start, own.stop), strict=True))
        self.used, self.filled = own.stop, self.filled + len(ids)

    def keep(self, words: list[str]) -> None:
        """Encode words and put them behind those that are known."""
        if not words:
            return
        plain = [w for w in words if w.isalpha()]
        for k in range(0, len(plain), 1024):
            part = plain[k : k + 1024]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):  # a word of letters alone is one piece, and ends where that does
                self.add(part, ids, np.diff(stops, prepend=0))
            else:
                self.each(part)
        other = [w for w in words if not w.isalpha()]
        pieces = {w: PIECES.findall(w.lower()) for w in other if w.isascii()}
        # Words of one piece first: the others are made of what is known then.
        self.each([w for w in other if len(pieces.get(w, w)) == 1 or w not in pieces])
        fresh = dict.fromkeys(p for own in pieces.values() for p in own if p not in self.number)
        self.each([p for p in fresh if not p.isalpha()])
        self.keep([p for p in fresh if p.isalpha()])
        whole = [w for w in pieces if w not in self.number]
        known = [[self.number[p] for p in pieces[w]] for w in whole]
        at = np.array([n for own in known for n in own], np.int64)
        sizes = self.sizes[at]
        first = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.starts[at] - first, sizes) + np.arange(int(sizes.sum()))]
        ends = np.cumsum([len(own) for own in known], dtype=np.int64)
        self.add(whole, ids, np.diff(np.r_[0, np.cumsum(sizes)][ends], prepend=0) if whole else sizes)

    def each(self, words: list[str]) -> None:
        for k in range(0, len(words), 1024):
            found = [x.ids for x in self.library.encode_batch(words[k : k + 1024], add_special_tokens=False)]
            self.add(words[k : k + 1024], np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        apart = pc.replace_substring_regex(texts, STOP, r"\1 \2")
        lists = pc.ascii_split_whitespace(apart)
        words = pc.list_flatten(lists).dictionary_encode()
        told = words.dictionary.to_pylist()
        if self.used > REMEMBERED:
            self.forget()
        found = np.fromiter(map(self.number.get, told, repeat(-1)), np.int64, len(told))
        missing = np.flatnonzero(found < 0).tolist()
        self.keep([told[i] for i in missing if len(told[i]) <= LONGEST])
        # Long words stand behind those that are remembered, for this once.
        before, rare = (self.used, self.filled), [told[i] for i in missing if len(told[i]) > LONGEST]
        self.each(rare)
        found[missing] = [self.number[told[i]] for i in missing]
        self.met[found] += 1
        at = found[words.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[at]
        first = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.starts[at] - first, sizes) + np.arange(int(sizes.sum()))]
        for w in rare:
            del self.number[w]
        self.used, self.filled = before
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        total = np.r_[0, np.cumsum(sizes)][bounds]
        return ids, np.diff(total)


def words_for(definition: str) -> Words:
    """This Python worker's words: what it remembers serves the worker's later tasks, too."""
    kept = sys.modules.setdefault("scriptorium words of this worker", types.ModuleType("words")).__dict__
    name = hashlib.sha256(definition.encode()).hexdigest()
    if name not in kept:
        kept[name] = Words(definition)
    return kept[name]


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, rows) of slices with about AT_ONCE bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(sizes):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + AT_ONCE, "right")))
        yield first, last - first
        first = last


def pieces(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """`keep` and PIECE of each piece: the task that made it, its number among the task's pieces of its length, and its ids as little-endian 32-bit integers."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary
    source = docs.select(*[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    kept = [f"__keep{i}" for i in range(len(keep))]
    schema = source.select(*kept).schema
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in schema], PIECE])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, task = words_for(definition.value), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for whole in batches:
            for first, rows in portions(whole.column("__text")):
                batch = whole.slice(first, rows)
                ids, sizes = words.of(batch.column("__text"))
                # Each document's ids and its end mark.
                flat = np.insert(ids, np.cumsum(sizes), end).astype("<u4")
                sizes = sizes + 1
                starts = np.cumsum(sizes) - sizes
                n = -(-sizes // length)
                doc = np.repeat(np.arange(rows), n)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                own = np.minimum(length, sizes[doc] - number * length)
                local = seen[own] + pd.Series(own).groupby(own).cumcount().to_numpy()
                seen += np.bincount(own, minlength=length + 1)
                edges = np.r_[starts[doc] + number * length, len(flat)] * 4
                held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat)])
                taken = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(taken) for c in kept], pa.array(np.full(len(doc), task)), pa.array(local), pa.array(number.astype(np.int32)), pa.array(number * length), pa.array(own), held],
                    names=[*kept, "task", "local", "piece", "start", "length", "ids"],
                )

    return source.mapInArrow(cut, fields)


def planned(counts: Iterable[tuple[int, int]], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, rank, sequence, each, place) of best-fit over counts of lengths, and the number of sequences.

    From this rank on pieces of this length go to the sequences from this one on, `each` to a sequence, the first at this place.
    """
    steps: list[tuple[int, int, int, int, int]] = []
    room: list[int] = []  # what is left in runs of sequences, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # (first sequence, how many) by what is left
    made = 0

    def leave(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in runs:
                insort(room, left)
                runs[left] = []
            runs[left].append((first, n))

    for size, left in sorted(counts, reverse=True):
        rank = 0
        while left:
            k = bisect_left(room, size)
            if k < len(room):
                space = room[k]
                first, n = runs[space].pop()
                if not runs[space]:
                    del runs[space]
                    room.pop(k)
            else:
                space = length
                first, n = made, -(-left // (length // size))
                made += n
            each = space // size
            full = min(n, left // each)
            if full:
                steps.append((size, rank, first, each, length - space))
                leave(space - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                steps.append((size, rank, first + full, left, length - space))
                leave(space - left * size, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                leave(space, first + full, n - full)
    return steps, made


def pack(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), carry: dict[str, Column] | None = None, length: int = LENGTH, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """`keep`, piece, start, length, what is carried, sequence_id and offset of each piece; sequences are numbered from 0 and filled from 0 without gaps.

    carry: columns by name, expressions over `ids`; the ids themselves by default. Only they are written.
    """
    carry = {"ids": F.col("ids")} if carry is None else carry
    cut = pieces(docs, keep, length, tokenizer, end)
    names = [f"__keep{i}" for i in range(len(keep))]
    own = staged(cut.select(*names, "task", "local", "piece", "start", "length", *[c.alias(f"__carry_{n}") for n, c in carry.items()]), "pieces")
    given = own.groupBy(F.col("task").alias("__task"), F.col("length").alias("__length")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("__length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    given = staged(given.select("__task", "__length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before")), "given")
    histogram = [(r["__length"], r["n"]) for r in given.groupBy("__length").agg(F.sum("n").alias("n")).collect()]  # at most `length` rows
    steps, _ = planned(histogram, length)
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)
    plan = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks, known = size.to_numpy(), rank.to_numpy(), plan.value
        first = np.searchsorted(known[:, 0], np.arange(length + 2))  # where each length's steps begin
        at = np.zeros(len(sizes), np.int64)
        for each in np.unique(sizes):
            rows = sizes == each
            a, b = first[each], first[each + 1]
            at[rows] = a + np.searchsorted(known[a:b, 1], ranks[rows], "right") - 1
        step = known[at]
        within = ranks - step[:, 1]
        return pd.DataFrame({"sequence_id": step[:, 2] + within // step[:, 3], "offset": step[:, 4] + within % step[:, 3] * sizes})

    joined = own.join(given.drop("n"), (own["task"] == given["__task"]) & (own["length"] == given["__length"]))
    placed = joined.withColumn("__slot", slot("length", F.col("local") + F.col("__before")))
    carried = [F.col(f"__carry_{n}").alias(n) for n in carry]
    return placed.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], "piece", "start", "length", *carried, F.col("__slot.sequence_id").alias("sequence_id"), F.col("__slot.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, from `pack` with its ids: a sequence has at most as many pieces as tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
