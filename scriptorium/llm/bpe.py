"""Byte-level BPE encoding and decoding by a monoid tree reduction.

The vocabulary is a rank file (its path is a parameter; it is read on the driver and broadcast, its
size is that of the file). Every text is halved down to leaves of LEAF characters. The encoding of a span is
the list of its pieces (matches of the pattern) with the tokens of each; two neighbours are joined by
re-encoding a window around their seam that grows until what lies outside provably stays:

* text level: a match depends on the text from its start to at most LOOK characters after its end, or it
  touches the end of its span. So matches of the left neighbour that end LOOK or more before the seam stay.
  From there the joined text is matched anew until a match ends where one of the right neighbour's ends; as
  matches look at nothing before their start, all that follow stay.
  A match that touches an inner edge of its span isn't encoded there, as it may go on.
* piece level: a match longer than PIECE_LEAF bytes is halved in turn. Two token lists are joined from their seam on: a window is encoded
  that takes tokens of the left one back where they can't be followed, and goes to the right until its last token is compatible
  with the one of the right list that begins there (a pair is compatible if its bytes merge to that pair). A list whose adjacent
  pairs are all compatible is the encoding of its bytes, so tokens outside the window stay. As the encoding of a prefix is unique, a place
  that can't be gone on from is never tried again: a window costs no more than its length, whatever the bytes repeat.

Merging is done here, from the ranks; no tokenizer library takes part. Decoding concatenates token bytes up a tree.

The pattern must match every character, look at nothing before a match and at no more than LOOK characters
behind it but for a run that it has matched to its end, as the default pattern does (two for the letters of "'ll").

Cases: a null text counts as empty and has no tokens; repeated rows are encoded each by itself; other
columns are ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 512
PIECE_LEAF = 4096
LOOK = 2
#: Pieces whose tokens are remembered at a time, in two generations of half as many; what is forgotten is merged again.
REMEMBERED = 1 << 19
#: Longer pieces are merged each time.
LONGEST = 64
#: Bytes from which pairs wait in a heap instead of being scanned: the same merges in the same order.
SCANNED = 256
NEVER = 1 << 60

OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "token_bytes": T.BinaryType(),
    "decoded": T.BinaryType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def ranks_of(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}


class Codec:
    """encode, join and decode for one rank file."""

    def __init__(self, rank_file: bytes, pattern: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF):
        import regex

        self.ranks = ranks_of(rank_file)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.digits = {v: str(v).encode() for v in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.leaf, self.piece_leaf = leaf, piece_leaf
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[int, int | None] = {}
        lengths: dict[bytes, set[int]] = {}
        for token in self.ranks:
            lengths.setdefault(token[:2], set()).add(len(token))
        #: How long tokens are that begin with two bytes, the longest first.
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items() if len(k) == 2}

    # --- the base of the recursion: lowest rank first, leftmost of equals
    def merge(self, piece: bytes) -> list[int]:
        if len(piece) > SCANNED:
            return self.merge_waiting(piece)
        rank = self.ranks.get
        # Where parts begin, and what each makes with the next one.
        starts = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < NEVER:
            i = pairs.index(least)
            del starts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(piece[starts[i] : starts[i + 2]], NEVER)
            if i:
                pairs[i - 1] = rank(piece[starts[i - 1] : starts[i + 1]], NEVER)
        return [self.ranks[piece[a:b]] for a, b in zip(starts, starts[1:], strict=False)]

    def merge_waiting(self, piece: bytes) -> list[int]:
        """As merge, with the pairs in a heap and the parts in a linked list."""
        rank, n = self.ranks.get, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank(piece[i : i + 2], NEVER)) < NEVER]
        heapify(heap)
        while heap:
            r, i, j = heappop(heap)
            a, b = parts[i], parts[j]
            if a is None or b is None or after[i] != j or rank(a + b, NEVER) != r:
                continue
            parts[i], parts[j] = a + b, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank(parts[i] + parts[k], NEVER)) < NEVER:
                    heappush(heap, (s, i, k))
            h = before[i]
            if h >= 0 and (s := rank(parts[h] + parts[i], NEVER)) < NEVER:
                heappush(heap, (s, h, i))
        return [self.ranks[p] for p in parts if p is not None]

    # --- piece level
    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= REMEMBERED // 4:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def longest(self, piece: bytes, at: int) -> int:
        """The longest token that begins there."""
        for n in self.lengths.get(piece[at : at + 2], ()):
            token = self.ranks.get(piece[at : at + n])
            if token is not None:
                return token
        return self.ranks[piece[at : at + 1]]

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of another."""
        if token not in self.prefixes:
            whole = self.bytes_of[token]
            self.prefixes[token] = next((t for n in range(len(whole) - 1, 0, -1) if (t := self.ranks.get(whole[:n])) is not None), None)
        return self.prefixes[token]

    def resume(self, tokens: list[int], piece: bytes, at: int = 0, rest: tuple[int, ...] = ()) -> tuple[int, ...]:
        """The encoding of piece: tokens, up to byte `at`, may be taken back; rest, from there on, stays from where it fits."""
        starts = dict(zip(accumulate((len(self.bytes_of[t]) for t in rest), initial=at), range(len(rest)), strict=False))
        dead: set[int] = set()
        given = len(tokens)
        while at < len(piece):
            if tokens and (k := starts.get(at)) is not None and self.compatible(tokens[-1], rest[k]):
                return (*tokens, *rest[k:])
            token: int | None = self.longest(piece, at)
            while at + len(self.bytes_of[token]) in dead or not (self.compatible(tokens[-1], token) if tokens else self.merge(self.bytes_of[token]) == [token]):
                token = self.shorter(token)
                while token is None:
                    dead.add(at)
                    last = tokens.pop()
                    at -= len(self.bytes_of[last])
                    if len(tokens) < given:  # made where the piece ended; longer ones may begin there now
                        given, token = len(tokens), self.longest(piece, at)
                    else:
                        token = self.shorter(last)
            tokens.append(token)
            at += len(self.bytes_of[token])
        return tuple(tokens)

    def join_ids(self, a: tuple[int, ...], b: tuple[int, ...], piece: bytes, seam: int) -> tuple[int, ...]:
        """The encoding of piece from those of piece[:seam] and piece[seam:]."""
        return a + b if self.compatible(a[-1], b[0]) else self.resume(list(a), piece, seam, b)

    def piece_ids(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) <= self.piece_leaf:
            return tuple(self.merge(piece)) if len(piece) <= SCANNED else self.resume([], piece)
        half = len(piece) // 2
        return self.join_ids(self.piece_ids(piece[:half]), self.piece_ids(piece[half:]), piece, half)

    def code(self, piece: str) -> tuple[int, ...]:
        """The tokens of one piece."""
        found = self.known.get(piece) or self.before.get(piece)
        if found is None:
            told = piece.encode("utf-8", "replace")
            whole = self.ranks.get(told)
            found = self.piece_ids(told) if whole is None else (whole,)
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBERED // 2:
                self.known, self.before = {}, self.known
            self.known[piece] = found
        return found

    # --- text level
    def span(self, text: str, a: int, b: int) -> tuple[list[str], list[tuple[int, ...] | None]]:
        """The pieces of text[a:b] and the tokens of each; None for those that may go on beyond the span."""
        if b - a > self.leaf:
            m = (a + b) // 2
            return self.join(text, a, m, b, self.span(text, a, m), self.span(text, m, b))
        pieces, known, code = self.pattern.findall(text, a, b), self.known.get, self.code  # a leaf may begin a generation
        first, last, end = int(a > 0), len(pieces), b
        while b < len(text) and last > first and end > b - LOOK:
            last -= 1
            end -= len(pieces[last])
        own = pieces[first:last]
        return pieces, [*[None] * min(first, len(pieces)), *[known(p) or code(p) for p in own], *[None] * (len(pieces) - max(first, last))]

    def join(self, text: str, a: int, m: int, b: int, left: tuple[list, list], right: tuple[list, list]) -> tuple[list, list]:
        """The encoding of left, text[a:m], and right, text[m:b], together."""
        (pieces, codes), (later, later_codes) = left, right
        keep, at = len(pieces), m
        while keep and at > m - LOOK:
            keep -= 1
            at -= len(pieces[keep])
        fresh, fresh_codes, taken, end = [], [], 0, m

        def own(piece: str, start: int) -> tuple[int, ...] | None:
            return self.code(piece) if (start > a or a == 0) and (start + len(piece) <= b - LOOK or b == len(text)) else None

        while at < m or at != end:
            piece = self.pattern.match(text, at, b)[0]
            fresh.append(piece)
            fresh_codes.append(own(piece, at))
            at += len(piece)
            while end < at:
                end += len(later[taken])
                taken += 1
        if taken < len(later) and later_codes[taken] is None:  # what began the right side, and now stands alone
            later_codes[taken] = own(later[taken], at)
        pieces[keep:], codes[keep:] = fresh, fresh_codes
        pieces += later[taken:] if taken else later
        codes += later_codes[taken:] if taken else later_codes
        return pieces, codes

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.span(text, 0, len(text))[1]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join([self.bytes_of[t] for t in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def codec_for(rank_file: bytes, pattern: str) -> Codec:
    """This Python worker's codec: what it remembers serves the worker's later tasks, too."""
    kept = sys.modules.setdefault("scriptorium codecs of this worker", types.ModuleType("codecs")).__dict__
    name = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if name not in kept:
        kept[name] = Codec(rank_file, pattern)
    return kept[name]


def outputs(codec: Codec, text: str, want: tuple[str, ...]) -> dict:
    ids = codec.encode(text)
    row: dict = {"n_tokens": len(ids), "ids": ids}
    if "ids_sha256" in want:
        row["ids_sha256"] = hashlib.sha256(b" ".join(map(codec.digits.__getitem__, ids))).hexdigest()
    if "decoded" in want or "decoded_sha256" in want:
        whole = codec.decode(ids)
        row |= {"decoded": whole, "decoded_sha256": hashlib.sha256(whole).hexdigest()}
    if "token_bytes" in want:
        row["token_bytes"] = np.asarray(ids, "<u2").tobytes()
    return row


def slices(column: pa.Array, rows: int = 256) -> Iterator[list]:
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def encode_documents(docs: DataFrame, want: tuple[str, ...] = ("ids",), keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns `keep` of docs and, of each whole text, the outputs named in `want` (see OUTPUTS).

    token_bytes are the ids as little-endian 16-bit integers, for vocabularies of at most 65,536 ids.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary or default_vocabulary()))
    source = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(w, OUTPUTS[w]) for w in want])
    kinds = {"ids": pa.list_(pa.int32()), "token_bytes": pa.binary(), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(ranks.value, pattern)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("__text")):
                rows = [outputs(codec, x, want) for x in texts]
                part = batch.slice(at, len(texts))
                at += len(texts)
                columns = [part.column(c) for c in keep] + [pa.array([r[w] for r in rows], kinds[w]) for w in want]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *want])

    return source.mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """The columns `keep` and `text`, decoded from the column `ids` (null: empty); invalid UTF-8 is replaced."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(vocabulary or default_vocabulary()))
    source = tokens.select(*keep, F.col("ids").alias("__ids"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(ranks.value, pattern)
        for batch in batches:
            texts = [codec.decode(x or []).decode("utf-8", "replace") for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(run, schema)
