"""Token-id output in training order: a keyed Feistel permutation and fixed-stride shards.

A sequence is a document's tokens and an end mark. Sequences are numbered from 0 to N-1 by file and row; a
Feistel network over a x b >= N places, with modular additions and a round function keyed by `key`,
permutes the places, and walking its cycles until a place is below N permutes the numbers: that is the
sequence's slot. Shard s holds slots s * slots to (s + 1) * slots - 1, their tokens one after another, cut
into records of `record` 16-bit little-endian ids and a line feed, the last one filled with end marks. A shard
is a folder of files of `part` records each, so a file is bounded in bytes whatever the sequences' lengths, and
record r of a shard lies in file r // part at byte r % part * (2 * record + 1). Reading resumes at
(shard, record) and opens no earlier file.

Slots are dealt to tasks by range, known without sampling, as slots are dense. Records carry their number within
the shard and are sorted by (shard, number) before the write, which needs no sort of its own then; a sort by
shard alone could mix the records of a shard when it spills. Spark's writer commits the files, so lost executors
and second attempts leave no half shards. Beside the shards stands an index: each sequence's place and the digest
taken when it was encoded. The manifest reads the shards back and fails where they differ from the index.

Tokens come from the tiktoken library here; texts with a run of white space that is too long for it are encoded by the operator `bpe`.

Cases: a null or empty text is a sequence of the end mark alone; repeated rows are sequences each; an empty
table writes no shard; other columns are ignored; docs that aren't whole Parquet files (filtered, joined, made in
memory) are written once first. The token ids must be below 65,535.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec_for, default_vocabulary, ranks_of, read_ranks
from .common import fresh_path, staged

END, RECORD, SLOTS, PART, KEY, ROUNDS, MOST_TASKS = 50256, 2048, 8192, 1024, "epoch-0", 6, 20_000
#: Up to so many files, counted first, their first numbers are sent to every task: 16 bytes each. Beyond, rows are joined by file.
SENT_FILES = 2_000_000
#: The library can't match runs of white space much longer than this.
LONG_TEXT = 50_000
BLANKS = re.compile(r"\s{2,}")
INDEX = "doc_id long, slot long, first_token long, n_tokens long, tokens_sha256 string"


class Permutation:
    """A keyed bijection of 0..n-1."""

    def __init__(self, n: int, key: str, rounds: int = ROUNDS):
        self.n = n
        self.a = max(1, int(np.ceil(np.sqrt(n))))
        self.b = max(1, -(-n // self.a))
        digest = hashlib.sha512(key.encode()).digest()
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(digest + bytes([r])).digest()[:8], "little")) for r in range(rounds)]

    @staticmethod
    def mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
        """A 64-bit finaliser (xor, shifts and odd multipliers) of x and a round key."""
        with np.errstate(over="ignore"):
            x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def once(self, x: np.ndarray) -> np.ndarray:
        left, right = x % np.uint64(self.a), x // np.uint64(self.a)
        for r, key in enumerate(self.keys):
            if r % 2:
                right = (right + self.mixed(left, key) % np.uint64(self.b)) % np.uint64(self.b)
            else:
                left = (left + self.mixed(right, key) % np.uint64(self.a)) % np.uint64(self.a)
        return right * np.uint64(self.a) + left

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        at = self.once(numbers.astype(np.uint64))
        while (out := at >= np.uint64(self.n)).any():
            at[out] = self.once(at[out])
        return at.astype(np.int64)


def placed_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with the file and row that each comes from, and the files with their numbers of rows."""
    placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    row = F.col("__row").cast("decimal(38,0)")
    whole = (F.max("__row") == F.count("*") - 1) & (F.min("__row") == 0) & (F.sum(row) * 2 == F.count("*") * (F.count("*") - 1).cast("decimal(20,0)"))
    return placed, staged(placed.groupBy("__file").agg(F.count("*").alias("__n"), whole.alias("__whole")), "files")


def numbered(docs: DataFrame, sent_files: int = SENT_FILES) -> tuple[DataFrame, int]:
    """docs with `number`, 0 to N-1 by file and row of the files that docs is read from, and N."""
    try:
        placed, files = placed_rows(docs)
        if not files.agg(F.coalesce(F.min("__whole"), F.lit(True)).alias("w")).first()["w"]:
            raise ValueError
    except (AnalysisException, ValueError):  # rows that no file numbers from 0 on without a gap
        placed, files = placed_rows(staged(docs, "documents"))
    # One row for each file; their running sum is taken in one task.
    before = F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = staged(files.select(F.col("__file").alias("__f"), F.xxhash64("__file").alias("__h"), "__n", F.coalesce(before, F.lit(0)).alias("__offset")), "offsets")
    sums = offsets.agg(F.sum("__n").alias("n"), F.count("*").alias("files"), F.count_distinct("__h").alias("hashes")).first()
    total = sums["n"] or 0
    if sums["files"] == sums["hashes"] <= sent_files:  # no text is shuffled
        joined = placed.join(F.broadcast(offsets.select("__h", "__offset")), F.xxhash64("__file") == F.col("__h"))
    else:
        joined = placed.join(offsets, placed["__file"] == offsets["__f"])
    return joined.select(*docs.columns, (F.col("__offset") + F.col("__row")).alias("number")), int(total)


def digest(tokens: bytes) -> str:
    return hashlib.sha256(tokens).hexdigest()


def write_shards(docs: DataFrame, path: str, key: str = KEY, record: int = RECORD, slots: int = SLOTS, part: int = PART, vocabulary: str | None = None) -> int:
    """Write the shards and their index below `path`; the number of sequences."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN
    spark = docs.sparkSession
    placed, n = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    if not n:
        return 0
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary or default_vocabulary()))
    shards = -(-n // slots)
    tasks = min(shards, MOST_TASKS)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        library, order = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(ranks.value), special_tokens={}), Permutation(n, key)

        def encoded(text: str) -> np.ndarray:
            if len(text) < LONG_TEXT or max(map(len, BLANKS.findall(text)), default=0) < LONG_TEXT:
                return library.encode_to_numpy(text, disallowed_special=())
            return np.array(codec_for(ranks.value, pattern).encode(text))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                tokens = [encoded(x or "").astype("<u2").tobytes() for x in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(order(rows.column("number").to_numpy())), pa.array(tokens, pa.binary()), pa.array([digest(t) for t in tokens], pa.string())], names=["doc_id", "slot", "tokens", "digest"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (kind, shard, number, value): records of tokens, and a line of the index for each sequence."""
        stride, end = 2 * record, END.to_bytes(2, "little")
        shard, held, index, made, first = -1, bytearray(), [], 0, 0

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal made, index
            whole = len(held) // stride
            values = [bytes(held[i * stride : (i + 1) * stride]) for i in range(whole)]
            del held[: whole * stride]
            if last and held:
                values.append(bytes(held) + end * ((stride - len(held)) // 2))
                held.clear()
            numbers = [*range(made, made + len(values)), *[slot for slot, _ in index]]
            kinds = ["records"] * len(values) + ["index"] * len(index)
            made += len(values)
            values += [line for _, line in index]
            index = []
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([shard] * len(kinds), pa.int64()), pa.array(numbers, pa.int64()), pa.array(values, pa.binary())], names=["kind", "shard", "number", "value"])

        for batch in batches:
            told = [batch.column(c).to_pylist() for c in ("doc_id", "slot", "tokens", "digest")]
            for doc_id, slot, tokens, told_digest in zip(*told, strict=True):
                if slot // slots != shard:
                    if index:
                        yield cut(True)
                    shard, made, first = slot // slots, 0, 0
                held += tokens
                held += end
                index.append((slot, f"{'' if doc_id is None else doc_id},{slot},{first},{len(tokens) // 2},{told_digest}".encode()))
                first += len(tokens) // 2 + 1
                if len(held) > 1 << 20:
                    yield cut(False)
        if index:
            yield cut(True)

    ordered = placed.select("doc_id", "number", "text").mapInArrow(tokenize, "doc_id long, slot long, tokens binary, digest string")
    task = F.expr(f"cast((slot div {slots}) * {tasks} div {shards} as int)")
    ordered = ordered.repartitionById(tasks, task).sortWithinPartitions("slot")
    packed = ordered.mapInArrow(pack, "kind string, shard long, number long, value binary").sortWithinPartitions("kind", "shard", "number")
    packed.select("kind", "shard", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "shard").option("maxRecordsPerFile", part).text(path)
    return n


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, slot, first_token, n_tokens and tokens_sha256 of every sequence, as encoded."""
    return spark.read.schema(INDEX).option("mode", "FAILFAST").csv(f"{path}/kind=index").select("doc_id", "slot", "first_token", "n_tokens", "tokens_sha256")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """shard, part, length and content of the shards' files."""
    number = F.regexp_extract("path", r"\.c(\d+)\.[^/]*$", 1).cast("long")  # of the file's own name
    return spark.read.format("binaryFile").load(f"{path}/kind=records").select(F.col("shard").cast("long").alias("shard"), number.alias("part"), "length", "content")


def read_shards(spark: SparkSession, path: str, n: int, record: int = RECORD, slots: int = SLOTS, part: int = PART) -> DataFrame:
    """slot, first_token, n_tokens and tokens_sha256 of every sequence, from the shards alone.

    A file is read by itself. The sequence that runs on into the next file is put together from its pieces.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, content in zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), batch.column("content"), strict=True):
                ids = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, 2 * record + 1)[:, : 2 * record].copy().view("<u2").reshape(-1)
                ends = np.flatnonzero(ids == END)
                starts, stops = np.r_[0, ends + 1], np.r_[ends, len(ids)]
                last = len(starts) - 1
                edge = [ids[a:b].tobytes() if k in (0, last) else None for k, (a, b) in enumerate(zip(starts, stops, strict=True))]
                found = [None if e is not None else digest(ids[a:b].tobytes()) for e, a, b in zip(edge, starts, stops, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(last + 1, shard)),
                        pa.array(np.full(last + 1, number)),
                        pa.array(np.arange(last + 1)),
                        pa.array((np.arange(last + 1) < last).astype(np.int64)),
                        pa.array(starts + number * part * record),
                        pa.array(stops - starts),
                        pa.array(edge, pa.binary()),
                        pa.array(found, pa.string()),
                    ],
                    names=["shard", "part", "k", "ended", "first_token", "n_tokens", "edge", "digest"],
                )

    pieces = files_of(spark, path).select("shard", "part", "content").mapInArrow(parse, "shard long, part long, k long, ended long, first_token long, n_tokens long, edge binary, digest string")
    # A shard has at most `slots` sequences and two pieces more for each file.
    before = F.sum("ended").over(Window.partitionBy("shard").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1))
    counted = pieces.withColumn("place", F.coalesce(before, F.lit(0)))
    whole = counted.where("digest is not null").select("shard", "place", "first_token", "n_tokens", "digest")
    parts = F.sort_array(F.collect_list(F.when(F.col("edge").isNotNull(), F.struct("part", "k", "edge"))))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["edge"]))
    cut = counted.where("digest is null").groupBy("shard", "place").agg(F.min("first_token").alias("first_token"), F.sum("n_tokens").alias("n_tokens"), F.sha2(joined, 256).alias("digest"))
    slot = F.col("shard") * slots + F.col("place")
    # What fills the last record of a shard are end marks beyond its sequences.
    return whole.unionByName(cut).where(F.col("place") < F.least(F.lit(slots), F.lit(n) - F.col("shard") * slots)).select(slot.alias("slot"), "first_token", "n_tokens", F.col("digest").alias("tokens_sha256"))


def read_manifest(spark: SparkSession, path: str, n: int, record: int = RECORD, slots: int = SLOTS, part: int = PART) -> DataFrame:
    """doc_id, slot, shard, first_token, n_tokens and tokens_sha256 of every sequence, as the shards have it; fails where that isn't what was encoded."""
    told = read_index(spark, path).select("doc_id", *[F.col(c).alias(f"__{c}") for c in ("slot", "first_token", "n_tokens", "tokens_sha256")])
    there = read_shards(spark, path, n, record, slots, part)
    same = (F.col("first_token") == F.col("__first_token")) & (F.col("n_tokens") == F.col("__n_tokens")) & (F.col("tokens_sha256") == F.col("__tokens_sha256"))
    wrong = F.raise_error(F.concat(F.lit("not what was encoded: sequence "), F.coalesce("slot", "__slot").cast("string")))
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("tokens_sha256")).otherwise(wrong)
    joined = told.join(there, told["__slot"] == there["slot"], "full")
    return joined.select("doc_id", "slot", F.floor(F.col("slot") / slots).cast("int").alias("shard"), "first_token", "n_tokens", checked.alias("tokens_sha256"))


def records(spark: SparkSession, path: str, shard: int = 0, first: int = 0, record: int = RECORD, part: int = PART) -> DataFrame:
    """shard, number and tokens of the records from (shard, first) on, for resuming; earlier files aren't opened."""
    stride = 2 * record + 1
    files = files_of(spark, path).where((F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("part") >= first // part)))
    within = F.explode(F.sequence(F.lit(0), (F.col("length") / stride).cast("int") - 1)).alias("within")
    number = F.col("part") * part + F.col("within")
    cut = files.select("shard", "part", within, "content").where((F.col("shard") > shard) | (number >= first))
    return cut.select(F.col("shard").cast("int").alias("shard"), number.alias("number"), F.substring("content", F.col("within") * stride + 1, F.lit(2 * record)).alias("tokens"))


def training_order(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shards and return doc_id, slot, shard, first_token, n_tokens and tokens_sha256 of each sequence, as read back."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    n = write_shards(docs, path, **options)
    if not n:
        return spark.createDataFrame([], "doc_id long, slot long, shard int, first_token long, n_tokens long, tokens_sha256 string")
    return read_manifest(spark, path, n, **{k: options[k] for k in ("record", "slots", "part") if k in options})
