"""Token ids in files: Simple-8b blocks in document order, with an index of documents and of blocks.

A file is a Parquet container of segments.  A segment holds whole documents,
SEGMENT ids or a little more: their keys, where each ends, the Simple-8b words
of all ids in blocks of BLOCK ids, and where each block's words start, so that
a block is decoded on its own, all its ids at once.  Segments are in ascending
order of the key over `file` and `segment`, nulls first.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import shared_dir
from . import simple8b
from .dictionary import Coder, Dictionary, assembled, coded_batches
from .frames import releasing
from .pieces import tokenizers_kinds

#: Ids of a block, and ids after which a segment is closed.
BLOCK, SEGMENT = 8_192, 1_000_000
#: Token files of which the counts before each are broadcast: 16 MB.
BROADCAST_FILES = 1_000_000
#: Ids that a reader decodes at a time.
READ = 200_000
#: Words handed to the tokenizer at a time.
BATCH = 1_000
#: Of a tokenizer's path the words, and their ids, that this worker knows: Spark hands it one task after the other.
_known: dict[str, tuple[Coder, Dictionary]] = {}


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _matches_tokenizer(path: str):
    """The tokenizer for words that are matches of its pattern as they are: the pattern needn't look for matches in them again."""
    from tokenizers import Tokenizer, pre_tokenizers

    out, whole = Tokenizer.from_file(path), _tokenizer(path)
    if type(whole.pre_tokenizer) is pre_tokenizers.ByteLevel and whole.normalizer is None:
        out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=whole.pre_tokenizer.add_prefix_space, use_regex=False)
    return out


@functools.lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray | None:
    """How many bytes of a text each id stands for, where the ids of a word stand for its bytes and no others (else None)."""
    from tokenizers import models, pre_tokenizers

    whole = _tokenizer(path)
    if type(whole.pre_tokenizer) is not pre_tokenizers.ByteLevel or whole.pre_tokenizer.add_prefix_space or whole.normalizer is not None or type(whole.model) is not models.BPE:
        return None
    vocabulary = whole.get_vocab(with_added_tokens=False)
    if not vocabulary.keys() >= set(pre_tokenizers.ByteLevel.alphabet()):
        return None
    added = {i: len(t.content.encode()) for i, t in whole.get_added_tokens_decoder().items()}
    out = np.zeros(1 + max([*vocabulary.values(), *added]), np.int64)
    out[list(vocabulary.values())] = list(map(len, vocabulary))  # a character of these is a byte
    out[list(added)] = list(added.values())
    return out


def _ids(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The library's ids of the words, each encoded by itself, one after the other; and how many each has."""
    library, size = _matches_tokenizer(path), _token_bytes(path)
    ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(words), BATCH):
        some = words[at : at + BATCH]
        if size is None:
            lists = [x.ids for x in library.encode_batch_fast(some, add_special_tokens=False)]
            ids.append(np.array([i for x in lists for i in x], np.int32))
            lengths.append(np.array(list(map(len, lists)), np.int64))
            continue
        (found,) = library.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)  # each word by itself, in one list
        own = np.array(found.ids, np.int32)
        word_ends = np.cumsum(pc.binary_length(pa.array(some, pa.string())).to_numpy().astype(np.int64))
        id_ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[own])])
        edges = np.searchsorted(id_ends, word_ends)
        if not np.array_equal(id_ends[np.minimum(edges, len(own))], word_ends) or edges[-1] != len(own):
            raise ValueError("ids don't stand for the bytes of their words")
        ids.append(own)
        lengths.append(np.diff(edges, prepend=0))
    return np.concatenate(ids), np.concatenate(lengths)


def _added_tokens(path: str) -> list[str]:
    """The texts of the file's added tokens, which the library takes out of a text before its pattern sees it."""
    tokens = _tokenizer(path).get_added_tokens_decoder().values()
    if any(t.single_word or t.lstrip or t.rstrip for t in tokens):
        raise ValueError("added tokens that depend on what stands beside them aren't supported")
    return [t.content for t in tokens]


def _encoded(batches: Iterable[pa.RecordBatch], path: str, text: str, end: int | None) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Rows, a few at a time, and their ids."""
    coder, known = _known.pop(path, None) or (Coder(), Dictionary())  # what a task that failed leaves isn't used again
    for part, codes, counts, new, anew in coded_batches(batches, text, tokenizers_kinds(), _added_tokens(path), coder):
        if anew:
            known = Dictionary()
        known.add(*_ids(new, path))
        for at, lists in assembled(codes, counts, known, end):
            yield part.slice(at, len(lists)), lists
    _known.clear()  # one tokenizer's at most
    _known[path] = coder, known


def tokenize(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, end: int | None = None) -> DataFrame:
    """`keep` (None: all columns) and `ids` by the tokenizers library's byte-level file at `path`, no special tokens put in, `end` after each document.

    The library's merges never cross its pattern's matches nor its added tokens,
    so it is handed each distinct match and token of a worker's tasks once (until
    the worker knows MAX_WORDS and starts anew).  Null or empty texts have no ids but `end`.  A column named ids is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for part, ids in _encoded(batches, path, "__text", end):
            yield pa.record_batch([*(part[c] for c in kept), ids], names=[*kept, "ids"])

    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept), "ids array<int>"])
    return source.mapInArrow(releasing(run), schema)


def _segments(path: str, kind: str, end: int | None):
    def run(batches):
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys, lengths, words, sizes, size = [], [], [], [], 0  # of the segment; sizes: words of each block
        rest = np.zeros(0, np.int64)  # ids behind the last full block

        def packed(ids: np.ndarray, last: bool) -> np.ndarray:
            stop = len(ids) if last else len(ids) // BLOCK * BLOCK
            coded, starts = simple8b.encode_blocks(ids[:stop], BLOCK)
            words.append(coded)
            sizes.append(np.diff(starts))
            return ids[stop:]

        def segment():
            packed(rest, True)
            starts = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))
            ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))
            every = pa.concat_arrays(keys)
            return pa.record_batch(
                {
                    "file": pa.array([part], pa.int32()),
                    "segment": pa.array([number], pa.int32()),
                    "before": pa.array([before], pa.int64()),
                    "n_ids": pa.array([size], pa.int64()),
                    "keys": pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every),
                    "ends": pa.array([ends.tolist()], pa.list_(pa.int64())),
                    "blocks": pa.array([starts.tolist()], pa.list_(pa.int64())),
                    "words": pa.array([np.concatenate([np.zeros(0, np.uint64), *words]).astype("<u8").tobytes()], pa.binary()),
                }
            )

        for rows, ids in _encoded(batches, path, "__text", end):
            keys.append(rows["__key"])
            lengths.append(pc.list_value_length(ids).to_numpy().astype(np.int64))
            own = ids.flatten().to_numpy(zero_copy_only=False)
            size += len(own)
            rest = packed(np.concatenate([rest, own]), False)
            if size >= SEGMENT:
                yield segment()
                before, number, keys, lengths, words, sizes, size, rest = before + size, number + 1, [], [], [], [], 0, rest[:0]
        if keys:
            yield segment()

    return releasing(run), f"file int, segment int, before bigint, n_ids bigint, keys array<{kind}>, ends array<bigint>, blocks array<bigint>, words binary"


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = 2) -> None:
    """Encode `docs` and write the token files to the folder `path`, in ascending order of `key`, nulls first.

    Rows of equal keys, or without one, stand in the order of a digest of their
    texts, then of the texts.  A null or empty text is `end` alone; an empty
    table gives files without segments; repeated rows are written each.
    """
    source = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text")).withColumn("__digest", F.xxhash64("__text"))
    ordered = source.repartitionByRange("__key", "__digest").sortWithinPartitions("__key", "__digest", "__text")
    kind = source.schema["__key"].dataType.simpleString()
    ordered.select("__key", "__text").mapInArrow(*_segments(tokenizer, kind, end)).write.option("compression", "zstd").parquet(path)


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Segments with `base`, the count of ids in all files before theirs; the keys' type."""
    segments = spark.read.parquet(path)
    sizes = segments.groupBy("file").agg(F.sum("n_ids").alias("n"))
    # a row for each file
    base = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    base = F.broadcast(base) if len(segments.inputFiles()) <= BROADCAST_FILES else base
    return segments.join(base, "file").select("keys", "ends", "blocks", "words", "before", "base"), segments.schema["keys"].dataType.elementType.simpleString()


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield from _documents(batch.slice(r, 1))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, ids) of each document in the token files: start is the count of ids before it in all files."""
    placed, kind = _placed(spark, path)
    return placed.mapInArrow(releasing(_read), f"key {kind}, start bigint, ids array<int>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the token files: read() and checksums() in one worker."""
    placed, kind = _placed(spark, path)
    return placed.mapInArrow(releasing(lambda batches: _summed(_read(batches), ["key", "start"], "ids", "ids_crc32")), f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def _documents(row: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The documents of one segment, a few blocks at a time."""
    words, blocks = np.frombuffer(row["words"][0].as_buffer(), "<u8"), row["blocks"][0].as_py()
    keys, ends = row["keys"].flatten(), row["ends"].flatten().to_numpy()
    offset = row["base"][0].as_py() + row["before"][0].as_py()
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    ids, at, first, done = [], 0, 0, 0  # decoded ids from place `first` of the segment on; documents done
    some = [*blocks[: -1 : max(1, READ // BLOCK)], blocks[-1]]  # blocks are decoded some together
    for a, b in zip(some, some[1:], strict=False):
        ids.append(simple8b.decode(words[a:b]).astype(np.int32))
        at += len(ids[-1])
        stop = int(np.searchsorted(ends, at, side="right"))
        if stop > done and (b == blocks[-1] or at - first >= READ):
            own = np.concatenate(ids)
            edges = np.concatenate([starts[done:stop], ends[stop - 1 : stop]]) - first
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(own[: edges[-1]]))
            yield pa.record_batch({"key": keys.slice(done, stop - done), "start": pa.array(starts[done:stop] + offset), "ids": lists})
            ids, first, done = [own[edges[-1] :]], int(ends[stop - 1]), stop
    if done < len(keys):  # documents without ids at the end
        lists = pa.ListArray.from_arrays(pa.array(np.zeros(len(keys) - done + 1, np.int32)), pa.array([], pa.int32()))
        yield pa.record_batch({"key": keys.slice(done), "start": pa.array(starts[done:] + offset), "ids": lists})


def _summed(batches: Iterable[pa.RecordBatch], kept: list[str], ids: str, to: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch[ids]
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        crc = [zlib.crc32(values[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pa.record_batch([*(batch[c] for c in kept), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=[*kept, "n_tokens", to])


def checksums(tokens: DataFrame, ids: str = "ids", to: str = "ids_crc32") -> DataFrame:
    """`tokens` without its ids, with their number and the CRC-32 of the ids as little-endian 32-bit integers (null: none, and 0)."""
    kept = [c for c in tokens.columns if c not in (ids, "n_tokens", to)]
    schema = ", ".join([*(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in kept), f"n_tokens bigint, {to} bigint"])
    return tokens.select(*kept, ids).mapInArrow(releasing(lambda batches: _summed(batches, kept, ids, to)), schema)


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark)
