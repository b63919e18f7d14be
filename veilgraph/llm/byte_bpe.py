"""Byte-level BPE over a global shuffle of distinct words: each word is encoded once and its ids joined back.

A pre-token and its positions are held by block: some tens of millions of characters of whole documents, as a
dictionary of the block's distinct words and, for each document, the sequence of indices into it. Only the
dictionaries go through the shuffle by word, so a word in every document costs one row a block.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Characters after which a block closes, which bounds what a worker holds; a longer document is a block alone.
BLOCK_CHARS = 40_000_000
#: Dictionary entries that the encoding step packs into one row.
PACK = 1 << 18


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The bytes of each token by rank. A rank file has some ten thousand lines; its size is bounded by its ids."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError(f"{path}: the ranks aren't 0 to {len(tokens) - 1}")
    return tokens


_ENCODINGS: dict[int, tiktoken.Encoding] = {}


def encoding(tokens: list[bytes], pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoding of a vocabulary, built once a process."""
    key = hash((pattern, len(tokens), tokens[-1]))
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return _ENCODINGS[key]


def _packed(x: np.ndarray) -> bytes:
    """Integers in byte planes, which compress better apart."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")


BLOCKS = "block long, words array<string>, doc_ids array<long>, lengths binary, codes binary"


def _code(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to blocks: the block's dictionary in words, and its documents as indices into it."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        at: dict[str, int] = {}
        doc_ids: list[int | None] = []
        lengths, codes, chars = array("I"), array("I"), 0

        def block() -> pa.RecordBatch:
            words = list(at)
            # Named by its content: whatever order a retried task reads in, codes only meet their own dictionary.
            name = hashlib.blake2b(digest_size=8)
            for part in (repr(doc_ids).encode(), lengths.tobytes(), codes.tobytes(), "\0".join(words).encode()):
                name.update(part)
            row = [int.from_bytes(name.digest(), "little", signed=True), words, doc_ids, _packed(np.frombuffer(lengths, "u4")), _packed(np.frombuffer(codes, "u4"))]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = find(text.as_py() or "")
                codes.extend([at.setdefault(w, len(at)) for w in found])
                lengths.append(len(found))
                doc_ids.append(doc_id)
                chars += sum(map(len, found))
                if chars >= BLOCK_CHARS:
                    yield block()
                    at, doc_ids, lengths, codes, chars = {}, [], array("I"), array("I"), 0
        if doc_ids:
            yield block()

    return run


def _encode(tokens: list[bytes], pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, at, word), words in order, to packed (block, ats, sizes, ids).

    All rows of a word are in one partition and follow one another, so each is encoded once and only the last
    is held, however many words there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, ids, held, n = encoding(tokens, pattern).encode_ordinary, None, (), {}, 0

        def flush() -> pa.RecordBatch:
            packs = [(b, _packed(np.array(ats)), _packed(np.fromiter(map(len, ids), "u4", len(ids))), _packed(np.array([i for x in ids for i in x], "u4"))) for b, (ats, ids) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*packs, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "ats", "sizes", "ids"])

        for batch in batches:
            for b, i, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if w != last:
                    last, ids = w, tuple(encode(w))
                ats, all_ids = held.setdefault(b, ([], []))
                ats.append(i)
                all_ids.append(ids)
            n += batch.num_rows
            if n >= PACK:
                yield flush()
                held, n = {}, 0
        if held:
            yield flush()

    return run


def _reassemble(tokens: list[bytes], emit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's codes and the ids of its dictionary to ids (or digests) by document, in order of position."""

    def documents(row: dict) -> Iterator[tuple[int | None, np.ndarray, list[tuple[int, ...]]]]:
        lengths, codes = _unpacked(row["lengths"]), _unpacked(row["codes"])
        by_word: list = [None] * (int(codes.max()) + 1 if len(codes) else 0)
        for pack in row["packs"] or ():
            ids, ends = _unpacked(pack["ids"]).tolist(), np.cumsum(_unpacked(pack["sizes"])).tolist()
            for i, start, end in zip(_unpacked(pack["ats"]).tolist(), [0, *ends], ends, strict=False):
                by_word[i] = ids[start:end]
        if None in by_word:
            raise ValueError("a block of codes came without its whole dictionary")
        ends = np.cumsum(lengths, dtype=np.int64)
        for doc_id, end, n in zip(row["doc_ids"], ends.tolist(), lengths.tolist(), strict=True):
            yield doc_id, codes[end - n : end], by_word

    def digests(row: dict) -> Iterator[tuple]:
        said, spelled, sizes, seen = [], [], None, None
        for doc_id, codes, by_word in documents(row):
            if by_word is not seen:
                said = [" ".join(map(str, ids)) for ids in by_word]
                # Decoding: the bytes of each id by the token table.
                spelled = [b"".join([tokens[i] for i in ids]) for ids in by_word]
                sizes, seen = np.array([len(x) for x in by_word], np.int64), by_word
            own = codes.tolist()
            n = int(sizes[codes].sum()) if own else 0
            yield doc_id, n, hashlib.sha256(" ".join([said[c] for c in own]).encode()).hexdigest(), hashlib.sha256(b"".join([spelled[c] for c in own])).hexdigest()

    def ids(row: dict) -> Iterator[tuple]:
        for doc_id, codes, by_word in documents(row):
            yield doc_id, [i for c in codes.tolist() for i in by_word[c]]

    made = {"digests": (digests, [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]), "ids": (ids, [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])}
    rows, schema = made[emit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = list(rows(batch.slice(k, 1).to_pylist()[0]))
                for i in range(0, len(out), 2000):
                    columns = zip(*out[i : i + 2000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [x for x, _ in schema])

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, emit: str = "ids") -> DataFrame:
    """doc_id, ids (array<int>) of every row's whole text, or with emit="digests" the sizes and hashes of op7.

    Null and empty texts have no ids; repeated rows are encoded each; nulls in doc_id stay. Blocks are written
    once to a table in the shared folder, bucketed by block, so that the codes needn't be shuffled to meet
    their dictionaries: only words travel, to their encoder and, as ids, back to their blocks.
    """
    spark = docs.sparkSession
    tokens = read_vocabulary(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = shared_path(spark, "bpe")
    name = place.rsplit("/", 1)[-1].replace("-", "_")
    docs.select("doc_id", "text").mapInArrow(_code(pattern), BLOCKS).write.bucketBy(n, "block").option("path", place).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    packs = words.repartition(n, "word").sortWithinPartitions("word").mapInArrow(_encode(tokens, pattern), "block long, ats binary, sizes binary, ids binary")
    packs = packs.groupBy("block").agg(F.collect_list(F.struct("ats", "sizes", "ids")).alias("packs"))
    met = blocks.select("block", "doc_ids", "lengths", "codes").join(packs, "block", "left").drop("block")
    schema = {"ids": "doc_id long, ids array<int>", "digests": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"}[emit]
    out = met.mapInArrow(_reassemble(tokens, emit), schema)
    out.columns  # resolved; the plan keeps to the files from here on
    spark.sql(f"DROP TABLE {name}")  # the entry alone: the files are outside the warehouse and go when the driver ends
    return out


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, bytes (binary) of ids: each id's bytes from the token table, in order; null ids give null.

    An id outside the table is an error. The bytes needn't be UTF-8 where ids were cut apart.
    """
    tokens = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled: Iterable[bytes | None] = (None if ids is None else b"".join([tokens[i] for i in ids]) for ids in (x.as_py() for x in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(spelled), pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def op7_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode over all documents: sizes and digests of the ids and of what they decode to."""
    return encode(table(spark, sf_dir, "documents"), emit="digests")
