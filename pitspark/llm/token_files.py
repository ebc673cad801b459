"""Token ids of documents in compressed shards: written, and read back, by Spark.

The file format is a Parquet folder with a row per block: shard and number of the block,
``first`` (ids of the shard before it), the pieces of documents in it, and the block as
``token_codec`` makes it (alphabet, payload, checksum). Shards follow each other in
ascending doc_id order, as do documents in a shard. Any block can be decoded alone.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pitspark.session import scratch_path

from .token_codec import BLOCK, Coded, decode_blocks, encode_blocks, ids_crc32, join_crc32

BLOCKS_PER_STEP = 2048
BLOCKS_PER_TASK = 3072  # read by a task, where there are enough: the cost of a step hardly grows with its blocks
# Two steps of the one kind of tokenizer file whose texts may be split at white space.
WHITE_SPACE_STEP = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHED_WORDS = 800_000
_TOKEN_ID = attrgetter("id")

_PIECE = pa.struct([("document", pa.int64()), ("doc_id", pa.int64()), ("n_ids", pa.int64())])
_BLOCK = pa.schema([
    ("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("pieces", pa.list_(_PIECE)), ("alphabet", pa.binary()), ("payload", pa.binary()), ("crc32", pa.int64()),
])
_BLOCK_DDL = (
    "shard long, block long, first long, n_ids long, "
    "pieces array<struct<document: long, doc_id: long, n_ids: long>>, alphabet binary, payload binary, crc32 long"
)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is visible, else the next above 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class _Learning(dict):
    """Keeps what ``learn`` gives for a key that is asked for the first time."""

    def __init__(self, learn: Callable[[str], bytes], items: Iterable = ()):
        super().__init__(items)
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.learn(key)
        return value


class WordEncoder:
    """Ids of whole texts, through a bounded memory of the words and pieces seen.

    Where a tokenizer's file asks for no more than NFC, white space to one space, lower case, one splitting pattern that
    leaves white space out, and byte letters, nothing is joined across white space: a text's ids are those of its
    parts between ASCII white space, in order. A printable part in Latin script is then split
    here and only its new pieces go to the tokenizer's model; every other part goes
    through the whole tokenizer. With any other file whole texts do. In a printable Latin text without two
    neighbours that are neither letter, digit nor space, each of ``MARKS`` is a piece, so it is a part as well. With
    such neighbours, but no apostrophe, every run of them is a piece, and a part. Such parts, in lower case, are
    ``known``; ``odd`` are parts of other texts, as they stand there.
    """

    LATIN_END = "\u0250"
    MARKS = {m: f" {m} " for m in ".,;:!?"}
    BYTE_MARKS = {m.encode(): spaced.encode() for m, spaced in MARKS.items()}
    RUN = re.compile("[^a-z0-9 \u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{2}").search
    # all printable Latin characters but letters, numbers, the space and the apostrophe
    RUNS = re.compile("[!-&(-/:-@\\[-`{-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7]+").sub
    NOT_LATIN = re.compile("[\u0250-\U0010ffff]").search
    # the same for texts below U+0100, as tables of their bytes
    FLAT_LOW = bytes(32 if c in b"\t\n\r" else ord(chr(c).lower()) for c in range(256))
    PRINTABLE = bytes(c for c in range(256) if chr(c).isprintable() or c in b"\t\n\r")
    KINDS = bytes(46 if mark else 97 for mark in map(RUN, [2 * chr(c) for c in range(256)]))

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.known = _Learning(self._plain_ids)
        self.odd = _Learning(self._ids)
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.split = self._pattern(json.loads(tokenizer_json))

    @staticmethod
    def _pattern(spec: dict):
        """The splitting pattern, if the file is of the simple kind."""
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        simple = (
            steps == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1] == WHITE_SPACE_STEP
            and [p.get("type") for p in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": SPLIT_PATTERN}
            and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
            and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
            and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
            and all("<|" in t["content"] for t in spec.get("added_tokens", []))
        )
        return regex.compile(splits[0]["pattern"]["Regex"]).findall if simple else None

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = self._model_ids(piece)
        return ids

    def _model_ids(self, piece: str) -> bytes:
        word = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("H", map(_TOKEN_ID, self.tokenizer.model.tokenize(word))).tobytes()

    def _plain_ids(self, low: str) -> bytes:
        """The ids of a printable Latin part in lower case."""
        return self._model_ids(low) if low.isalpha() else b"".join(map(self._piece, self.split(low)))

    def _ids(self, word: str) -> bytes:
        """The ids of a part that was not met before."""
        low = word.lower()
        if len(low) != len(word) or not word.isprintable() or "<|" in word or self.NOT_LATIN(word):
            return array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return self._plain_ids(low)

    def _parts(self, text: str) -> tuple[list[str], _Learning]:
        """The parts of a text, and the memory to look them up in."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self._wide_parts(text)
        flat_low = raw.translate(self.FLAT_LOW)
        if raw.translate(None, self.PRINTABLE) or b".." in flat_low.translate(self.KINDS):
            return self._wide_parts(text)
        for mark, spaced in self.BYTE_MARKS.items():
            flat_low = flat_low.replace(mark, spaced)
        return flat_low.decode("latin-1").split(), self.known  # no white space but spaces is printable

    def _wide_parts(self, text: str) -> tuple[list[str], _Learning]:
        """The same for any text, also with neighbouring marks."""
        flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        low = flat.lower()
        if len(low) != len(flat) or not flat.isprintable() or (not flat.isascii() and self.NOT_LATIN(flat)):
            return flat.split(" "), self.odd
        if self.RUN(low):
            if "'" in low or "<|" in low:
                return flat.split(" "), self.odd
            return self.RUNS(r" \g<0> ", low).split(), self.known
        for mark, spaced in self.MARKS.items():
            low = low.replace(mark, spaced)
        return low.split(), self.known

    def _forget(self) -> None:
        """Keeps the words met first, which are mostly the common ones."""
        self.known = _Learning(self._plain_ids, islice(self.known.items(), CACHED_WORDS // 4))
        self.odd = _Learning(self._ids, islice(self.odd.items(), CACHED_WORDS // 4))
        self.pieces = dict(islice(self.pieces.items(), CACHED_WORDS // 4))

    def __call__(self, text: str | None) -> bytes:
        """16-bit little-endian ids."""
        if self.split is None:
            return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u2").tobytes()
        if len(self.known) + len(self.odd) + len(self.pieces) > CACHED_WORDS:
            self._forget()
        parts, memory = self._parts(text or "")
        return b"".join(map(memory.__getitem__, parts))


_encoders: dict[int, WordEncoder] = {}


def _encoder(tokenizer_json: str) -> WordEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(tokenizer_json)
    return _encoders[key]


class _Shard:
    """Gathers the ids of a shard's documents into blocks."""

    def __init__(self, number: int):
        self.number, self.block, self.first, self.document = number, 0, 0, 0
        self.rows: list[tuple[int, int, list[tuple[int, int | None, int]]]] = []
        self.full: list[np.ndarray] = []
        self.parts: list[bytes] = []
        self.pieces: list[tuple[int, int | None, int]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        left = len(ids) // 2
        while left:
            take = min(left, BLOCK - self.held)
            at = len(ids) - 2 * left
            self.parts.append(ids[at:at + 2 * take])
            self.pieces.append((self.document, doc_id, take))
            self.held += take
            left -= take
            if self.held == BLOCK:
                self.close()
        self.document += 1

    def close(self) -> None:
        if self.held:
            self.full.append(np.frombuffer(b"".join(self.parts), "<u2").astype(np.int64))
            self.rows.append((self.block, self.first, self.pieces))
            self.block += 1
            self.first += self.held
            self.parts, self.pieces, self.held = [], [], 0

    def coded(self) -> pa.RecordBatch:
        blocks = encode_blocks(self.full)
        columns = [
            [self.number] * len(blocks), [r[0] for r in self.rows], [r[1] for r in self.rows], [c.n_ids for c in blocks],
            [[dict(zip(("document", "doc_id", "n_ids"), p)) for p in r[2]] for r in self.rows],
            [c.alphabet for c in blocks], [c.payload for c in blocks], [c.crc32 for c in blocks],
        ]
        self.rows, self.full = [], []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)


def write_tokens(docs: DataFrame, tokenizer_json: str, end_id: int, path: str) -> None:
    """Tokenizes every whole text of ``docs`` (doc_id, text), ends it with ``end_id`` and writes shards to ``path``.

    Rows are range-partitioned and sorted by doc_id, nulls first, rows of one id by a
    digest of the text; copies of a row may fall on either side of a border, which changes
    nothing. A null or empty text has the end id alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)  # a file of fixed size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = _encoder(shared.value), np.array([end_id], "<u2").tobytes()
        shard = _Shard(TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                shard.add(doc_id, encoder(text.as_py()) + end)
                if len(shard.full) >= BLOCKS_PER_STEP:
                    yield shard.coded()
        shard.close()
        if shard.full:
            yield shard.coded()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("copy")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("copy"),
    )
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
    ranged.mapInArrow(encode, _BLOCK_DDL).write.option("compression", "uncompressed").parquet(path)


def decode_pieces(blocks: DataFrame) -> DataFrame:
    """(shard, document, doc_id, block, at, n_ids, crc32) of every piece, from the decoded ids."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def finish() -> pa.RecordBatch:
            out: list[tuple] = []
            ids = decode_blocks([Coded(r["n_ids"], r["alphabet"], r["payload"], r["crc32"]) for r in held])
            for r, x in zip(held, ids):
                raw, at = x.astype("<u4"), 0
                for p in r["pieces"]:
                    piece = raw[at:at + p["n_ids"]]
                    out.append((r["shard"], p["document"], p["doc_id"], r["block"], r["first"] + at, len(piece), ids_crc32(piece)))
                    at += p["n_ids"]
            held.clear()
            names = ["shard", "document", "doc_id", "block", "at", "n_ids", "crc32"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= 2 * BLOCKS_PER_STEP:  # the rest is decoded together, as a few blocks take as many steps
                rest = held[BLOCKS_PER_STEP:]
                del held[BLOCKS_PER_STEP:]
                yield finish()
                held += rest
        if held:
            yield finish()

    return blocks.mapInArrow(
        decode, "shard long, document long, doc_id long, block long, at long, n_ids long, crc32 long"
    )


def _joined_crc32(pieces: Column) -> Column:
    """CRC-32 of a document from its pieces (block, n_ids, crc32) in order."""
    @F.arrow_udf("long")
    def join(lists: pa.Array) -> pa.Array:
        result = []
        for doc in lists.to_pylist():
            total = doc[0]["crc32"]
            for p in doc[1:]:
                total = join_crc32(total, p["crc32"], 4 * p["n_ids"])
            result.append(total)
        return pa.array(result, pa.int64())

    return join(pieces)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at ``path``: (doc_id, start, n_tokens, ids_crc32).

    Every block is decoded and held against its checksum. ``start`` counts the ids of all
    documents before; ``ids_crc32`` is taken over the ids as unsigned 32-bit integers.
    """
    ddl = "shard long, block long, first long, n_ids long"
    blocks = spark.read.schema(_BLOCK_DDL).parquet(path)
    counted = spark.read.schema(ddl).parquet(path)
    tasks = max(spark.sparkContext.defaultParallelism, counted.count() // BLOCKS_PER_TASK)
    sizes = counted.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    documents = decode_pieces(blocks.coalesce(tasks)).groupBy("shard", "document").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.min("at").alias("at"), F.sum("n_ids").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("block", "n_ids", "crc32"))).alias("pieces"),
    )
    return documents.join(offsets, "shard").select(
        "doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", _joined_crc32(F.col("pieces")).alias("ids_crc32"),
    )


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the tokens of ``docs`` to the shared folder and returns what the files hold.

    Repeated rows are written as often as they come; a null doc_id stays null; an empty
    table makes files without blocks and an empty result; columns beside doc_id and text
    are not read. doc_id must be an integer.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; tasks get its content
        tokenizer_json = f.read()
    path = scratch_path(spark, "tokens")
    write_tokens(docs, tokenizer_json, end_id, path)
    return read_tokens(spark, path)
