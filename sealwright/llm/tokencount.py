"""Token counts by scanning flat token files for the end-of-document identifier.

A token file is a sequence of fixed-width identifiers without an index; every document ends with the separator.
Files are handled in blocks cut anywhere. Each block is searched with one vectorised comparison and reduced to what
its neighbours need: its number of separators, its tokens, and where the first and last separator lie. A prefix scan over a file's
blocks then gives the ordinal of the first document that ends in a block and the tokens it brought along from earlier blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize, read

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this byte-level vocabulary, and its free identifier, which no text can give.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256
BLOCK = 1 << 20
#: Texts of more code points than this are encoded in pieces cut before white space, which the split pattern allows without changing the tokens.
PIECE = 1 << 18


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """Cut between a letter or digit and a single following space with a letter after it: such a place always separates two matches."""
    start = 0
    while len(text) - start > PIECE:
        at = start + PIECE
        while at < len(text) - 1 and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()):
            at += 1
        if at >= len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def encode(text: str | None, tokenizer: str = TOKENIZER) -> np.ndarray:
    parts = [_encoding(tokenizer).encode_ordinary(p) for p in pieces(text)] if text else []
    return np.array([x for p in parts for x in p], np.uint16)


FILES = "kind int, file int, at long, data binary"


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Tokenise `docs` once, into a file for each partition in the shared folder.

    Returns the files' blocks (file, block, data), and the order of the documents in them (file, ordinal, id), which is kept apart:
    the token files themselves carry neither lengths nor ids. A null text is a document without tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        end = np.array([SEPARATOR], np.uint16).tobytes()
        held, block, ordinal = bytearray(), 0, 0

        def row(kind: int, at: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], ["kind", "file", "at", "data"])

        for b in batches:
            for i in range(0, b.num_rows, 1024):
                chunk = b.slice(i, 1024)
                for text in as_bytes(chunk.column(1)):
                    held += encode(text.decode() if text else None, tokenizer).tobytes() + end
                    while len(held) >= block_bytes:
                        yield row(0, block, bytes(held[:block_bytes]))
                        del held[:block_bytes]
                        block += 1
                ids = chunk.column(0)
                sent = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)])
                yield row(1, ordinal, sent.astype(np.int64).tobytes())
                ordinal += chunk.num_rows
        if held:
            yield row(0, block, bytes(held))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids, known = np.frombuffer(data, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), file, np.int32)), pa.array(at + np.arange(len(ids))), pa.array(ids, mask=known == 0)], ["file", "ordinal", "id"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    written = materialize(rows.mapInArrow(run, FILES), "token-files")
    blocks = written.where("kind = 0").select("file", F.col("at").alias("block"), "data")
    return blocks, written.where("kind = 1").select("file", "at", "data").mapInArrow(order, "file int, ordinal long, id long")


def raw_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks (file string, block, data) of raw token files below `path`, each under the 2 GB that one Spark value can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1)):
                view = data.as_buffer()
                for k in range(-(-view.size // block_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), pa.array([view.slice(k * block_bytes, min(block_bytes, view.size - k * block_bytes)).to_pybytes()], pa.binary())], ["file", "block", "data"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, block long, data binary")


def scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "uint16") -> DataFrame:
    """(file, ordinal, n_tokens, ended) for each document of the files in `blocks` (file, block, data).

    The separator itself is not counted. Tokens after a file's last separator are a document with ended = false. Empty blocks and
    files without tokens give nothing. A block whose bytes are no whole number of identifiers raises an error.
    """
    kind = blocks.schema["file"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(2).to_pylist():
                a = np.frombuffer(data or b"", dtype)
                at = np.flatnonzero(a == separator)
                out.append((len(a), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, (np.diff(at) - 1).astype(np.int64).tobytes()))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()])]], ["file", "block", "n", "seps", "first", "last", "inner"])

    found = materialize(blocks.select("file", "block", "data").mapInArrow(search, f"file {kind}, block long, n long, seps long, first long, last long, inner binary"), "token-scan")
    w = Window.partitionBy("file").orderBy("block")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("start", F.coalesce(F.sum("n").over(past), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum("seps").over(past), F.lit(0)))
    placed = placed.withColumn("open", F.coalesce(F.max(F.col("start") + F.col("last") + 1).over(past), F.lit(0))).withColumn("final", F.lead("block").over(w).isNull())

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            for file, n, seps, first, last, inner, start, ordinal, opened, final in zip(*[x[c] for c in ("file", "n", "seps", "first", "last", "inner", "start", "ordinal", "open", "final")]):
                sizes = np.concatenate(([start + first - opened], np.frombuffer(inner, np.int64))) if seps else np.zeros(0, np.int64)
                rest = start + n - (start + last + 1 if seps else opened)
                ended = np.ones(len(sizes), bool)
                if final and rest:
                    sizes, ended = np.append(sizes, rest), np.append(ended, False)
                if len(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(sizes), b.schema.field("file").type), pa.array(ordinal + np.arange(len(sizes))), pa.array(sizes), pa.array(ended)], ["file", "ordinal", "n_tokens", "ended"])

    return placed.drop("block").mapInArrow(expand, f"file {kind}, ordinal long, n_tokens long, ended boolean")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, block_bytes: int = BLOCK) -> DataFrame:
    """(id_col, n_tokens) for each row of `docs`; 0 for null and empty texts. Repeated and null ids keep their rows; other columns are ignored."""
    blocks, order = write_token_files(docs, id_col, text_col, tokenizer, block_bytes)
    return order.join(scan(blocks), ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
