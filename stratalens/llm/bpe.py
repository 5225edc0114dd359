"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is read once on the driver and sent to the workers (its size is
fixed by the vocabulary), so executors need no copy of it.  Long texts are cut
before white space that follows other characters: the pre-splitting pattern
never matches across such a place, so the ids equal those of the whole text.
Ids decode to raw bytes.  Null texts count as empty and have no ids; a null
``doc_id`` keeps its row, repeated rows each get a row, an empty table gives none,
and extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from stratalens.runtime import map_arrow, prepare

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts longer than this many characters are encoded in pieces of about it.
PIECE_CHARS = 1 << 16
#: Only white space of the pattern's own ``\\s``; Python's has U+001C to U+001F, too.
_SAFE = re.compile(r"(?<=\S)(?=[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])")
_LOADED: dict[bytes, tiktoken.Encoding] = {}


def rank_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def load(raw: bytes, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file; built once in each worker process."""
    key = hashlib.sha256(raw + pattern.encode()).digest()
    if key not in _LOADED:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
        _LOADED[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def pieces(text: str, size: int = PIECE_CHARS):
    """Consecutive parts of ``text`` cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    parts = [encoding.encode_ordinary(p) for p in pieces(text or "")]
    return np.concatenate([np.array(p, dtype="<u4") for p in parts])


def decode(encoding: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    return encoding.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])``; ``ids`` are
    little-endian unsigned 32-bit integers, ``decoded_sha256`` is taken from
    the bytes that the ids decode to."""
    spark = prepare(docs.sparkSession)
    raw = spark.sparkContext.broadcast(rank_file(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding = load(raw.value)
        counts, digests, decoded, blobs = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = encode(encoding, text)
            blob = ids.tobytes()
            counts.append(ids.size)
            digests.append(hashlib.sha256(blob).hexdigest())
            decoded.append(hashlib.sha256(decode(encoding, ids)).hexdigest())
            if keep_ids:
                blobs.append(blob)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * keep_ids, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, raw)``: the bytes that each row's ``ids`` decode to."""
    spark = prepare(encoded.sparkSession)
    raw = spark.sparkContext.broadcast(rank_file(path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding = load(raw.value)
        out = [decode(encoding, np.frombuffer(ids or b"", "<u4")) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "raw"])

    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, raw binary")


def op5(docs: DataFrame) -> DataFrame:
    return encode_documents(docs, keep_ids=False)
