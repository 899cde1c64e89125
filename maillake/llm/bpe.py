"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once on the driver; its bytes (under 1 MB, checked) travel with
the task closure, so executors need no local copy.  Each Python worker builds the
encoder once.  Long texts are cut where no match of the split pattern can cross
(a visible ASCII character followed by a space or line feed: white space only begins
a match or fills it), so the ids are those of the whole text while no call of the
encoder sees more than about ``PIECE_CHARS`` characters unless the text holds no such place.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from maillake.llm.common import process_cache, text_or_empty, tidy

MAX_RANK_FILE_BYTES = 64 << 20
PIECE_CHARS = 1 << 16
OUTPUT_BYTES = 8 << 20          # of text in one returned Arrow batch
_SAFE_CUT = re.compile(r"[!-~](?=[ \n])")


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; refuses files too large to travel with a task."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(data) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path}: rank file above {MAX_RANK_FILE_BYTES} bytes")
    return data


def encoder(rank_bytes: bytes, pattern: str):
    """The tiktoken encoder of these ranks, built once per process."""
    cache, key = process_cache(), f"bpe {hash(rank_bytes)} {pattern}"
    if key not in cache:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_bytes.splitlines() if x)}
        cache[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return cache[key]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Consecutive pieces of ``text``, cut only at safe boundaries at or after every ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size - 1)
        if cut is None:
            break
        yield text[start:cut.end()]
        start = cut.end()
    yield text[start:]


def encode_text(enc, text: str) -> bytes:
    """Token ids of one text as little-endian unsigned 32-bit integers."""
    return b"".join(enc.encode_to_numpy(p, disallowed_special=()).astype("<u4").tobytes() for p in pieces(text) if p)


def decode_ids(enc, ids_le: bytes) -> bytes:
    """Raw bytes of the ids; they need not be whole UTF-8 characters."""
    import numpy as np

    return enc.decode_bytes(np.frombuffer(ids_le, dtype="<u4").tolist())


def encode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_le (binary), decoded (binary)`` of every row.

    ``ids_le`` holds the ids as little-endian unsigned 32-bit integers, ``decoded`` the
    bytes they stand for.  A null or empty text has no ids (n_tokens 0, two empty
    binaries).  A null id passes through; repeated rows are encoded once each; other
    columns are neither read nor returned, whatever their names.  An empty table gives
    an empty result.
    """
    def run(batches):
        enc = encoder(ranks, pattern)
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0)
            start, ids, decoded, size = 0, [], [], 0
            for i in range(batch.num_rows):
                ids.append(encode_text(enc, texts[i].as_py()))
                decoded.append(decode_ids(enc, ids[-1]))
                size += len(decoded[-1])
                if size > OUTPUT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(start, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()),
                         pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                        names=[id_col, "n_tokens", "ids_le", "decoded"])
                    start, ids, decoded, size = i + 1, [], [], 0

    src = df.select(df[id_col], text_or_empty(df[text_col]).alias("__text"))
    return src.mapInArrow(tidy(run), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, "
                               "ids_le binary, decoded binary")


def decode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids_le") -> DataFrame:
    """``id_col, decoded`` (binary): the bytes of ids stored as little-endian unsigned 32-bit integers."""
    def run(batches):
        enc = encoder(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([decode_ids(enc, x.as_py() or b"") for x in batch.column(1)], pa.binary())],
                names=[id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(
        tidy(run), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded binary")
