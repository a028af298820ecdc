"""Token ids of a whole corpus, encoding every distinct piece of text once.

Texts are cut where a rolling hash of the preceding bytes says so, hence equal
passages of different documents are cut alike. Equal chunks meet in one partition and
are encoded once; a document's ids are its chunks' ids in order. A cut between a
visible ASCII character and a blank is always a border between pre-tokens, so such
joins agree exactly. Other cuts (texts without blanks) are repaired: the surroundings
of the join are widened to the next such borders and encoded again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A cut falls on one in CUT_EVERY of the possible places, about every 400 bytes.
CUT_EVERY = 64
#: Bytes after which a text without such a place is cut anywhere (and repaired).
MAX_CHUNK = 4096
#: Bytes the rolling hash looks back.
WINDOW = 12
#: Chunks a task remembers so as not to send their text again.
REMEMBERED = 400_000
_SAFE = re.compile(r"(?<=[!-~])[ \t\n\r]")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, once per worker process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _byte_lengths(path: str) -> np.ndarray:
    ranks = encoding(path)._mergeable_ranks
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return lengths


def _cuts(data: np.ndarray) -> np.ndarray:
    """Offsets of chosen safe cuts in a byte buffer; each depends on WINDOW bytes before it."""
    blank = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    visible = (data > 32) & (data < 127)
    at = np.flatnonzero(blank[1:] & visible[:-1]) + 1
    at = at[at >= WINDOW]
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(WINDOW, 0, -1):
        h = h * np.uint64(0x9E3779B97F4A7C15) + data[at - k].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return at[(h >> np.uint64(40)) % np.uint64(CUT_EVERY) == 0]


def split_chunks(text: str) -> tuple[list[str], list[int]]:
    """A text's chunks and the numbers of those that begin at a place that isn't safe."""
    raw = text.encode("utf-8")
    return _split(raw, _cuts(np.frombuffer(raw, dtype=np.uint8)).tolist())


def _split(raw: bytes, cuts: list[int]) -> tuple[list[str], list[int]]:
    n, start, chunks, unsafe, begins_unsafe = len(raw), 0, [], [], False
    for end in [*cuts, n]:
        while end - start > MAX_CHUNK:
            at = start + MAX_CHUNK
            while raw[at] & 0xC0 == 0x80:
                at -= 1
            if begins_unsafe:
                unsafe.append(len(chunks))
            chunks.append(raw[start:at].decode("utf-8"))
            start, begins_unsafe = at, True
        if begins_unsafe:
            unsafe.append(len(chunks))
        chunks.append(raw[start:end].decode("utf-8"))
        start, begins_unsafe = end, False
    return chunks, unsafe


def repair_joins(chunks: list[str], ids: list[np.ndarray], unsafe: list[int], path: str) -> np.ndarray:
    """A text's ids from its chunks' ids, the surroundings of unsafe joins encoded anew.

    A span grows from the join to the next safe borders of the text, where the chunks'
    own ids must begin a token; if one doesn't, the span grows further.
    """
    text = "".join(chunks)
    lengths = _byte_lengths(path)
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]) if ids else np.empty(0, np.int64)
    ends = np.cumsum(lengths[flat])
    starts_of_token = {0: 0} | {int(e): i + 1 for i, e in enumerate(ends)}
    char_starts = np.cumsum([0, *map(len, chunks)])
    borders = [0, *(m.start() for m in _SAFE.finditer(text)), len(text)]
    # Byte offset of every border, by encoding the stretches between them once.
    offsets = np.cumsum([0, *(len(text[a:b].encode("utf-8")) for a, b in zip(borders, borders[1:]))]).tolist()
    spans: list[list[int]] = []
    for k in unsafe:
        at = int(char_starts[k])
        hi = int(np.searchsorted(borders, at, side="left"))
        lo = int(np.searchsorted(borders, at, side="right")) - 1
        while offsets[lo] not in starts_of_token:
            lo -= 1
        while offsets[hi] not in starts_of_token:
            hi += 1
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    enc, out, done = encoding(path), [], 0
    for lo, hi in spans:
        out.append(flat[done : starts_of_token[offsets[lo]]])
        out.append(np.asarray(enc.encode_ordinary(text[borders[lo] : borders[hi]]), dtype=np.int64))
        done = starts_of_token[offsets[hi]]
    return np.concatenate([*out, flat[done:]])


def _chunk_rows(keys: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            column = batch.column("_text")
            texts = (column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column).fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[: offsets[-1]]
            cuts = _cuts(data) if len(data) else np.empty(0, np.int64)
            first = np.searchsorted(cuts, offsets[:-1] + WINDOW, side="left")
            last = np.searchsorted(cuts, offsets[1:], side="left")
            raw = memoryview(data)
            rows, seq, hashes, sent, raws, unsafes = [], [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                chunks, unsafe = _split(bytes(raw[lo:hi]), (cuts[first[i] : last[i]] - lo).tolist())
                keep = bool(unsafe)
                for k, chunk in enumerate(chunks):
                    h = xxhash.xxh3_128_digest(chunk)
                    rows.append(i)
                    seq.append(k)
                    hashes.append(h)
                    unsafes.append(keep and k in unsafe)
                    raws.append(chunk if keep else None)
                    if h in seen:
                        sent.append(None)
                    else:
                        seen.add(h)
                        sent.append(chunk)
                if len(seen) > REMEMBERED:
                    seen = set()
            taken = batch.select(keys.names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(seq, pa.int32()), pa.array(hashes, pa.binary()), pa.array(sent, pa.string()), pa.array(raws, pa.string()), pa.array(unsafes, pa.bool_())],
                names=[*keys.names, "_seq", "_hash", "_chunk", "_raw", "_unsafe"],
            )

    return run


def _encode_rows(keys: pa.Schema, path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        last_hash, last_ids = None, None
        for batch in batches:
            hashes, chunks = batch.column("_hash").to_pylist(), batch.column("_chunk").to_pylist()
            parts = []
            for h, chunk in zip(hashes, chunks):
                if h != last_hash:
                    last_hash, last_ids = h, enc.encode_to_numpy(chunk)
                parts.append(last_ids)
            sizes = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))
            if with_ids:
                flat = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
                value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            else:
                value = pa.array(sizes)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys.names), batch.column("_seq"), value, batch.column("_raw"), batch.column("_unsafe")], names=[*keys.names, "_seq", "_value", "_raw", "_unsafe"])

    return run


def _pieces(df: DataFrame, keys: list[str], text: str, path: str, with_ids: bool) -> DataFrame:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    src = df.select(*keys, F.xxhash64(F.col(text)).alias("_doc"), F.col(text).alias("_text"))
    kept = T.StructType(src.schema.fields[:-1])
    arrow = to_arrow_schema(kept)
    chunk_schema = T.StructType([*kept.fields, T.StructField("_seq", T.IntegerType()), T.StructField("_hash", T.BinaryType()), T.StructField("_chunk", T.StringType()), T.StructField("_raw", T.StringType()), T.StructField("_unsafe", T.BooleanType())])
    value = T.ArrayType(T.IntegerType()) if with_ids else T.IntegerType()
    piece_schema = T.StructType([*kept.fields, T.StructField("_seq", T.IntegerType()), T.StructField("_value", value), T.StructField("_raw", T.StringType()), T.StructField("_unsafe", T.BooleanType())])
    rows = spread(src).mapInArrow(_chunk_rows(arrow), chunk_schema)
    # Equal chunks meet in one partition; a rebalance lets AQE split a hot one, and as each
    # map task sends a chunk's text once, every split holds the text it needs.
    together = rows.hint("rebalance", "_hash").sortWithinPartitions("_hash", F.col("_chunk").isNull())
    pieces = together.mapInArrow(_encode_rows(arrow, path, with_ids), piece_schema)
    return pieces.groupBy(*keys, "_doc").agg(F.sort_array(F.collect_list(F.struct("_seq", "_value", "_raw", "_unsafe"))).alias("_p")).withColumn("_p", F.expr("filter(_p, (x, i) -> i = 0 or _p[i - 1]._seq <> x._seq)"))


def token_ids(df: DataFrame, keys: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """(keys, ids ARRAY<INT>) of every distinct (keys, text), without special tokens.

    Null and empty texts both give the empty list; blanks are encoded as they are; what
    looks like a special token is plain text; equal rows give one row; nulls among the
    keys are kept; no rows give no rows; other columns are left out, whatever their names.
    """
    repair = F.pandas_udf(_repair_series(path), "array<int>")
    pieces = _pieces(df, keys, text, path, True)
    broken = F.when(F.exists("_p", lambda x: x["_unsafe"]), F.col("_p"))
    return pieces.withColumn("_fixed", repair(F.transform(broken, lambda x: x["_value"]), F.transform(broken, lambda x: x["_raw"]), F.transform(broken, lambda x: x["_unsafe"]))).select(
        *keys, F.coalesce("_fixed", F.flatten(F.transform("_p", lambda x: x["_value"]))).alias("ids")
    )


def _repair_series(path: str):
    import pandas as pd

    def run(ids: pd.Series, raws: pd.Series, unsafe: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else repair_joins(list(r), list(v), [k for k, x in enumerate(u) if x], path).astype(np.int32) for v, r, u in zip(ids, raws, unsafe)], dtype=object)

    run.__annotations__ = {"ids": pd.Series, "raws": pd.Series, "unsafe": pd.Series, "return": pd.Series}
    return run


def token_counts(df: DataFrame, keys: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """(keys, tokens INT): as token_ids, with only the number of ids of each text.

    A text with a cut that isn't safe is counted as a whole.
    """
    pieces = _pieces(df, keys, text, path, False)
    broken = F.when(F.exists("_p", lambda x: x["_unsafe"]), F.array_join(F.transform("_p", lambda x: x["_raw"]), ""))
    counted = F.pandas_udf(_count_series(path), "int")
    return pieces.withColumn("_n", counted(broken)).select(*keys, F.coalesce("_n", F.aggregate("_p", F.lit(0), lambda a, x: a + x["_value"])).alias("tokens"))


def _count_series(path: str):
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else len(encoding(path).encode_ordinary(t)) for t in texts], dtype="Int32")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return run
