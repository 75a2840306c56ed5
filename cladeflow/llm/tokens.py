"""Token ids of the whole corpus by a public byte-level BPE tokenizer.

A text up to LEAF characters is encoded as it is. A longer one is halved again and again into leaves that are encoded
apart, and its ids are put together up the same tree. The tokenizer never joins a character that is no white space with
white space after it, so where such a place lies near the middle the halves' ids are just concatenated. In unsplit text
the cut falls inside a run, and a window of tokens around the join is encoded again, growing until its outermost tokens
agree with those of both halves; what lies beyond is then the same in either encoding.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
# Fixed value: the tokenizer's pattern of units that are never joined.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Longest text that is encoded in one piece.
LEAF = 8_192
#: Texts longer than this are encoded by several tasks.
APART = 32_768


@lru_cache(maxsize=4)
def encoding(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> tiktoken.Encoding:
    """The tokenizer ``name`` of ``folder``, once per Python worker."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# White space for the tokenizer, after a character that is none: it surely ends a unit before such a place.
_SURE = re.compile(r"(?<=\S)[ \t\n\r]")


def _ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)


def cut_place(text: str, start: int, end: int) -> tuple[int, bool]:
    """Where to cut ``text[start:end]``, and whether the tokenizer surely ends a unit there.

    The first sure place after the middle, else the last before it, within an eighth of the length; else near the middle.
    """
    middle, reach = (start + end) // 2, max(1, (end - start) // 8)
    found = _SURE.search(text, max(start + 1, middle), min(end, middle + reach))
    if found is None:
        for found in _SURE.finditer(text, max(start + 1, middle - reach), middle):
            pass
    if found is not None and found.start() > start:
        return found.start(), True
    at = middle
    while at - start > 1 and "'" in text[max(start, at - 3) : at]:  # an apostrophe may be a unit with letters after it
        at -= 1
    return at, False


def leaves(text: str, leaf: int = LEAF) -> list[tuple[str, int, int, bool]]:
    """The leaves of the tree over ``text`` in order: path from the root, start, end, and whether the start is sure."""
    out = []
    todo = [("", 0, len(text), True)]
    while todo:
        path, start, end, sure = todo.pop()
        if end - start <= leaf:
            out.append((path, start, end, sure))
            continue
        at, at_sure = cut_place(text, start, end)
        todo += [(path + "1", at, end, at_sure), (path + "0", start, at, sure)]
    return out


def join_ids(enc: tiktoken.Encoding, left: np.ndarray, right: np.ndarray, sure: bool) -> np.ndarray:
    """Ids of the concatenation of two texts from those of each."""
    if sure or not len(left) or not len(right):
        return np.concatenate([left, right])
    width = 8
    while True:
        a, b = left[-width:], right[:width]
        all_left, all_right = len(a) == len(left), len(b) == len(right)
        window = b"".join(enc.decode_tokens_bytes([*a.tolist(), *b.tolist()]))
        try:
            new = _ids(enc, window.decode("utf-8"))
        except UnicodeDecodeError:  # an outermost token holds part of a character
            if all_left and all_right:
                raise
            width *= 2
            continue
        n = min(4, len(a), len(b), len(new))
        if (all_left or np.array_equal(new[:n], a[:n])) and (all_right or np.array_equal(new[len(new) - n :], b[len(b) - n :])):
            return np.concatenate([left[: len(left) - len(a)], new, right[len(b) :]])
        width *= 2


def fold(enc: tiktoken.Encoding, parts: list[tuple[str, bool, np.ndarray]]) -> np.ndarray:
    """Ids of a text from those of its leaves: (path, whether the start is sure, ids), in order."""
    stack: list[tuple[str, bool, np.ndarray]] = []
    for part in parts:
        stack.append(part)
        while len(stack) > 1 and stack[-1][0] and stack[-1][0][-1] == "1" and stack[-2][0] == stack[-1][0][:-1] + "0":
            path, sure, right = stack.pop()
            _, first_sure, left = stack.pop()
            stack.append((path[:-1], first_sure, join_ids(enc, left, right, sure)))
    assert len(stack) == 1, "leaves of one text are missing"
    return stack[0][2]


def encode(enc: tiktoken.Encoding, text: str, leaf: int = LEAF) -> np.ndarray:
    """Ids of one text, without special tokens; strings of special tokens are ordinary text."""
    if len(text) <= leaf:
        return _ids(enc, text)
    return fold(enc, [(path, sure, _ids(enc, text[start:end])) for path, start, end, sure in leaves(text, leaf)])


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


def _slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _long_texts(rows: DataFrame, name: str, folder: str, leaf: int) -> DataFrame:
    """``id`` and ``ids`` of texts above APART: leaves to all tasks, and the trees folded one text at a time."""
    id_type = rows.schema["id"].dataType
    cut_schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("at", T.LongType()), T.StructField("path", T.StringType()), T.StructField("sure", T.BooleanType()), T.StructField("text", T.StringType())])
    ids_schema = T.StructType([*cut_schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in _slices(batch, 1):
                text = one.column(2)[0].as_py()
                parts = leaves(text, leaf)
                again = one.take(pa.array([0] * len(parts)))
                yield pa.RecordBatch.from_arrays(
                    [again.column(0), again.column(1), pa.array([p[1] for p in parts], pa.int64()), pa.array([p[0] for p in parts], pa.string()), pa.array([p[3] for p in parts], pa.bool_()), pa.array([text[p[1] : p[2]] for p in parts], pa.string())],
                    names=cut_schema.names,
                )

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:5], _lists([_ids(enc, x) for x in part.column(5).to_pylist()])], names=ids_schema.names)

    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        values = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int32) for x in t.column("ids")]
        ids = fold(encoding(name, folder), list(zip(t.column("path").to_pylist(), t.column("sure").to_pylist(), values)))
        return pa.table([t.column("id").slice(0, 1).combine_chunks(), _lists([ids])], names=["id", "ids"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    encoded = numbered.mapInArrow(cut, cut_schema).repartition("row", "at").mapInArrow(leaf_ids, ids_schema)
    return encoded.groupBy("row").applyInArrow(up, T.StructType([T.StructField("id", id_type), ids_schema["ids"]]))


def _parts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    long = F.coalesce(F.length("text") > APART, F.lit(False))
    return rows.filter(~long), rows.filter(long)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, leaf: int = LEAF) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row's whole text.

    Null and empty texts have no ids: an empty list. White space is text like any other. A row is encoded each time that
    it occurs, null ids stay null, an empty table gives no rows; other columns are not read. Only texts above APART
    characters are shuffled.
    """
    short, long = _parts(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            for part in _slices(batch):
                ids = [encode(enc, x, leaf) if x else np.zeros(0, np.int32) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], names=["id", "ids"])

    schema = T.StructType([T.StructField("id", short.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = short.mapInArrow(run, schema).unionByName(_long_texts(long, name, folder, leaf))
    return out.withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, leaf: int = LEAF) -> DataFrame:
    """``id_col`` and ``n_tokens`` of every row, as :func:`encode_corpus` would have them; ids don't leave the tasks."""
    short, long = _parts(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            n = [len(encode(enc, x, leaf)) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    schema = T.StructType([T.StructField("id", short.schema["id"].dataType), T.StructField("n_tokens", T.LongType())])
    rest = _long_texts(long, name, folder, leaf).select("id", F.size("ids").cast("bigint").alias("n_tokens"))
    return short.mapInArrow(run, schema).unionByName(rest).withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col``, ``text`` and ``n_tokens`` of every row's ids; the empty text where there are none. Nothing is shuffled."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            for part in _slices(batch):
                lists = [x or [] for x in part.column(1).to_pylist()]
                texts = [enc.decode_bytes(x).decode("utf-8", "replace") for x in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in lists], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
