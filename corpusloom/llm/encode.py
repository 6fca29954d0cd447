"""Encoding of a corpus with a public byte-level BPE tokenizer through a table of distinct words.

The tokenizer's own pre-split runs in the JVM, each distinct word is encoded once, and the ids are joined back by
position; decoding joins each id to its piece. Word frequencies are heavy at the head, so the dictionary is joined
in two parts: the frequent words, of which there can be at most 1 / FREQUENT (50,000), are broadcast; the rest go
through a shuffle join whose keys each hold less than that share of the rows. A null and an empty text have no words and get
an empty list. Vocabulary files are read from a path on every worker and are never copied.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"
#: Fixed value: the pre-split that belongs to the byte-level vocabularies (with Unicode blanks).
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{IsN}+| ?[^\s\p{L}\p{IsN}]+|\s+(?!\S)|\s+"
#: Share of all word occurrences from which a word counts as frequent: at most 1 / FREQUENT words.
FREQUENT = 2e-5


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    # every input is one pre-split word, so the whole of it is one unit for the merges
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(path), special_tokens={})


def _path(tokenizer: str, folder: str) -> str:
    return f"{folder}/{tokenizer}.tiktoken"


def split_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _id, words): the words of every row's text in order, and a number of its own for each row."""
    return docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPLIT), F.lit(0)).alias("words"))


def encode_words(table: DataFrame, tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """Adds ``ids`` to a table of distinct words (columns word, n), one Arrow batch at a time."""
    path = _path(tokenizer, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for b in batches:
            # surrogates cannot occur in a Spark string, so encode_ordinary sees the exact bytes
            yield pd.DataFrame({"word": b["word"], "n": b["n"], "ids": [enc.encode_ordinary(w) for w in b["word"]]})

    return table.mapInPandas(run, "word string, n long, ids array<int>")


def dictionary(docs: DataFrame, text_col: str = "text", tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """(word, n, ids) of every distinct word of the corpus, counted before the shuffle and written once."""
    one = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPLIT), F.lit(0))).alias("word"))
    return cut_lineage(encode_words(one.groupBy("word").agg(F.count("*").alias("n")), tokenizer, folder))


def _split(table: DataFrame) -> tuple[pa.Table, DataFrame, bool]:
    """The dictionary's frequent words (at most 1 / FREQUENT, as a table to broadcast), the others, and whether there
    are others."""
    s = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.min("n"), F.lit(0)).alias("least")).first()
    cut = int(FREQUENT * s["total"])
    return table.where(F.col("n") > cut).select("word", "ids").toArrow(), table.where(F.col("n") <= cut).drop("n"), s["least"] <= cut and s["total"] > 0


def _flat(b: pa.RecordBatch, often: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a batch (_row, _id, words): for each word its record, itself, its place among the frequent words (-1: rare)
    and its position."""
    lists = b.column(2)
    offs = lists.offsets.to_numpy()
    flat = lists.values.slice(offs[0], offs[-1] - offs[0])
    sizes = np.diff(offs)
    owner = np.repeat(np.arange(len(lists)), sizes)
    pos = np.arange(len(owner)) - np.repeat(offs[:-1] - offs[0], sizes)
    found = pc.index_in(flat, value_set=often.column("word").combine_chunks())
    return owner, flat, pc.fill_null(found, -1).to_numpy(zero_copy_only=False), pos


def _stretches(held) -> Callable:
    """Looks the frequent words up and joins the ids of neighbours: one output record (_row, _id, pos, word, ids) per
    rare word and per stretch between them, and one for a record without words. All on Arrow buffers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        ids = often.column("ids").combine_chunks()
        for b in batches:
            owner, flat, at, pos = _flat(b, often)
            rare = at < 0
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | rare[1:] | rare[:-1]
            first = np.flatnonzero(new)
            got = ids.take(pa.array(at, mask=rare))
            sizes = pc.fill_null(pc.list_value_length(got), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            none = np.setdiff1d(np.arange(b.num_rows), owner)  # records without words
            offs = np.concatenate([ends[first], np.repeat(ends[-1:], len(none) + 1)]).astype(np.int32)
            take = pa.array(np.concatenate([owner[first], none]))
            word = pa.concat_arrays([pc.if_else(pa.array(rare[first]), flat.take(pa.array(first)), pa.nulls(len(first), flat.type)), pa.nulls(len(none), flat.type)])
            where = pa.array(np.concatenate([pos[first], np.zeros(len(none))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), where, word, pa.ListArray.from_arrays(pa.array(offs), got.flatten().cast(pa.int32()))], ["_row", "_id", "pos", "word", "ids"])

    return run


def _sums(held) -> Callable:
    """Per record the summed tokens of its frequent words, and a record per rare word (_row, _id, word, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        size = np.concatenate([pc.list_value_length(often.column("ids").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64), [0]])
        for b in batches:
            owner, flat, at, _ = _flat(b, often)
            known = np.bincount(owner, weights=size[at], minlength=b.num_rows).astype(np.int64)
            rare = np.flatnonzero(at < 0)
            take = pa.array(np.concatenate([np.arange(b.num_rows), owner[rare]]))
            word = pa.concat_arrays([pa.nulls(b.num_rows, flat.type), flat.take(pa.array(rare))])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), word, pa.array(np.concatenate([known, np.zeros(len(rare), dtype=np.int64)]))], ["_row", "_id", "word", "k"])

    return run


def _key() -> Column:
    """Join key of a record: its rare word, else a value of its own that is no word, so that these records spread."""
    return F.coalesce("word", F.concat(F.lit("\x00"), F.col("_row").cast("string")))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids) of every row, without special tokens. Rows are kept apart by a number of their own, so repeated and
    null ids give one row each.

    One pass splits the texts, looks frequent words up in the broadcast table and joins their ids to stretches inside
    the task; only stretches and rare words are shuffled."""
    often, rare, any_rare = _split(dictionary(docs, text_col, tokenizer, folder))
    held = docs.sparkSession.sparkContext.broadcast(often)
    cut = split_words(docs, id_col, text_col)
    rows = cut.mapInArrow(_stretches(held), f"_row long, _id {cut.schema['_id'].dataType.simpleString()}, pos int, word string, ids array<int>")
    if any_rare:
        rows = rows.withColumn("_k", _key()).join(rare.select(F.col("word").alias("_k"), F.col("ids").alias("_r")), "_k", "left").select("_row", "_id", "pos", F.coalesce("_r", "ids").alias("ids"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]))
    return rows.groupBy("_row", "_id").agg(whole.alias("ids")).select(F.col("_id").alias(id_col), "ids")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens) of every row. A row's frequent words are summed inside the task; the sum and the row's rare
    words are all that is shuffled."""
    often, rare, any_rare = _split(dictionary(docs, text_col, tokenizer, folder))
    held = docs.sparkSession.sparkContext.broadcast(often)
    cut = split_words(docs, id_col, text_col)
    per = cut.mapInArrow(_sums(held), f"_row long, _id {cut.schema['_id'].dataType.simpleString()}, word string, k long")
    if any_rare:
        per = per.withColumn("_k", _key()).join(rare.select(F.col("word").alias("_k"), F.size("ids").alias("_r")), "_k", "left").withColumn("k", F.coalesce("_r", "k"))
    return per.groupBy("_row", "_id").agg(F.sum("k").cast("bigint").alias("n_tokens")).select(F.col("_id").alias(id_col), "n_tokens")


def pieces(tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> pa.Array:
    """The bytes of every id of the vocabulary, by id; the vocabulary's size bounds the table."""
    ranks = _ranks(_path(tokenizer, folder))
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    return pa.array(table, type=pa.large_binary())


def _texts(held) -> Callable:
    """Joins each id to its piece (ids outside of the vocabulary: none) and the pieces of a record to its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            lists = b.column(1)
            offs = lists.offsets.to_numpy()
            flat = lists.values.slice(offs[0], offs[-1] - offs[0])
            known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, None)
            got = pc.fill_null(table.take(known), b"")
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(got).to_numpy(zero_copy_only=False).astype(np.int64))])[offs - offs[0]]
            data = memoryview(b"".join(got.to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([str(data[i:j], "utf-8", "replace") for i, j in zip(ends[:-1], ends[1:])], type=pa.string())], ["_id", "text"])

    return run


def decode(encoded: DataFrame, id_col: str = "doc_id", tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """(id, text) by joining each id to its piece in the broadcast vocabulary, inside the task. A null or empty list
    gives an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer, folder))
    x = encoded.select(F.col(id_col).alias("_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return x.mapInArrow(_texts(held), f"_id {x.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)
