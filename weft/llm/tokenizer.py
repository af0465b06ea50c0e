"""Encoding and decoding of a corpus with a public byte-level BPE through a distinct-word table.

A byte-level BPE first splits text into words by a fixed pattern and never merges across words.  So the
text is split in Spark (JVM regular expression), every distinct word is encoded once, and the ids are
joined back by position: those of frequent words, a bounded number, from a table that every task has,
those of rare words through a shuffle.  One plan serves every size.

Texts with characters that this JVM's Unicode tables don't know (where its classes could differ from
the tokenizer's) are encoded whole in an Arrow function instead.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.wordtable import FREQUENT_WORDS, places, split, unknown
from weft.plans.runtime import Scratch

TOKENIZER_DIR = "/opt/tokenizers"
RANKS_FILE = "byte_bpe_50k.tiktoken"

_WHITE = r"\t-\r\x20\x85\xA0  -     　"
#: The public split pattern, with white space spelled out because Java's \s is ASCII only.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
_UNKNOWN = r"\p{Cn}"
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(directory: str = TOKENIZER_DIR, name: str = RANKS_FILE):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(f"{directory}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoder(directory: str, name: str):
    def run(batches):
        tokenizer = load(directory, name)
        for batch in batches:
            ids = [tokenizer.encode_ordinary(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return run


def words(column):
    """array<string> of the words of a text; their concatenation is the text."""
    return F.regexp_extract_all(column, F.lit(SPLIT), F.lit(0))


def word_table(texts: DataFrame, directory: str = TOKENIZER_DIR, name: str = RANKS_FILE) -> DataFrame:
    """(word, n, ids) of every distinct word of the column ``text``, n times found."""
    counted = texts.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInArrow(_encoder(directory, name), "word string, n bigint, ids array<int>")


def _assembler(frequent: list):
    """(words, key) to (key, runs, gaps): the ids between the words that aren't known, and those words."""
    index = {r.word: i for i, r in enumerate(frequent)}
    ids = pa.array([r.ids for r in frequent] + [[]], pa.list_(pa.int32()))
    sizes = np.array([len(r.ids) for r in frequent] + [0], np.int64)

    def run(batches):
        for batch in batches:
            offsets, at, encoded = places(batch.column(0), index)
            tokens = ids.take(pa.array(np.where(at < 0, len(frequent), at))).flatten()
            before = np.r_[0, np.cumsum(sizes[at])]  # tokens before each word
            missing = np.flatnonzero(at < 0)
            # a run ends at each unknown word and at the end of its document
            ends = np.r_[missing * 2 + 1, offsets[1:] * 2]
            ends.sort()
            inner = np.r_[0, before[ends // 2]].astype(np.int32)
            outer = (np.searchsorted(missing, offsets) + np.arange(len(offsets))).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), tokens))
            yield pa.RecordBatch.from_arrays([batch.column(1), runs, unknown(offsets, at, encoded)], ["key", "runs", "gaps"])

    return run


def _counter(frequent: list):
    """(words, key) to (key, n, gaps): the known words' tokens, and the words that aren't known."""
    index = {r.word: i for i, r in enumerate(frequent)}
    sizes = np.array([len(r.ids) for r in frequent] + [0], np.int64)

    def run(batches):
        for batch in batches:
            offsets, at, encoded = places(batch.column(0), index)
            before = np.r_[0, np.cumsum(sizes[at])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(before[offsets])), unknown(offsets, at, encoded)], ["key", "n", "gaps"])

    return run


def encode(
    df: DataFrame, key: str, text: str, directory: str = TOKENIZER_DIR, name: str = RANKS_FILE, frequent_words: int = FREQUENT_WORDS
) -> DataFrame:
    """(key, ids) of each document, without special tokens; their strings are ordinary text.

    Null and empty texts give the empty list.  ``key`` is unique; texts may be of any length; an empty
    table gives no rows; other columns are ignored.
    """
    scratch, docs, known, table = _prepared(df, key, text, directory, name)
    frequent, rare = split(table, frequent_words)
    kind = docs.schema["key"].dataType.simpleString()
    split_words = docs.filter(known).select(words(F.col("text")).alias("words"), "key")
    found = scratch.keep(split_words.mapInArrow(_assembler(frequent), f"key {kind}, runs array<array<int>>, gaps array<string>"))
    gaps = found.select("key", F.posexplode("gaps").alias("pos", "word")).join(rare.select("word", "ids"), "word")
    filled = gaps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("fill"))
    joined = found.filter(F.size("gaps") > 0).join(filled, "key")
    woven = F.flatten(F.zip_with("runs", "fill", lambda r, f: F.concat(r, F.coalesce(f["ids"], F.array().cast("array<int>")))))
    whole = found.filter(F.size("gaps") == 0).select("key", F.col("runs")[0].alias("ids"))
    return whole.unionByName(joined.select("key", woven.alias("ids"))).unionByName(_whole_ids(docs.filter(~known), directory, name)).withColumnRenamed("key", key)


def _prepared(df: DataFrame, key: str, text: str, directory: str, name: str):
    """The scratch folder, (key, text) rows, the condition for splitting in Spark, the written word table."""
    scratch = Scratch(df.sparkSession, "tokenizer")
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = ~F.col("text").rlike(_UNKNOWN)
    return scratch, docs, known, scratch.keep(word_table(docs.filter(known), directory, name))


def _whole_ids(docs: DataFrame, directory: str, name: str) -> DataFrame:
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("text", "key").mapInArrow(_whole(directory, name), schema)


def _whole(directory: str, name: str):
    def run(batches):
        tokenizer = load(directory, name)
        for batch in batches:
            ids = [tokenizer.encode_ordinary(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def sizes(
    df: DataFrame, key: str, text: str, directory: str = TOKENIZER_DIR, name: str = RANKS_FILE, frequent_words: int = FREQUENT_WORDS
) -> DataFrame:
    """(key, n_tokens) of each document, the lengths of ``encode``'s lists without the lists; 0 for null and
    empty texts."""
    scratch, docs, known, table = _prepared(df, key, text, directory, name)
    frequent, rare = split(table, frequent_words)
    kind = docs.schema["key"].dataType.simpleString()
    split_words = docs.filter(known).select(words(F.col("text")).alias("words"), "key")
    found = scratch.keep(split_words.mapInArrow(_counter(frequent), f"key {kind}, n bigint, gaps array<string>"))
    gaps = found.select("key", F.explode("gaps").alias("word")).join(rare.select("word", F.size("ids").cast("bigint").alias("n")), "word").select("key", "n")
    usual = found.select("key", "n").unionByName(gaps).groupBy("key").agg(F.sum("n").cast("int").alias("n_tokens"))
    whole = _whole_ids(docs.filter(~known), directory, name).select("key", F.size("ids").alias("n_tokens"))
    return usual.unionByName(whole).withColumnRenamed("key", key)


def pieces(spark, directory: str = TOKENIZER_DIR, name: str = RANKS_FILE) -> DataFrame:
    """(id, piece binary): the vocabulary, whose size is fixed by its file."""
    lines = spark.read.text(f"file://{directory}/{name}")
    parts = F.split("value", " ")
    return lines.filter("value <> ''").select(parts[1].cast("int").alias("id"), F.unbase64(parts[0]).alias("piece"))


def decode(encoded: DataFrame, key: str, ids: str, directory: str = TOKENIZER_DIR, name: str = RANKS_FILE) -> DataFrame:
    """(key, text) of id lists by a join with the id-to-piece table.

    Null and empty lists give the empty text; an id outside the vocabulary is an error.
    """
    vocabulary = pieces(encoded.sparkSession, directory, name).select("id", F.hex("piece").alias("piece"))
    rows = encoded.repartition(key).select(F.col(key).alias("key"), F.posexplode_outer(ids).alias("pos", "id"))
    joined = rows.join(F.broadcast(vocabulary), "id", "left")  # a fixed vocabulary of under 1 MB
    checked = F.when(F.col("id").isNotNull() & F.col("piece").isNull(), F.raise_error(F.concat(F.lit("no such id: "), "id"))).otherwise(F.col("piece"))
    parts = F.sort_array(F.collect_list(F.struct("pos", checked.alias("piece"))))
    gathered = joined.groupBy("key").agg(parts.alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda x: x["piece"]), "")), "UTF-8")
    return gathered.select(F.col("key").alias(key), text.alias("text"))
