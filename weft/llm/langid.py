"""Language of each line and each document by segmentation-marginalised piece unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The score of a word is
the sum over all its segmentations into pieces of the product of their probabilities, by the forward
algorithm; a line's score is the sum of its words' logarithms.  Pieces don't cross words, so each
distinct word of the corpus is scored once and its seven numbers are joined back: those of a bounded
number of frequent words from a table that every task has, those of rare words through a shuffle.

Piece probabilities are fitted by expectation-maximisation over the words of a bounded sample of
labelled documents: about ``train_docs`` per language, chosen by a hash of the id.  Labels may be wrong
and lines may be in another language, so the fit is repeated on the sample's lines whose best language
is their label.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.tokenizer import TOKENIZER_DIR
from weft.llm.wordtable import FREQUENT_WORDS, places, split, unknown
from weft.plans.runtime import Scratch

LANGUAGES = ("ar", "de", "en", "es", "fr", "it", "pt")
VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCS = 400
MIN_WORDS = 5
#: Longest piece in letters; longer ones of the vocabulary are left out, words of any length are scored.
LONGEST_PIECE = 16
#: Letters of a word that are fitted at once.
FIT_LETTERS = 64
_UNKNOWN = 1e-7
_START = "▁"
_BLANK = "\\t-\\r\\x1C-\\x20\\x85\\xA0   -     　"


def vocabulary(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> frozenset[str]:
    """The lower-cased pieces of letters, with or without the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{directory}/{name}")
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return frozenset(p for p in pieces if len(p) <= LONGEST_PIECE and (p == _START or p.removeprefix(_START).isalpha()))


class Unigrams:
    """Probability rows (one value per language) of pieces."""

    def __init__(self, table: dict[str, np.ndarray], other: np.ndarray):
        self.table, self.other = table, other

    def arcs(self, word: str):
        """(from, to, piece) of each piece in the marked word; single characters always have one."""
        text = _START + word
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + LONGEST_PIECE) + 1):
                piece = text[i:j]
                if piece in self.table or j == i + 1:
                    yield i, j, piece

    def forward(self, word: str):
        """Log-probability per language; scaled at each position, so words of any length work."""
        n = len(word) + 1
        alpha = np.zeros((n + 1, len(self.other)))
        alpha[0] = 1.0
        logs, done = np.zeros(len(self.other)), 0
        for i, j, piece in self.arcs(word):
            if i > done:
                done = i
                if i % 8 == 0:  # rescale all open positions
                    top = np.maximum(alpha[i : min(n, i + LONGEST_PIECE) + 1].max(axis=0), 1e-300)
                    alpha[i : i + LONGEST_PIECE + 1] /= top
                    logs += np.log(top)
            alpha[j] += alpha[i] * self.table.get(piece, self.other)
        return logs + np.log(np.maximum(alpha[n], 1e-300))


class Forward:
    """``Unigrams.forward`` of many words at once: words of one length go through the positions together."""

    LETTERS = 40  # products of so many probabilities don't underflow; longer words go one by one

    def __init__(self, model: Unigrams):
        self.model = model
        self.rows = np.array([*model.table.values(), model.other]).reshape(-1, len(model.other))
        self.nodes: dict[str, int] = {}  # piece to its row, beginning of a piece to -1
        for p in model.table:
            for k in range(1, len(p)):
                self.nodes.setdefault(p[:k], -1)
        self.nodes |= {p: i for i, p in enumerate(model.table)}

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.rows.shape[1]))
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for n, places in by_length.items():
            if n > self.LETTERS:
                for i in places:
                    out[i] = self.model.forward(words[i])
            else:
                out[places] = self._same_length([_START + words[i] for i in places], n + 1)
        return out

    def _same_length(self, texts: list[str], n: int) -> np.ndarray:
        arcs: dict[tuple[int, int], tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        nodes, other = self.nodes, len(self.rows) - 1
        for b, text in enumerate(texts):
            for i in range(n):
                for j in range(i + 1, n + 1):
                    row = nodes.get(text[i:j])
                    if row is None:
                        if j == i + 1:
                            found = arcs[i, j]
                            found[0].append(b), found[1].append(other)
                        break
                    if row >= 0 or j == i + 1:
                        found = arcs[i, j]
                        found[0].append(b), found[1].append(row if row >= 0 else other)
        alpha = np.zeros((n + 1, len(texts), self.rows.shape[1]))
        alpha[0] = 1.0
        for (i, j), (b, rows) in sorted(arcs.items()):
            alpha[j][b] += alpha[i][b] * self.rows[rows]
        return np.log(np.maximum(alpha[n], 1e-300))


def fit(counts: list[tuple[str, str, int]], pieces: frozenset[str], rounds: int = 2, strength: float = 300.0) -> Unigrams:
    """Piece probabilities from (language, word, count) by expectation-maximisation.

    Smoothed towards the mean over languages, so that a piece rare everywhere says little.
    """
    where = {c: k for k, c in enumerate(LANGUAGES)}
    words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
    for language, word, n in counts:
        for i in range(0, len(word), FIT_LETTERS):  # a run of any length is learned from, in parts that floats can hold
            words[word[i : i + FIT_LETTERS]][where[language]] += n
    flat = np.full(len(LANGUAGES), 1.0)
    model = Unigrams({}, flat * 1e-4)
    found = {p for w in words for p in _pieces_of(w, pieces)}
    model = Unigrams({p: flat * 10.0 ** (len(p) - 8) for p in found}, flat * 1e-8)  # first: longer pieces preferred
    for _ in range(rounds):
        expected: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for word, n in words.items():
            arcs = list(model.arcs(word))
            size = len(word) + 1
            # probabilities are scaled by a power of the length, which cancels in the expectation
            alpha, beta = np.zeros((size + 1, len(LANGUAGES))), np.zeros((size + 1, len(LANGUAGES)))
            alpha[0] = beta[size] = 1.0
            rows = [model.table.get(p, model.other) * 1e3 ** (j - i) for i, j, p in arcs]
            for (i, j, _p), row in zip(arcs, rows):
                alpha[j] += alpha[i] * row
            for (i, j, _p), row in zip(reversed(arcs), reversed(rows)):
                beta[i] += beta[j] * row
            total = np.maximum(alpha[size], 1e-290)
            for (i, j, piece), row in zip(arcs, rows):
                expected[piece] += n * alpha[i] * row * beta[j] / total
        mass = np.maximum(sum(expected.values(), np.zeros(len(LANGUAGES))), 1e-9)
        share = {p: e / mass for p, e in expected.items()}
        mean = {p: s.mean() for p, s in share.items()}
        table = {p: (expected[p] + strength * mean[p]) / (mass + strength) for p in expected}
        model = Unigrams({p: row for p, row in table.items() if row.max() > 1e-9}, flat * _UNKNOWN)
    return model


def _pieces_of(word: str, pieces: frozenset[str]):
    text = _START + word
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + LONGEST_PIECE) + 1):
            if text[i:j] in pieces:
                yield text[i:j]


def lines(df: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """(key, seg_no, line): lines at U+000A without those of white space only, numbered from 0."""
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(f"[^{_BLANK}]"))
    return df.select(F.col(key).alias("key"), *others, F.posexplode(kept).alias("seg_no", "line"))


def line_words(line):
    """array<string>: lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))


def real_word(word: str) -> bool:
    """Two or more letters, marks not counted."""
    return len(word) > 1 and sum(not unicodedata.combining(c) and unicodedata.category(c)[0] != "M" for c in word) >= 2


def _scorer(model):
    def run(batches):
        forward = Forward(model)
        for batch in batches:
            found = forward.scores(batch.column(0).to_pylist())
            ends = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], ["word", "n", "scores"])

    return run


def _summer(frequent: list):
    """Batches of lines with ``words`` last to the same with n_words, the sum of the known words' scores, and
    the words that aren't known."""
    index = {r.word: i for i, r in enumerate(frequent)}
    scores = np.array([r.scores for r in frequent] + [[0.0] * len(LANGUAGES)])
    real = np.array([real_word(r.word) for r in frequent] + [False])

    def run(batches):
        for batch in batches:
            last = batch.num_columns - 1
            offsets, at, encoded = places(batch.column(last), index)
            gaps = unknown(offsets, at, encoded)
            counted = real[at]
            counted[at < 0] = [real_word(w) for w in gaps.values.to_pylist()]
            n = np.diff(np.r_[0, np.cumsum(counted)][offsets])
            table = np.zeros((len(offsets) - 1, len(LANGUAGES)))
            filled = np.flatnonzero(np.diff(offsets))
            if len(filled):
                table[filled] = np.add.reduceat(scores[at], offsets[filled], axis=0)
            arrays = [*(batch.column(i) for i in range(last)), pa.array(n.astype(np.int64)), *(pa.array(table[:, k]) for k in range(len(LANGUAGES))), gaps]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:last], "n_words", *(f"s{k}" for k in range(len(LANGUAGES))), "gaps"])

    return run


def _scored_lines(docs: DataFrame, model: Unigrams, scratch: Scratch, others: list[str], frequent_words: int) -> DataFrame:
    """(key, others, seg_no, n_words, s0..s6); docs: key, text, others.  Spark broadcasts the model, whose
    size the vocabulary bounds, with the function."""
    scores = [f"s{k}" for k in range(len(LANGUAGES))]
    counted = lines(docs, "key", "text").select(F.explode(line_words("line")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequent, rare = split(scratch.keep(counted.mapInArrow(_scorer(model), "word string, n bigint, scores array<double>")), frequent_words)
    rows = lines(docs, "key", "text", *others).select("key", *others, "seg_no", line_words("line").alias("words"))
    ids = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    found = scratch.keep(rows.mapInArrow(_summer(frequent), ", ".join([*ids, "n_words bigint", *(f"{c} double" for c in scores), "gaps array<string>"])))
    gaps = found.select("key", "seg_no", F.explode("gaps").alias("word")).join(rare, "word")
    filled = gaps.groupBy("key", "seg_no").agg(*(F.sum(F.col("scores")[k]).alias(f"r{k}") for k in range(len(LANGUAGES))))
    joined = found.filter(F.size("gaps") > 0).join(filled, ["key", "seg_no"])
    columns = ["key", *others, "seg_no", "n_words"]
    return found.filter(F.size("gaps") == 0).select(*columns, *scores).unionByName(joined.select(*columns, *((F.col(c) + F.col(f"r{c[1:]}")).alias(c) for c in scores)))


def _decided(df: DataFrame) -> DataFrame:
    """Adds language and confidence from s0..s6 and n_words.

    The confidence is the best language's posterior under equal priors, from the mean log-likelihood of a
    word: words of a line aren't independent, so their sum would make every line look certain."""
    names = F.array(*(F.struct(F.col(f"s{k}").alias("s"), F.lit(c).alias("c")) for k, c in enumerate(LANGUAGES)))
    best = F.array_max(names)
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    total = sum((F.exp((F.col(f"s{k}") - best["s"]) / words) for k in range(len(LANGUAGES))), F.lit(0.0))
    return df.withColumn("language", best["c"]).withColumn("confidence", 1.0 / total)


def train(df: DataFrame, key: str, text: str, label: str, scratch: Scratch, train_docs: int = TRAIN_DOCS, directory: str = TOKENIZER_DIR) -> Unigrams | None:
    """The model of a table with partly wrong labels; only labels that are one of LANGUAGES count.  None
    without any such label."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).filter(F.col("label").isin(*LANGUAGES) & F.col("text").isNotNull())
    share = {r.label: min(1.0, train_docs / r.n) for r in docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return None
    limit = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))[F.col("label")]
    draw = F.pmod(F.xxhash64("key", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    sample = scratch.keep(docs.filter(draw < limit))
    pieces = vocabulary(directory)

    def counted(rows):
        words = rows.select("label", F.explode(line_words("line")).alias("word")).groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
        return [(r.label, r.word, r.n) for r in words.collect()]  # bounded by the sample

    all_lines = lines(sample, "key", "text", "label")
    rough = fit(counted(all_lines), pieces, rounds=1)
    agreeing = _decided(_scored_lines(sample, rough, scratch, ["label"], FREQUENT_WORDS)).filter("language = label").select("key", "seg_no")
    return fit(counted(all_lines.join(agreeing, ["key", "seg_no"], "left_semi")), pieces)


def languages(df: DataFrame, key: str, text: str, label: str, train_docs: int = TRAIN_DOCS, frequent_words: int = FREQUENT_WORDS, directory: str = TOKENIZER_DIR) -> DataFrame:
    """(key, label, seg_no, n_words, language, confidence) of each line.

    n_words: words of two or more letters.  Null, empty and blank texts have no lines.  A line without
    any letter has an arbitrary language with confidence 1/7.  ``key`` is unique.  An empty table gives no
    rows; without any usable label there is no model, and language and confidence are null.
    """
    scratch = Scratch(df.sparkSession, "langid")
    model = train(df, key, text, label, scratch, train_docs, directory)
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
    if model is None:
        count = F.size(F.filter(line_words("line"), lambda w: F.length(F.regexp_replace(w, r"\p{M}", "")) >= 2)).cast("bigint")
        bare = lines(docs, "key", "text", "label").select("key", "label", "seg_no", count.alias("n_words"), *(F.lit(0.0).alias(f"s{k}") for k in range(len(LANGUAGES))))
        none = bare.withColumns({"language": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
        return none.withColumnRenamed("key", key)
    scored = _scored_lines(docs, model, scratch, ["label"], frequent_words)
    return _decided(scored).withColumnRenamed("key", key)


def document_languages(by_line: DataFrame, key: str) -> DataFrame:
    """(key, label, n_words, language, confidence) of each document with at least one line."""
    sums = (F.sum(f"s{k}").alias(f"s{k}") for k in range(len(LANGUAGES)))
    summed = by_line.groupBy(key, "label").agg(F.sum("n_words").alias("n_words"), F.count("language").alias("_known"), *sums)
    known = F.col("_known") > 0
    decided = _decided(summed)
    return decided.withColumns({c: F.when(known, F.col(c)) for c in ("language", "confidence")}).drop("_known")
