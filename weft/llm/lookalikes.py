"""One consistent form of text whose characters only look alike.

A token is first freed of ignorable characters and brought to compatibility-composed form (NFKC, with
every white space as U+0020).  What is left are letters of another script that look like the right
ones.  Each letter of a token becomes a column of a lattice with all its look-alikes; Viterbi picks the
path with the best sum of character trigram log-probabilities of the path's script, with a cost for each
letter that differs from the one written and a large cost for each change of script within the token.
The trigrams are counted over all tokens of the corpus that are wholly in one script.

Only tokens with a character outside printable ASCII and composed Latin letters are looked at, each
distinct one once; a word wholly in another script keeps its letters.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.runtime import Scratch

#: Letters that look alike across scripts, Latin letter first.  Letters of composed Latin, like the
#: dotless i, are ordinary and in no group.
GROUPS = (
    "aаαɑ", "bЬ", "cсϲ", "dԁ", "eе", "fϝ", "gɡց", "hһ", "iіιɩ", "jјϳ", "kкκ", "lӏ", "mм", "nпո", "oоοσօ", "pрρ", "qԛգ",
    "rг", "sѕ", "tτт", "uυս", "vνѵ", "wԝωѡ", "xхχ", "yуγү", "zᴢ", "äӓ", "ëё", "ïї", "æӕ",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ", "WԜ", "XХΧ", "YҮΥ", "ZΖ",
)
REPLACED, SWITCHED = 3.0, 25.0
_PLAIN = "\\x20-\\x7EÀ-ɏ"
#: A character outside the plain set, or one inside it that isn't in composed compatibility form.
SUSPECT = f"[^{_PLAIN}]|[ĲĳĿŀŉſǄ-ǌǱ-ǳ]"
_LATIN, _CYRILLIC, _GREEK = "a-zßà-öø-ɏ", "Ѐ-ԯ", "Ͱ-Ͽ"

_ALIKE: dict[str, set[str]] = defaultdict(set)
for _g in GROUPS:
    for _c in _g:
        _ALIKE[_c] |= set(_g) - {_c}
_HEADS = frozenset(g[0] for g in GROUPS)


def script_of(char: str) -> str:
    """latin, cyrillic, greek, other (letters), or '' for what isn't a letter."""
    if not char.isalpha():
        return ""
    code = ord(char)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    if 0x370 <= code < 0x400:
        return "greek"
    return "other"


#: Format characters that are seen, and others that aren't though they are no format characters.
SEEN = frozenset(map(chr, [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]))
UNSEEN = frozenset(map(chr, [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))


def ignorable(char: str) -> bool:
    """Format and control characters without a glyph, fillers, variation selectors."""
    return char in UNSEEN or (unicodedata.category(char) in ("Cf", "Cc") and not char.isspace() and char not in SEEN)


def visible(text: str) -> str:
    """Without ignorable characters, NFKC, white space as U+0020."""
    if text.isascii() and text.isprintable():
        return text
    kept = "".join(c for c in text if not ignorable(c))
    return "".join(" " if c.isspace() else c for c in unicodedata.normalize("NFKC", kept))


class Trigrams:
    """Smoothed character trigrams by script."""

    def __init__(self, counts: dict[tuple[str, str], int], strength: float = 5.0):
        self.tri = dict(counts)
        self.pair: dict = defaultdict(int)
        self.two: dict = defaultdict(int)
        self.one: dict = defaultdict(int)
        for (script, gram), n in counts.items():
            self.pair[script, gram[:2]] += n
            self.two[script, gram[1:]] += n
            self.one[script, gram[1]] += n
        self.strength = strength

    def log(self, script: str, before: str, char: str) -> float:
        k = self.strength
        flat = 1 / 100
        second = (self.two.get((script, before[1] + char), 0) + k * flat) / (self.one.get((script, before[1]), 0) + k)
        return math.log((self.tri.get((script, before + char), 0) + k * second) / (self.pair.get((script, before), 0) + k))


def best_path(token: str, model: Trigrams) -> str:
    """The token with each letter replaced by the look-alike of the best path."""
    if len({script_of(c) for c in token} - {""}) < 2 and not any(script_of(c) == "other" for c in token):
        return token  # wholly in one script: no path without changes is better
    # state: (script, last two letters of the path in this run); value: (score, path)
    states = {("", "^^"): (0.0, "")}
    for char in token:
        kind = script_of(char)
        following: dict = {}

        def reach(state, score, path, following=following):
            if state not in following or score > following[state][0]:
                following[state] = (score, path)

        for (script, last), (score, path) in states.items():
            if not kind:  # not a letter: the run of letters ends, the script stays
                end = model.log(script, last, "$") if last != "^^" and script else 0.0
                reach((script, "^^"), score + end, path + char)
                continue
            for option in (char, *_ALIKE.get(char, ())):
                to = script_of(option)
                cost = (REPLACED + (option not in _HEADS)) * (option != char) + SWITCHED * (script not in ("", to)) + SWITCHED * (to == "other")
                context = last if script == to else "^^"
                low = option.lower()[0]  # the trigrams are those of lower-case text
                reach((to, context[1] + low), score + model.log(to, context, low) - cost, path + option)
        states = following
    finals = []
    for (script, last), (score, path) in states.items():
        finals.append((score + (model.log(script, last, "$") if last != "^^" else 0.0), path))
    return max(finals)[1]


def canonical(token: str, model: Trigrams) -> str:
    return unicodedata.normalize("NFC", " ".join(best_path(part, model) for part in visible(token).split(" ")))


def script_trigrams(cells: DataFrame) -> DataFrame:
    """(script, gram, n) over all tokens of ``text`` that are wholly in one script."""
    tokens = cells.select(F.explode(F.split(F.lower("text"), " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    script = F.lit(None).cast("string")
    other = r"\x21-\x40\x5B-\x60\x7B-\x7E"  # printable ASCII that isn't a letter
    for name, letters in (("latin", _LATIN), ("cyrillic", _CYRILLIC), ("greek", _GREEK)):
        only = F.col("token").rlike(f"^[{other}{letters}]*+$") & F.col("token").rlike(f"[{letters}]")
        script = F.when(only, name).otherwise(script)
    runs = tokens.select(script.alias("script"), "n", F.explode(F.regexp_extract_all("token", F.lit(r"\p{L}+"), F.lit(0))).alias("run"))
    padded = F.concat(F.lit("^^"), "run", F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length("run") + 1), lambda i: F.substring(padded, i, F.lit(3)))
    return runs.filter("script is not null").select("script", F.explode(grams).alias("gram"), "n").groupBy("script", "gram").agg(F.sum("n").alias("n"))


def unified(df: DataFrame, keys: list[str], fields: list[str], only_changed: bool = False) -> DataFrame:
    """(keys..., field, text, canonical, changed) of every non-null cell of ``fields``, or with
    ``only_changed`` of those whose form differs.

    ``keys`` identify a row.  The empty text is its own form.  Repeated rows give repeated cells only if
    their keys differ.  Empty tables give no rows.  The trigram table is collected: it is bounded by the
    cubed alphabets of three scripts and in practice has some ten thousand rows at any corpus size.  Cells
    with odd characters are found once and kept; the forms of their tokens come back through a shuffle.
    """
    scratch = Scratch(df.sparkSession, "lookalikes")
    renamed = df.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), *(F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("text")) for i, f in enumerate(fields)))
    ids = [f"k{i}" for i in range(len(keys))]
    cells = renamed.select(*ids, F.explode(pairs).alias("x")).select(*ids, "x.field", "x.text").filter("text is not null")
    model = Trigrams({(r.script, r.gram): r.n for r in script_trigrams(cells).collect()})

    def convert(frames):
        for pdf in frames:
            yield pd.DataFrame({"token": pdf["token"], "form": [canonical(t, model) for t in pdf["token"]]})

    odd = F.col("text").rlike(SUSPECT)
    suspects = F.array_distinct(F.filter(F.split("text", " "), lambda t: t.rlike(SUSPECT)))
    found = scratch.keep(cells.filter(odd).withColumn("suspects", suspects))
    forms = found.select(F.explode("suspects").alias("token")).distinct().mapInPandas(convert, "token string, form string")
    used = found.select(*ids, "field", F.explode("suspects").alias("token")).join(forms, "token").filter("token <> form")
    changes = used.groupBy(*ids, "field").agg(F.map_from_entries(F.collect_list(F.struct("token", "form"))).alias("forms"))
    rewritten = F.array_join(F.transform(F.split("text", " "), lambda t: F.coalesce(F.col("forms")[t], t)), " ")
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in [*ids, "field"]]
    right = changes.select(*(F.col(c).alias(f"c_{c}") for c in [*ids, "field"]), "forms")
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    looked = found.join(right, condition, "inner" if only_changed else "left").select(*ids, "field", "text", F.coalesce(F.when(F.col("forms").isNotNull(), rewritten), "text").alias("canonical"))
    if not only_changed:
        looked = looked.unionByName(cells.filter(~odd).select(*ids, "field", "text", F.col("text").alias("canonical")))
    out = looked.withColumn("changed", F.col("canonical") != F.col("text"))
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "field", "text", "canonical", "changed")
