"""Linking the spellings of people and of organisations.

Strings are folded (compatibility form, look-alikes, accents, transliterated Cyrillic), parsed, and
turned into weighted character n-gram vectors of two blocks: edge grams, the beginnings and ends of
about half the string's length, hold EDGE_SHARE of the squared length, and grams of one and two
letters, weighted by the root of their inverse document frequency, hold the rest.  A sparse join finds the
pairs of distinct strings with a cosine of at least NAME_COSINE.  As this is above 1 - EDGE_SHARE, such
a pair has an edge gram in common, so the join's prefix filter consists of the edge grams alone and
loses no pair.  There is no cap on partners: n is however many are above the threshold.

An exact check follows (edit distance, given names), then average-linkage clustering of what is left.
Equal forms are one node, so copies are never paired before the end.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.linkage import average_linkage
from weft.llm.lookalikes import GROUPS, script_of, visible
from weft.plans.runtime import Scratch

#: One-letter transliteration of Cyrillic, in the order of the alphabet.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i j k l m n o p r s t u f h c ch sh sch  y  e yu ya".split(" ")))
#: Letters without a decomposition.
PLAIN = {"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"}
#: Particles before a family name.
PARTICLES = frozenset("ait al bin ben ibn abu abd el la le les de del della di da do dos das du des van von der den ter ten af av mac mc o st san".split())
#: Words of organisation types -> the type they stand for ('' says nothing).
ORGANISATION_WORDS = {
    w: kind
    for kind, words in {
        "university": "university universite universidad universidade universita universitat univ университет",
        "technical": "technical tecnica tecnico technique technische технический техническии",
        "hospital": "hospital hopital hosp ospedale krankenhaus больница",
        "school": "school sch ecole escuela escola scuola schule школа",
        "engineering": "engineering eng ingenieurs ingenierie ingenieria ingegneria инженерная",
        "institute": "institute inst institut instituto istituto институт",
        "centre": "centre center centro zentrum центр",
        "": "of de d the for du des del da do di la le and et y e und fur general gen generale national natl nacional nazionale recherche rech research",
    }.items()
    for w in words.split()
}

#: The words that say nothing, as typed with errors they still do.
_SMALL = [w for w, k in ORGANISATION_WORDS.items() if not k and len(w) <= 4]
_FOLD = {c: g[0] for g in GROUPS for c in g if script_of(g[0]) == "latin"}
#: Share of the edge grams in a vector's squared length, and the least cosine of two spellings of a name.
EDGE_SHARE, NAME_COSINE = 0.6, 0.42
#: Least mean similarity at which two clusters merge.
PERSON_LINK, ORG_LINK = 0.44, 0.5
#: Similarity of a double name's part to the whole, and of a name to itself behind a particle.
PART, UNGLUED = 0.9, 0.95
#: Least agreement of given names.
AGREEMENT = 0.5
#: A word of organisations in at most this share of another's spellings, or in one only, may be its misspelling.
RARE_SHARE = 1 / 3
#: Families that must show a pair of given names under one id before the pair counts as name and short name.
MINED_SUPPORT = 2


# ---------------------------------------------------------------- strings


_FOLDED: dict[str, str] = {}


def _fold_token(token: str) -> str:
    if token in _FOLDED:
        return _FOLDED[token]
    if len(_FOLDED) > 50_000:
        _FOLDED.clear()
    whole, scripts = token, {script_of(c) for c in token} - {""}
    if scripts == {"cyrillic"}:
        token = "".join(CYRILLIC.get(c, c) for c in token)
    elif scripts != {"latin"}:
        token = "".join(_FOLD.get(c, c) for c in token)
    token = "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))
    _FOLDED[whole] = "".join(PLAIN.get(c, c) for c in token)
    return _FOLDED[whole]


def fold(text: str | None) -> str:
    """Lower-case Latin without accents: look-alikes in mixed tokens become Latin, wholly Cyrillic
    tokens are transliterated."""
    return " ".join(t if t.isascii() else _fold_token(t) for t in visible(text or "").lower().split())


def _core(family: list[str]) -> str:
    """The family name without particles."""
    family = [t for token in family for t in ([token] if token.split("-")[0] not in PARTICLES else token.split("-"))]
    kept = [t for t in family if t not in PARTICLES]
    return " ".join(kept or family)


#: A particle written together with the name, before at least four letters.
_GLUED = "^(?:" + "|".join(sorted(PARTICLES, key=lambda x: (-len(x), x))) + ")(?=.{4})"


def parse_person(raw: str):
    """(family, given) if the order is known, else both readings: family first and family last."""
    text = re.sub(r"\(\d+\)", " ", fold(raw))
    if "," in text:
        family, _, given = text.partition(",")
        return [(_core(re.findall(r"[^\s.,]+", family)), re.findall(r"[^\s.,]+", given))]
    tokens = re.findall(r"[^\s.,]+", text)
    if len(tokens) < 2:
        return [(_core(tokens), [])]
    start = len(tokens) - 1
    while start > 1 and tokens[start - 1] in PARTICLES:
        start -= 1
    end = 1
    while end < len(tokens) - 1 and tokens[end - 1] in PARTICLES:
        end += 1
    return [(_core(tokens[start:]), tokens[:start]), (_core(tokens[:end]), tokens[end:])]


def near(a: str, b: str, most: int = 1) -> bool:
    """Damerau-Levenshtein distance (adjacent swaps count once) of at most ``most``; only the diagonal
    band that such a distance can reach is looked at, so long strings cost their length."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    older, row = {}, {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            d = last.get(j, far) + 1
            if j:
                d = min(d, row.get(j - 1, far) + 1, last.get(j - 1, far) + (x != b[j - 1]))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                    d = min(d, older.get(j - 2, far) + 1)
            row[j] = d
        if min(row.values()) > most:
            return False
        older = last
    return row.get(len(b), far) <= most


def short_name(short: str, full: str) -> bool:
    """Usual ways to shorten a given name: the first letter dropped, or its beginning with -i, -ie, -o."""
    if len(short) >= 3 and full[1:] == short:
        return True
    stem = re.sub(r"(ie|i|o|y)$", "", short)
    return len(stem) >= 2 and stem != short and full.startswith(stem) and len(full) >= len(stem) + 2


def given_agreement(a: list[str], b: list[str], starts_a: str, starts_b: str) -> float:
    """0 (different people) to 1 (same given names).

    The first name of a list is canonical; starts: the initials of it and of its short names."""
    if not a or not b:
        return 0.6
    x, y = a[0], b[0]
    if x == y:
        score = 1.0
    elif len(x) == 1 or len(y) == 1:
        score = 0.9 if set(starts_a) & set(starts_b) else 0.0
    elif min(len(x), len(y)) >= 3 and near(x, y) and (min(len(x), len(y)) >= 4 or x[0] == y[0]):
        score = 0.95
    elif short_name(x, y) or short_name(y, x):
        score = 0.8
    else:
        score = 0.0
    if len(a) > 1 and len(b) > 1 and score:
        m, n = a[1], b[1]
        if m[0] != n[0]:
            return 0.0
        if len(m) > 1 and len(n) > 1 and m != n and not near(m, n) and not short_name(m, n) and not short_name(n, m):
            return 0.5 * score
    return score


def edge_sizes(n: int) -> range:
    """Lengths of the edge grams of a string of n letters: about half of it, and the same for n and n + 1
    if n is odd, so that one error leaves some in common."""
    half = n // 2
    return range(max(half - 1 + n % 2, 1 if n < 5 else 2), min(half + 1, n) + 1)


def edge_grams(text: str) -> list[str]:
    return [g for k in edge_sizes(len(text)) for g in (f"<{text[:k]}", f">{text[-k:]}")]


def grams(text: str) -> list[str]:
    """Character n-grams, n of 1 and 2, the latter with marked ends."""
    marked = f"^{text}$"
    return [*text, *(marked[i : i + 2] for i in range(len(marked) - 1))]


class Vectors:
    """Unit vectors of edge grams (equal weights) and grams (weighted by the root of their inverse document
    frequency), and their cosines."""

    def __init__(self, counts: dict[str, int], total: int):
        self.weights = {g: math.sqrt(1.0 + math.log((1 + total) / (1 + n))) for g, n in counts.items()}
        self.default = math.sqrt(1.0 + math.log(1 + total))
        self.cache: dict[str, dict[str, float]] = {}

    def of(self, text: str) -> dict[str, float]:
        vector = self.cache.get(text)
        if vector is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            inner = {g: (1 + math.log(n)) * self.weights.get(g, self.default) for g, n in Counter(grams(text)).items()}
            scale = math.sqrt((1 - EDGE_SHARE) / sum(w * w for w in inner.values()))
            vector = {g: w * scale for g, w in inner.items()}
            edges = edge_grams(text)
            vector |= dict.fromkeys(edges, math.sqrt(EDGE_SHARE / max(1, len(edges))))
            self.cache[text] = vector
        return vector

    def cosine(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        x, y = self.of(a), self.of(b)
        if len(x) > len(y):
            x, y = y, x
        return sum(w * y[g] for g, w in x.items() if g in y)

    def alike(self, a: str, b: str) -> float:
        """The angular similarity, 1 less the angle's share of a half turn, of strings whose cosine is at least
        NAME_COSINE, if the exact check finds one typing error at most; else 0.  Under four letters strings must
        be equal."""
        if a == b:
            return 1.0
        if min(len(a), len(b)) < 4:
            return 0.0
        cosine = self.cosine(a, b)
        return 1 - math.acos(min(1.0, cosine)) / math.pi if cosine >= NAME_COSINE and near(a, b) else 0.0


def gram_vectors(strings: DataFrame) -> Vectors:
    """From a one-column table of distinct strings.  The counts collected are those of grams of a to z, space,
    hyphen and apostrophe, under 1,000; other grams count as unseen."""
    column = strings.columns[0]
    text = F.concat(F.lit("^"), F.col(column), F.lit("$"))
    n = F.length(column)
    two = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.substring(text, i, F.lit(2)))
    found = strings.filter(n > 0).select(F.explode(F.array_distinct(F.concat(F.split(column, ""), two))).alias("g")).filter(F.col("g").rlike(r"^[a-z '^$-]{1,2}$"))
    return Vectors({r.g: r.n for r in found.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}, strings.count())


# ---------------------------------------------------------------- people


def _parse_raws(frames):
    for pdf in frames:
        readings = [parse_person(x) for x in pdf["raw"]]
        yield pd.DataFrame(
            {
                "raw": pdf["raw"],
                "family": [r[0][0] for r in readings], "given": [r[0][1] for r in readings],
                "family2": [r[1][0] if len(r) > 1 else None for r in readings], "given2": [r[1][1] if len(r) > 1 else None for r in readings],
            }
        )


_PARSED = "raw string, family string, given array<string>, family2 string, given2 array<string>"


def person_names(raws: DataFrame, scratch: Scratch) -> DataFrame:
    """(raw, family, given array) of each name as typed.

    A name without a comma may start or end with the family name; the reading is chosen whose family
    and given name are more often found as such in names with a comma."""
    parsed = scratch.keep(raws.mapInPandas(_parse_raws, _PARSED))
    sure = parsed.filter("family2 is null and size(given) > 0")
    roles = sure.select(F.explode(F.concat(
        F.array(F.struct(F.col("family").alias("t"), F.lit(1).alias("f"), F.lit(0).alias("g"))),
        F.transform(F.filter("given", lambda t: F.length(t) > 1), lambda t: F.struct(t.alias("t"), F.lit(0).alias("f"), F.lit(1).alias("g"))),
    )).alias("x")).select("x.*")
    seen = scratch.keep(roles.groupBy("t").agg(F.sum("f").alias("f"), F.sum("g").alias("g")))

    def leaning(prefix):
        """log odds of being a family name; an initial is a given name."""
        odds = F.log((F.coalesce(F.col(f"{prefix}f"), F.lit(0)) + 0.1) / (F.coalesce(F.col(f"{prefix}g"), F.lit(0)) + 0.1))
        return F.when(F.length(f"{prefix}t") == 1, -20.0).otherwise(odds)

    unsure = parsed.filter("family2 is not null").withColumn("1t", F.col("family")).withColumn("2t", F.col("family2"))
    for p in "12":
        unsure = unsure.join(seen.select(F.col("t").alias(f"{p}t"), F.col("f").alias(f"{p}f"), F.col("g").alias(f"{p}g")), f"{p}t", "left")
    last = leaning("1") >= leaning("2")
    chosen = unsure.select("raw", F.when(last, F.col("family")).otherwise(F.col("family2")).alias("family"), F.when(last, F.col("given")).otherwise(F.col("given2")).alias("given"))
    names = scratch.keep(parsed.filter("family2 is null").select("raw", "family", "given").unionByName(chosen))
    scratch.drop(parsed, seen)
    return names


def mined_aliases(mentions: DataFrame, support: int = MINED_SUPPORT) -> DataFrame:
    """(alias, name): first given names that stand under one id and one family name in at least
    ``support`` families, the less frequent one as the alias; mentions: family, first, id."""
    distinct = mentions.filter("id <> '' and length(first) > 1").select("family", "id", "first").distinct()
    counts = distinct.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    pairs = distinct.join(distinct.withColumnRenamed("first", "other"), ["family", "id"]).filter("first < other and levenshtein(first, other) > 2")
    found = pairs.groupBy("first", "other").agg(F.countDistinct("family").alias("k")).filter(F.col("k") >= support)
    sized = found.join(counts, "first").join(counts.select(F.col("first").alias("other"), F.col("n").alias("m")), "other")
    swap = F.col("n") > F.col("m")
    return sized.select(F.when(swap, F.col("other")).otherwise(F.col("first")).alias("alias"), F.when(swap, F.col("first")).otherwise(F.col("other")).alias("name"))


#: What a posting's part is of the family name: the whole, one of several words, what follows a particle.
_WHOLE, _DOUBLE, _WORD, _REST = 0, 1, 2, 3


def _postings(forms: DataFrame) -> DataFrame:
    """(feature, form, starts, part, kind) of the sparse join; a feature has a gram and a given initial.

    The whole family name and each word of a double one have their edge grams; "=" and the string itself
    also meet under the given name's second letter (its first may be dropped), and what follows a particle
    only meets as a whole."""
    family = F.split("form", "\x1f")[0]
    first = F.coalesce(F.try_element_at(F.split("form", "\x1f"), F.lit(2)), F.lit(""))
    pieces = F.split(family, r"[-\s]")
    rest = F.regexp_replace(family, _GLUED, "")
    entry = lambda part, kind: F.struct(part.alias("part"), F.lit(kind).alias("kind"))
    entries = F.concat(
        F.array(F.when(F.size(pieces) > 1, entry(family, _DOUBLE)).otherwise(entry(family, _WHOLE))),
        F.when(F.size(pieces) > 1, F.transform(F.array_distinct(F.filter(pieces, lambda p: F.length(p) > 2)), lambda p: entry(p, _WORD))).otherwise(F.array().cast("array<struct<part:string,kind:int>>")),
        F.when(rest != family, F.array(entry(rest, _REST))).otherwise(F.array().cast("array<struct<part:string,kind:int>>")),
    )
    # a name without given names has one empty initial, under which such names meet
    initials = F.when(F.col("starts") == "", F.array(F.lit(""))).otherwise(F.split("starts", ""))
    wider = F.array_distinct(F.concat(initials, F.when(F.length(first) > 2, F.array(F.substring(first, 2, 1))).otherwise(F.array().cast("array<string>"))))
    rows = forms.select("form", "starts", initials.alias("initials"), wider.alias("wider"), F.explode(entries).alias("e")).select("form", "starts", "initials", "wider", "e.*")
    n = F.length("part")
    half = F.floor(n / 2).cast("int")
    low = F.greatest(half - 1 + n % 2, F.when(n < 5, 1).otherwise(2))
    sizes = F.when(n > 0, F.sequence(low, F.greatest(low, F.least(half + 1, n))))
    edges = F.flatten(F.transform(sizes, lambda k: F.array(F.concat(F.lit("<"), F.substring("part", F.lit(1), k)), F.concat(F.lit(">"), F.substring("part", n - k + 1, k)))))
    tagged = lambda grams, tags: F.flatten(F.transform(grams, lambda g: F.transform(tags, lambda t: F.concat(g, F.lit("|"), t))))
    features = F.concat(
        tagged(F.array(F.concat(F.lit("="), "part")), F.col("wider")),
        F.when(F.col("kind") != _REST, F.coalesce(tagged(edges, F.col("initials")), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
    )
    return rows.select(F.explode(F.array_distinct(features)).alias("feature"), "form", "starts", "part", "kind")


def _meet(postings: DataFrame) -> DataFrame:
    """Distinct (a, b, sa, sb, pa, pb, factor), a < b, of forms with parts that share a feature.

    Left out already here: what the exact check after the cosine would reject by string length and
    Levenshtein distance (a swap is two edits), which the JVM finds faster than the cosine."""
    sides = [postings.select("feature", F.col("form").alias(x), F.col("starts").alias(f"s{x}"), F.col("part").alias(f"p{x}"), F.col("kind").alias(f"k{x}")) for x in "ab"]
    pa, pb, ka, kb = F.col("pa"), F.col("pb"), F.col("ka"), F.col("kb")
    same = pa == pb
    close = (F.least(F.length(pa), F.length(pb)) >= 4) & (F.abs(F.length(pa) - F.length(pb)) <= 1) & (F.levenshtein(pa, pb) <= 2)
    whole = (ka <= _DOUBLE) & (kb <= _DOUBLE)
    word = ((ka == _WORD) & (kb == _WHOLE)) | ((ka == _WHOLE) & (kb == _WORD))
    rest = same & (((ka == _REST) & (kb <= _DOUBLE)) | ((ka <= _DOUBLE) & (kb == _REST)))
    exact = F.substring("feature", 1, 1) == "="
    kinds = whole | word | rest
    pairs = sides[0].join(sides[1], "feature").filter((F.col("a") < F.col("b")) & kinds & (same == exact) & (same | close))
    factor = F.when(whole, 1.0).when(word, PART).otherwise(UNGLUED)
    return pairs.select("a", "b", "sa", "sb", "pa", "pb", factor.alias("factor")).distinct()


def _person_scorer(vectors: Vectors):
    def run(frames):
        for pdf in frames:
            out = []
            for a, b, sa, sb, pa, pb, factor in pdf.itertuples(index=False):
                agreement = given_agreement(a.split("\x1f")[1:], b.split("\x1f")[1:], sa, sb)
                if agreement >= AGREEMENT:
                    alike = vectors.alike(pa, pb)
                    if alike:
                        out.append((a, b, agreement * factor * alike))
            yield pd.DataFrame(out, columns=["a", "b", "s"])

    return run


def link_people(mentions: DataFrame, key: str, raw: str, person_id: str, aliases: DataFrame, alias: str, given: str, link: float = PERSON_LINK) -> DataFrame:
    """(key, cluster) of every distinct key: mentions of one cluster are held to be one person.

    ``person_id`` may be missing or wrong: it only serves to find short given names beyond ``aliases``.  A
    null key is left out; a null or empty name is a cluster of its own.  Repeated keys count once, by their
    smallest name.  Empty tables give no rows; extra columns are ignored.
    """
    scratch = Scratch(mentions.sparkSession, "people")
    rows = mentions.select(F.col(key).cast("string").alias("key"), F.col(raw).alias("raw"), F.coalesce(F.col(person_id), F.lit("")).alias("id"))
    rows = rows.filter("key is not null").groupBy("key").agg(F.min("raw").alias("raw"), F.max("id").alias("id"))
    names = person_names(rows.filter("raw is not null").select("raw").distinct(), scratch)
    first = F.try_element_at("given", F.lit(1))
    told = aliases.select(F.lower(alias).alias("alias"), F.lower(given).alias("name")).filter("alias <> '' and name <> ''")
    mined = mined_aliases(names.join(rows.select("raw", "id"), "raw").select("family", first.alias("first"), "id"))
    known = scratch.keep(told.unionByName(mined.join(told, "alias", "left_anti").join(told.select(F.col("name").alias("alias")), "alias", "left_anti")).groupBy("alias").agg(F.min("name").alias("name")))
    short = known.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(F.substring("alias", 1, 1))), "").alias("others"))  # at most an alphabet
    joined = names.withColumn("alias", first).join(known, "alias", "left")
    canonical = F.concat(F.array(F.coalesce("name", "alias")), F.slice("given", 2, F.greatest(F.size("given") - 1, F.lit(0))))
    form = F.array_join(F.concat(F.array("family"), F.when(F.size("given") > 0, canonical).otherwise(F.array().cast("array<string>"))), "\x1f")
    formed = scratch.keep(joined.select("raw", "family", form.alias("form"), F.when(F.size("given") > 0, F.coalesce("name", "alias")).alias("first")))
    distinct = formed.select("form", F.col("first").alias("name")).distinct().join(short, "name", "left")
    forms = distinct.select("form", F.concat(F.coalesce(F.substring("name", 1, 1), F.lit("")), F.coalesce("others", F.lit(""))).alias("starts"))
    vectors = gram_vectors(formed.select("family").distinct())
    postings = scratch.keep(_postings(forms))
    scored = _meet(postings).mapInPandas(_person_scorer(vectors), "a string, b string, s double")
    copies = rows.join(formed, "raw").groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    clusters = average_linkage(scored.groupBy("a", "b").agg(F.max("s").alias("s")), copies, link)
    scratch.drop(postings)  # the edges are written, nothing reads it any more
    labelled = rows.join(formed.select("raw", "form"), "raw", "left").join(clusters.withColumnRenamed("node", "form"), "form", "left")
    alone = F.concat(F.lit("\x1e"), "key")
    empty = F.col("form").isNull() | (F.col("form") == "")
    return labelled.select(F.col("key").alias(key), F.when(empty, alone).otherwise(F.coalesce("cluster", "form")).alias("cluster"))


# ---------------------------------------------------------------- organisations


def parse_organisation(text: str | None) -> tuple[str, list[str]]:
    """(types joined by a space, name words) of a spelling; an acronym in parentheses is left out."""
    folded = re.sub(r"\([^)]*\)", " ", " ".join(visible(text or "").lower().split()))
    folded = re.sub(r"\bc\.\s*n\.\s*r\.", " centre ", folded)
    kinds, words = set(), []
    for token in re.findall(r"[^\W\d_]+", folded):
        plain = fold(token)
        kind = next((ORGANISATION_WORDS[t] for t in (token, plain) if t in ORGANISATION_WORDS), None)
        if kind is None and len(plain) >= 3:
            most = 2 if len(plain) > 8 else 1
            kind = next((k for w, k in ORGANISATION_WORDS.items() if len(w) >= 4 and near(plain, w, most)), None)
        if kind is None and (len(plain) > 3 or not any(near(plain, p) for p in _SMALL)):  # mistyped particles are left out
            words.append(plain.replace("w", "v").replace("c", "k").replace("y", "i"))
        elif kind:
            kinds.add(kind)
    return " ".join(sorted(kinds)), sorted(words)


def _parse_organisations(frames):
    for pdf in frames:
        parsed = [parse_organisation(x) for x in pdf["raw"]]
        features = [list({f"{k}|{g}" for w in ws for g in edge_grams(w)}) for k, ws in parsed]
        yield pd.DataFrame({"raw": pdf["raw"], "form": ["\x1f".join([k, *ws]) for k, ws in parsed], "feature": features})


def _misspelt(m: int, n: int) -> bool:
    """Whether the rarer of two words, found in m and n spellings, may be a misspelling of the other."""
    return min(m, n) <= max(1, RARE_SHARE * max(m, n))


def _organisation_scorer(vectors: Vectors, counts: dict[str, int]):
    def run(frames):
        for pdf in frames:
            out = []
            for a, b in zip(pdf["a"], pdf["b"]):
                (ka, *wa), (kb, *wb) = a.split("\x1f"), b.split("\x1f")
                if ka != kb or len(wa) != len(wb):
                    continue
                # every word is a unit vector; words are matched greedily, best first
                pairs = sorted(((vectors.alike(x, y) if x == y or _misspelt(counts[x], counts[y]) else 0.0, i, j) for i, x in enumerate(wa) for j, y in enumerate(wb)), reverse=True)
                left, right, total, least = set(), set(), 0.0, 1.0
                for c, i, j in pairs:
                    if i not in left and j not in right:
                        left.add(i), right.add(j)
                        total, least = total + c, min(least, c)
                if wa and least > 0:
                    out.append((a, b, total / len(wa)))
            yield pd.DataFrame(out, columns=["a", "b", "s"])

    return run


def link_organisations(spellings: DataFrame, key: str, text: str, link: float = ORG_LINK) -> DataFrame:
    """(key, cluster) of every distinct key; spellings of one cluster are held to be one organisation.

    Made for an authority list of spellings, whose number doesn't grow with the records: the counts of
    its distinct words are collected.
    A null key is left out; a null, empty or wordless text is a cluster of its own; repeated keys count
    once, by their smallest text.  Empty tables give no rows; extra columns are ignored.
    """
    scratch = Scratch(spellings.sparkSession, "organisations")
    rows = spellings.select(F.col(key).cast("string").alias("key"), F.col(text).alias("raw")).filter("key is not null").groupBy("key").agg(F.min("raw").alias("raw"))
    parsed = scratch.keep(rows.filter("raw is not null").select("raw").distinct().mapInPandas(_parse_organisations, "raw string, form string, feature array<string>"))
    words = F.filter(F.split("form", "\x1f"), lambda x, i: i > 0)
    often = scratch.keep(parsed.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    vectors = gram_vectors(often.select("word"))
    counts = {r.word: r.n for r in often.collect()}
    features = parsed.select("form", F.explode("feature").alias("feature")).distinct()
    met = features.toDF("a", "feature").join(features.toDF("b", "feature"), "feature").filter("a < b").select("a", "b").distinct()
    scored = met.mapInPandas(_organisation_scorer(vectors, counts), "a string, b string, s double")
    copies = rows.join(parsed, "raw").groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    clusters = average_linkage(scored, copies, link)
    labelled = rows.join(parsed.select("raw", "form"), "raw", "left").join(clusters.withColumnRenamed("node", "form"), "form", "left")
    empty = F.col("form").isNull() | ~F.col("form").contains("\x1f")
    return labelled.select(F.col("key").alias(key), F.when(empty, F.concat(F.lit("\x1e"), "key")).otherwise(F.coalesce("cluster", "form")).alias("cluster"))


def pairs_within(clusters: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of keys in one cluster: the result asked for, so it is as large as
    the sum of squared cluster sizes."""
    left, right = clusters.select("cluster", F.col(key).alias("key_a")), clusters.select("cluster", F.col(key).alias("key_b"))
    return left.join(right, "cluster").filter("key_a < key_b").select("key_a", "key_b")
