"""Scalar text functions as Columns.  All are null-safe as stated; none runs Python per row except
``normalise_text`` and ``normalise_label_text``, which use an Arrow function only where a value isn't ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space and word characters, written out because Java's \s and \w are ASCII only.
SPACE = r"[\s\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_]+"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space (any kind) at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def _normalise(text: str, collapse: bool) -> str:
    folded = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip().casefold())
    return re.sub(r"([^\w\s])\1+", r"\1", folded) if collapse else folded


def _exact(collapse: bool):
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _normalise(v, collapse))

    return run


def _normalised(c: Column, collapse: bool) -> Column:
    text = blank_if_null(c)
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")
    if collapse:
        plain = F.regexp_replace(plain, r"([^\w\s])\1+", "$1")
    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    # the Arrow function sees null for ASCII values, so those cost nothing in Python
    return F.coalesce(F.when(ascii_only, plain), _exact(collapse)(F.when(~ascii_only, text)))


def normalise_text(c: Column) -> Column:
    """Null to '', NFKC, strip, case fold, white space to one space, runs of one punctuation mark to one."""
    return _normalised(c, True)


def normalise_label_text(c: Column) -> Column:
    """Like ``normalise_text`` without the punctuation rule; the texts nan and none become ''."""
    out = _normalised(c, False)
    return F.when(out.isin("nan", "none"), "").otherwise(out)


#: Fixed value: Roman numerals.
ROMAN = r"(?i)^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def acronyms(c: Column) -> Column:
    """array<string>: upper-case tokens of 3 to 10 letters and digits with at least one letter that are
    no Roman numerals, those in brackets first, each once; [] for null."""
    text = blank_if_null(c)
    inside = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"[(\[](.*?)[)\]]"), F.lit(1)), lambda x: F.split(x, r"[\s\p{Z},;./\\|]+")))
    free = F.split(text, r"[\s\p{Z},;.()\[\]{}/\\|]+")
    tokens = F.transform(F.concat(inside, free), lambda t: F.regexp_replace(t, "^[-–—]+|[-–—]+$", ""))
    good = F.filter(tokens, lambda t: t.rlike("^[A-Z0-9]{3,10}$") & t.rlike("[A-Z]") & ~t.rlike(ROMAN))
    return F.array_distinct(good)


def split_list(c: Column, separator: str = ";") -> Column:
    """array<string> of the stripped non-empty elements; [] for null."""
    return F.filter(F.transform(F.split(blank_if_null(c), separator), strip), lambda x: x != "")


def strip_numeric_id(c: Column) -> Column:
    """Without every '(6 to 20 digits)' and outer white space."""
    return strip(F.regexp_replace(c, rf"{SPACE}*\([0-9]{{6,20}}\)", ""))


def strip_any_id(c: Column) -> Column:
    """Without every '(digits)' of any length; inner spaces stay."""
    return strip(F.regexp_replace(c, r"\([0-9]+\)", ""))


def strip_trailing_id(c: Column) -> Column:
    """Without one '(digits)' at the end."""
    return F.regexp_replace(c, rf"{SPACE}*\([0-9]+\){SPACE}*$", "")


def words(c: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(blank_if_null(c), rf"{SPACE}+"), lambda x: x != "")


def name_key(c: Column) -> Column:
    """'last token|first letter of the first token'; '' without tokens."""
    t = words(c)
    return F.when(F.size(t) > 0, F.concat(F.element_at(t, -1), F.lit("|"), F.substring(t[0], 1, 1))).otherwise("")


def first_words(c: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def first_letters(c: Column, n: int = 12) -> Column:
    return F.substring(blank_if_null(c), 1, n)


def tokens(c: Column) -> Column:
    """Runs of letters, digits and _."""
    return F.filter(F.split(blank_if_null(c), NON_WORD), lambda x: x != "")


def token_set(c: Column) -> Column:
    """Distinct lower-case tokens of at least two characters, in first-seen order."""
    return F.array_distinct(F.filter(tokens(F.lower(c)), lambda x: F.length(x) >= 2))


def safe_text(c: Column) -> Column:
    """'' for null and for the texts nan and none."""
    return F.when(c.isNull() | F.lower(strip(c)).isin("nan", "none"), "").otherwise(c)


def compare_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_numeric_id(safe_text(c))), rf"{SPACE}+", " ")


def pipe_set(c: Column) -> Column:
    """Elements between | without ids and without the ellipsis; each once."""
    parts = F.transform(F.split(safe_text(c), r"\|"), strip_numeric_id)
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "…")))


def pipe_acronyms(c: Column) -> Column:
    parts = F.transform(F.split(safe_text(c), r"\|"), lambda x: F.upper(strip(x)))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "…")))


def surname_initial(c: Column) -> Column:
    """struct(surname, initial) of a name of at least two tokens: its last token and the first letter of its
    first; else two empty texts."""
    t = words(compare_name(c))
    many = F.size(t) >= 2
    return F.struct(F.when(many, F.element_at(t, -1)).otherwise("").alias("surname"), F.when(many, F.substring(t[0], 1, 1)).otherwise("").alias("initial"))


def compare_names(c: Column) -> Column:
    """array<string>: the distinct names of a pipe list in the form for comparing, without the ellipsis."""
    parts = F.filter(F.transform(F.split(safe_text(c), r"\|"), strip), lambda x: (x != "") & (x != "…"))
    return F.array_distinct(F.transform(parts, lambda x: strip(compare_name(x))))


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last of a cut text being an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def truncate_dots(c: Column, n: int) -> Column:
    """n characters and '...' where longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def pipe_join(names: Column, n: int) -> Column:
    """The first n names joined by ' | ', then ' | …' if there are more."""
    head = F.array_join(F.slice(names, 1, n), " | ")
    return F.when(F.size(names) > n, F.concat(head, F.lit(" | …"))).otherwise(head)


def truncate_pipe_list(c: Column, n: int) -> Column:
    """The first n elements of a pipe list, then '... (+k more)'."""
    parts = F.split(c, r" \| ")
    more = F.size(parts) - n
    return F.when(more > 0, F.concat(F.array_join(F.slice(parts, 1, n), " | "), F.lit(" ... (+"), more.cast("string"), F.lit(" more)"))).otherwise(c)


def fallback_flag(anchor: Column, candidate: Column) -> Column:
    """'false' or 'true (anchor+candidate)' from two text flags."""
    sides = F.concat_ws("+", F.when(F.lower(anchor) == "true", "anchor"), F.when(F.lower(candidate) == "true", "candidate"))
    return F.when(sides == "", "false").otherwise(F.concat(F.lit("true ("), sides, F.lit(")")))


#: Accepted spellings of labels.
LABEL_ALIASES = {
    "match": ("match", "same", "positive", "yes"),
    "non-match": ("non-match", "nonmatch", "different", "negative", "no"),
    "uncertain": ("uncertain", "unsure", "skip", "abstain"),
}


def label_class(c: Column, digits: bool = True) -> Column:
    """match, non-match, uncertain or ''; with digits, 1 and 0 are labels too."""
    key = F.lower(strip(blank_if_null(c)))
    out = F.lit("")
    for label, names in LABEL_ALIASES.items():
        extra = {"match": ("1",), "non-match": ("0",)}.get(label, ()) if digits else ()
        out = F.when(key.isin(*names, *extra), label).otherwise(out)
    return out


def split_class(c: Column) -> Column:
    key = F.lower(strip(blank_if_null(c)))
    return F.when(key.isin("dev", "test"), key).otherwise("")


def label_code(c: Column) -> Column:
    """'0', '1' or '2' of texts such as '1.0'; null for anything else."""
    value = F.expr("try_cast(0 AS DOUBLE)") if c is None else strip(blank_if_null(c)).try_cast("double")
    return F.when(value.isin(0.0, 1.0, 2.0), value.cast("int").cast("string"))


def redact_key(c: Column) -> Column:
    return F.regexp_replace(c, r"sk-ant-[A-Za-z0-9\-_]{10,}", "[REDACTED]")


def safe_int(c: Column) -> Column:
    """int of a text such as '2020' or '2020.0'; null for anything else and for fractions."""
    value = strip(c).try_cast("double")
    return F.when((value == F.floor(value)) & (F.abs(value) < 2147483648.0), value.cast("int"))


def sha(c: Column) -> Column:
    return F.sha2(blank_if_null(c), 256)


def pretty(c: Column) -> Column:
    """'precision_floor' to 'Precision Floor'."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def tex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
