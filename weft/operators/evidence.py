"""Evidence cards of pairs: nested structs with everything a verifier may see, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators.mentions import coauthor_names, keep_first

MIN_OVERLAP = 0.30
CARD_LIMIT, TEXT_LIMIT = 30_000, 400
RECORD_ORDER = ["source_file", "row_id_in_file"]


def first_records(records: DataFrame) -> DataFrame:
    """One row per record_id: the first delivered by file and row."""
    needed = ["record_id", "source_file", "row_id_in_file", "EID", "year_int", "Source title", "Title", "affiliations_norm", "authors_with_affiliations_norm", "authors_norm"]
    return keep_first(records.select(*(F.col(f"`{c}`") for c in needed)), "record_id", RECORD_ORDER)


def author_cards(instances: DataFrame, records: DataFrame) -> DataFrame:
    """(author_instance_id, side): one side of an author card; no author id is in it."""
    side = F.struct(
        text.strip_numeric_id(text.safe_text(F.col("author_norm"))).alias("author_norm"), "author_pos",
        F.struct(
            text.safe_text(F.col("r.EID")).alias("eid"), F.col("r.year_int").alias("year"),
            text.safe_text(F.col("r.`Source title`")).alias("source_title"), text.safe_text(F.col("r.Title")).alias("title"),
        ).alias("record"),
        F.coalesce("coauthors", F.array().cast("array<string>")).alias("coauthors_norm"), text.safe_text(F.col("r.affiliations_norm")).alias("affiliations_norm"),
        text.safe_text(F.col("r.authors_with_affiliations_norm")).alias("authors_with_affiliations_norm"),
    )
    i = instances.join(coauthor_names(instances), ["record_id", "author_pos"], "left")
    return i.join(first_records(records).alias("r"), i["record_id"] == F.col("r.record_id"), "left").select("author_instance_id", side.alias("side"))


def linked_authors(affil_norm: Column, authors_with_affiliations: Column) -> Column:
    """Author names of the segments that hold at least 30 % of the affiliation's tokens: each segment's
    parts before the first one with such a token, joined by ', '; [] if none."""
    wanted = text.token_set(affil_norm)

    def prefix(segment):
        parts = F.filter(F.transform(F.split(segment, ","), text.strip), lambda p: p != "")
        hit = F.transform(parts, lambda p: F.arrays_overlap(text.token_set(p), wanted))
        stop = F.array_position(hit, F.lit(True))
        return F.array_join(F.when(stop > 0, F.slice(parts, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(parts), ", ")

    def enough(segment):
        return F.size(F.array_intersect(wanted, text.token_set(segment))) >= F.size(wanted) * F.lit(MIN_OVERLAP)

    names = F.transform(F.filter(text.split_list(authors_with_affiliations), enough), prefix)
    return F.when(F.size(wanted) > 0, F.filter(names, lambda n: n != "")).otherwise(F.array().cast("array<string>"))


def affiliation_cards(instances: DataFrame, records: DataFrame) -> DataFrame:
    """(affil_instance_id, side): no title, source or year; without linked authors all authors stand in
    and the fallback flag is set."""
    r = first_records(records).select("record_id", "authors_with_affiliations_norm", "authors_norm")
    linked = instances.join(r, "record_id", "left").withColumn("linked", linked_authors(F.col("affil_norm"), F.col("authors_with_affiliations_norm")))
    none = F.size("linked") == 0
    side = F.struct(
        "affil_raw", "affil_norm", "affil_acronyms",
        F.when(none, text.split_list(F.col("authors_norm"), ",")).otherwise(F.col("linked")).alias("linked_authors_norm"), none.alias("linked_authors_fallback"),
    )
    return linked.select("affil_instance_id", side.alias("side"))


def pair_cards(pairs: DataFrame, cards: DataFrame, id_: str, task: str) -> DataFrame:
    """(anchor_id, candidate_id, card); pairs with an unknown id are left out (see ``unknown_ids``)."""
    a, c = (cards.select(F.col(id_).alias(k), F.col("side").alias(s)) for k, s in (("anchor_id", "anchor"), ("candidate_id", "candidate")))
    joined = pairs.select("anchor_id", "candidate_id").join(a, "anchor_id").join(c, "candidate_id")
    return joined.select("anchor_id", "candidate_id", F.struct(F.lit(task).alias("task"), "anchor", "candidate").alias("card"))


def unknown_ids(pairs: DataFrame, instances: DataFrame, id_: str) -> DataFrame:
    """Pairs with an id that isn't an instance, with anchor_known and candidate_known."""
    known = instances.select(F.col(id_).alias("k")).distinct()
    a, c = known.select(F.col("k").alias("anchor_id"), F.lit(True).alias("anchor_known")), known.select(F.col("k").alias("candidate_id"), F.lit(True).alias("candidate_known"))
    out = pairs.join(a, "anchor_id", "left").join(c, "candidate_id", "left").fillna(False, ["anchor_known", "candidate_known"])
    return out.filter("not (anchor_known and candidate_known)")


def _cut(c: Column, dtype) -> Column:
    """Every text of a nested value cut to TEXT_LIMIT characters."""
    kind = dtype.typeName()
    if kind == "string":
        return F.when(F.length(c) > TEXT_LIMIT, F.concat(F.substring(c, 1, TEXT_LIMIT), F.lit("..."))).otherwise(c)
    if kind == "array":
        return F.transform(c, lambda x: _cut(x, dtype.elementType))
    if kind == "struct":
        return F.struct(*(_cut(c[f.name], f.dataType).alias(f.name) for f in dtype.fields))
    return c


def limited(cards: DataFrame) -> DataFrame:
    """Cards whose JSON is longer than CARD_LIMIT have their texts cut; adds truncated."""
    long = F.length(F.to_json("card")) > CARD_LIMIT
    return cards.withColumn("truncated", long).withColumn("card", F.when(F.col("truncated"), _cut(F.col("card"), cards.schema["card"].dataType)).otherwise(F.col("card")))


def prompts(cards: DataFrame, template: str) -> DataFrame:
    """Adds prompt and prompt_chars: the template with {{EVIDENCE_CARD}} replaced."""
    out = cards.withColumn("prompt", F.replace(F.lit(template), F.lit("{{EVIDENCE_CARD}}"), F.to_json("card")))
    return out.withColumn("prompt_chars", F.length("prompt"))


def without_fields(cards: DataFrame, fields: list[str]) -> DataFrame:
    """Cards for ablations: the named fields of both sides blanked."""
    out = F.col("card")
    kinds = {f.name: f.dataType for f in cards.schema["card"].dataType["anchor"].dataType.fields}
    for side in ("anchor", "candidate"):
        for field in fields:
            blank = F.lit("") if kinds[field].typeName() == "string" else F.lit(None).cast(kinds[field])
            out = out.withField(f"{side}.{field}", blank)
    return cards.withColumn("card", out)


def author_packets(cards: DataFrame) -> DataFrame:
    """Wide rows for annotators: names joined by ' | ', long lists cut with an ellipsis."""
    columns = []
    for s in ("anchor", "candidate"):
        c = F.col("card")[s]
        columns += [
            c["author_norm"].alias(f"{s}_author_norm"), text.pipe_join(c["coauthors_norm"], 15).alias(f"{s}_coauthors_norm"), c["affiliations_norm"].alias(f"{s}_affiliations_norm"),
            c["record"]["title"].alias(f"{s}_title"), c["record"]["source_title"].alias(f"{s}_source_title"), c["record"]["year"].cast("string").alias(f"{s}_year"),
        ]
    return cards.select("anchor_id", "candidate_id", *columns)


def affiliation_packets(cards: DataFrame) -> DataFrame:
    columns = []
    for s in ("anchor", "candidate"):
        c = F.col("card")[s]
        columns += [
            c["affil_raw"].alias(f"{s}_affil_raw"), c["affil_norm"].alias(f"{s}_affil_norm"), F.array_join(c["affil_acronyms"], " | ").alias(f"{s}_affil_acronyms"),
            text.pipe_join(c["linked_authors_norm"], 15).alias(f"{s}_linked_authors_norm"), c["linked_authors_fallback"].cast("string").alias(f"{s}_linked_authors_fallback"),
        ]
    return cards.select("anchor_id", "candidate_id", *columns)
