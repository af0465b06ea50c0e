"""Turning list-valued record cells into mention tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text

COAUTHOR_LIMIT = 30
TRUNCATION_AUTHORS = 100


def _by_position(names: Column, raws: Column, ids: Column) -> Column:
    """array of struct(norm, raw, id) zipped by position; a missing raw falls back to norm, an id to ''."""
    return F.transform(
        names,
        lambda n, i: F.struct(
            n.alias("norm"), F.coalesce(F.get(raws, i), n).alias("raw"), F.coalesce(F.get(ids, i), F.lit("")).alias("id"),
        ),
    )


def author_mentions(records: DataFrame, coauthor_limit: int | None = None) -> DataFrame:
    """One row per name of a record, full names preferred; a missing EID counts as ''.

    coauthor_keys: the sorted distinct name keys of the record's other positions (own key included if
    another position has it), without ''.
    """
    full, short = text.split_list(F.col("author_full_names_norm")), text.split_list(F.col("authors_norm"))
    has_full = F.size(full) > 0
    raws = F.when(has_full, text.split_list(F.col("Author full names"))).otherwise(text.split_list(F.col("Authors")))
    names = F.when(has_full, full).otherwise(short)
    base = records.select(
        F.col("record_id"), text.blank_if_null(F.col("EID")).alias("EID"), "query_frame", "year_int",
        names.alias("names"), raws.alias("raws"), F.col("author_ids_list").alias("ids"),
        text.first_words(F.col("affiliations_norm"), 3).alias("record_affil_prefix"),
    )
    keyed = base.withColumn("keys", F.transform("names", text.name_key)).withColumn("truncation_flag", F.size("names") >= TRUNCATION_AUTHORS)
    rows = keyed.select("*", F.posexplode(_by_position(F.col("names"), F.col("raws"), F.col("ids"))).alias("author_pos", "m"))
    others = F.array_sort(F.array_distinct(F.filter("keys", lambda k, i: (i != F.col("author_pos")) & (k != ""))))
    if coauthor_limit:
        others = F.slice(others, 1, coauthor_limit)
    return rows.select(
        F.sha2(F.concat_ws("|", "EID", F.col("author_pos").cast("string"), "m.raw"), 256).alias("author_instance_id"),
        "record_id", "EID", "query_frame", "year_int", "author_pos", F.col("m.raw").alias("author_raw"),
        F.col("m.norm").alias("author_norm"), F.col("m.id").alias("author_id"), F.col("keys")[F.col("author_pos")].alias("name_key"),
        others.alias("coauthor_keys"), "record_affil_prefix", "truncation_flag",
    )


def affiliation_mentions(records: DataFrame) -> DataFrame:
    """One row per affiliation of a record, with its acronyms and blocking keys.

    The normalised form is that of the raw element, so differently typed cells share blocks.
    """
    raws = text.split_list(F.col("Affiliations"))
    base = records.select("record_id", text.blank_if_null(F.col("EID")).alias("EID"), "query_frame", "year_int", raws.alias("raws"))
    rows = base.select("*", F.posexplode("raws").alias("affil_pos", "affil_raw")).withColumn("_norm", text.normalise_text(F.col("affil_raw")))
    norm = F.col("_norm")
    return rows.select(
        F.sha2(F.concat_ws("|", "EID", F.col("affil_pos").cast("string"), "affil_raw"), 256).alias("affil_instance_id"),
        "record_id", "EID", "query_frame", "year_int", "affil_pos", "affil_raw", norm.alias("affil_norm"),
        text.acronyms(F.col("affil_raw")).alias("affil_acronyms"), text.first_words(norm, 3).alias("token_prefix_key"), text.first_letters(norm, 12).alias("prefix_key"),
    )


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key: the first by ``order`` (nulls first), a total order where rows differ."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(F.col(key).alias("k")).agg(best).select("r.*")


INSTANCE_ORDER = ["query_frame", "year_int", "author_norm", "author_id", "name_key", "record_affil_prefix", "record_id", "author_pos"]


def unique_instances(instances: DataFrame) -> DataFrame:
    """Instances delivered several times count once, by the first row of INSTANCE_ORDER."""
    return keep_first(instances, "author_instance_id", INSTANCE_ORDER)


def coauthor_names(instances: DataFrame) -> DataFrame:
    """(record_id, author_pos, coauthors): names of the other positions of the record, in order.

    Collected per record and looked up, so a record's names are gathered once, not once per author."""
    names = instances.select("record_id", "author_pos", text.strip_numeric_id(text.safe_text(F.col("author_norm"))).alias("name"))
    per_record = names.groupBy("record_id").agg(F.sort_array(F.collect_set(F.struct("author_pos", "name"))).alias("all"))
    joined = names.select("record_id", "author_pos").distinct().join(per_record, "record_id")
    others = F.transform(F.filter("all", lambda x: x["author_pos"] != F.col("author_pos")), lambda x: x["name"])
    return joined.select("record_id", "author_pos", others.alias("coauthors"))
