"""Candidate pairs by several blocking passes, best pass per pair, and the best k per anchor.

Every pass is an equi-join on a key column, so Catalyst picks the join and adaptive execution splits
skewed keys; the passes are unioned and each pair keeps its best pass in one aggregation, which combines
before the shuffle (``author_pairs``, whose result is all pairs, tells it from the keys); the per-anchor limit is a window that Spark cuts early (WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import similarity as sim
from weft.functions import text
from weft.plans.runtime import Scratch, default_parallelism

#: Ids are long texts; pairs are made of 8-byte numbers in the order of the ids and named at the end.
YEAR_WINDOW = 5
TOP_K = 50
BLOCK_CAP = 50
#: Rows of a block that one task takes on either side, where pairs aren't shuffled; tasks per shuffle partition.
CELL, CELL_PARTS = 4096, 4


def pass_pairs(anchors: DataFrame, candidates: DataFrame, key: str, id_: str, pass_id: str, priority: int, prefix: str, keep: Column | None = None) -> DataFrame:
    """(anchor_id, candidate_id, pass_id, priority, key_pos, block_key) of an equi-join on ``key`` (null and
    '' never join); keep: a residual on a.* and c.* columns; pairs of an id with itself are left out."""
    a, c = anchors.filter(F.col(key) != "").alias("a"), candidates.filter(F.col(key) != "").alias("c")
    on = F.col(f"a.{key}") == F.col(f"c.{key}")
    joined = a.join(c, on & keep if keep is not None else on).filter(F.col(f"a.{id_}") != F.col(f"c.{id_}"))
    position = F.col("a.key_pos") if "key_pos" in anchors.columns else F.lit(0)
    return joined.select(
        F.col(f"a.{id_}").alias("anchor_id"), F.col(f"c.{id_}").alias("candidate_id"), F.lit(pass_id).alias("pass_id"), F.lit(priority).alias("priority"),
        position.alias("key_pos"), F.concat(F.lit(prefix), F.col(f"a.{key}")).alias("block_key"),
    )


def best_pass(pairs: DataFrame) -> DataFrame:
    """One row per pair: lowest priority, then first key of that pass."""
    best = F.min(F.struct("priority", "key_pos", "block_key", "pass_id")).alias("b")
    return pairs.groupBy("anchor_id", "candidate_id").agg(best).select(
        "anchor_id", "candidate_id", F.col("b.pass_id").alias("best_pass_id"), F.col("b.block_key").alias("best_block_key"), F.col("b.priority").alias("pass_priority")
    )


def within_years(window: int = YEAR_WINDOW) -> Column:
    """Both years present: at most ``window`` apart; otherwise true."""
    a, c = F.col("a.year_int"), F.col("c.year_int")
    return a.isNull() | c.isNull() | (F.abs(a - c) <= window)


def numbered(ids: DataFrame) -> DataFrame:
    """(id, n): distinct ids with numbers in their order, as a written table (numbers must stay)."""
    distinct = ids.toDF("id").filter("id is not null").distinct().orderBy("id")
    return Scratch(ids.sparkSession, "numbers").keep(distinct.withColumn("n", F.monotonically_increasing_id()))


def with_numbers(df: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """The id column replaced by its number."""
    return df.join(numbers.toDF(column, "_n"), column).drop(column).withColumnRenamed("_n", column)


def with_names(df: DataFrame, columns: list[str], numbers: DataFrame) -> DataFrame:
    """The number columns replaced by their ids; column order stays."""
    out = df
    for c in columns:
        out = out.join(numbers.toDF("_id", c), c).drop(c).withColumnRenamed("_id", c)
    return out.select(*df.columns)


def author_pairs(instances: DataFrame, year_window: int = YEAR_WINDOW) -> DataFrame:
    """Pairs of eligible (not truncated) author instances by id, by name key within years, and by name
    key and affiliation prefix.

    Pairs are never shuffled: whether a pair belongs to an earlier pass or block is told from the keys of its
    two sides, so each pair is made once, where it belongs.  An id with several keys has all of them with it."""
    keys = F.struct("author_id", "name_key", "year_int", "name_affil")
    one = _eligible(instances).filter("id is not null").groupBy("id").agg(F.collect_set(keys).alias("own"))
    texts = lambda key: F.array_distinct(F.filter(F.transform("own", lambda x: x[key]), lambda x: x != ""))
    one = one.select("id", "own", (F.size("own") == 1).alias("single"), texts("author_id").alias("ids"), texts("name_key").alias("names"), texts("name_affil").alias("affils"))

    out = None
    for priority, pass_id, prefix, key in ((1, "pass1_author_id", "author_id:", "ids"), (2, "pass2_name_key", "name_key:", "names"), (3, "pass3_name_key_affil", "name_key_affil:", "affils")):
        rows = one.select("id", "own", "single", "ids", "affils", F.explode(key).alias("key"))
        large = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")).filter("cells > 1")
        rows = rows.join(F.broadcast(large), "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))  # at most one key for CELL rows
        plain = rows.filter("single").select("id", "key", "cells", F.col("own")[0].alias("o")).select("id", "key", "cells", F.nullif("o.author_id", F.lit("")).alias("author_id"), F.nullif("o.name_key", F.lit("")).alias("name_key"), F.col("o.year_int").alias("year_int"))
        for a, c, belongs in (
            (plain, plain, _plain_belongs(priority, year_window)),
            (rows.filter("not single"), rows, _belongs(priority, year_window)),
            (rows.filter("single"), rows.filter("not single"), _belongs(priority, year_window)),
        ):
            found = _cell_pairs(a, c, belongs, prefix).withColumns({"best_pass_id": F.lit(pass_id), "pass_priority": F.lit(priority)})
            out = found if out is None else out.unionByName(found)
    return out.select("anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority")


def _cell_pairs(anchors: DataFrame, candidates: DataFrame, belongs: Column, prefix: str) -> DataFrame:
    """(anchor_id, candidate_id, best_block_key) of rows (id, key, cells, ...) with a common key for which
    ``belongs`` holds.  A block is cut into cells x cells parts on both sides, so its pairs are made in many tasks."""
    parts = CELL_PARTS * default_parallelism(anchors.sparkSession)
    own, all_ = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    a = anchors.withColumn("block", F.concat(F.lit(prefix), "key")).withColumn("i", own).withColumn("j", all_)
    c = candidates.withColumn("j", own).withColumn("i", all_)
    a, c = (x.drop("cells").repartition(parts, "key", "i", "j").alias(n) for x, n in ((a, "a"), (c, "c")))
    same = (F.col("a.key") == F.col("c.key")) & (F.col("a.i") == F.col("c.i")) & (F.col("a.j") == F.col("c.j"))
    pairs = a.hint("merge").join(c, same & (F.col("a.id") != F.col("c.id")) & belongs)
    return pairs.select(F.col("a.id").alias("anchor_id"), F.col("c.id").alias("candidate_id"), F.col("a.block").alias("best_block_key"))


def _plain_belongs(priority: int, window: int) -> Column:
    """Whether a pair of ids with one set of keys each is of this pass and no earlier one; '' is null in them."""
    no_id = F.coalesce(F.col("a.author_id") != F.col("c.author_id"), F.lit(True))
    no_name = F.coalesce(F.col("a.name_key") != F.col("c.name_key"), F.lit(True))
    return {1: F.lit(True), 2: no_id & within_years(window), 3: no_id & (no_name | ~within_years(window))}[priority]


def _belongs(priority: int, window: int) -> Column:
    """The same for ids with any number of keys; of several blocks of the pass the pair is of the first."""
    first = lambda x: F.col("a.key") == F.array_min(F.array_intersect(f"a.{x}", f"c.{x}"))
    if priority == 1:
        return first("ids")

    def meets(x):
        near = lambda y: x["year_int"].isNull() | y["year_int"].isNull() | (F.abs(x["year_int"] - y["year_int"]) <= window)
        return (x["name_key"] != "") & F.exists("c.own", lambda y: F.coalesce((y["name_key"] == x["name_key"]) & near(y), F.lit(False)))

    no_id, names = ~F.arrays_overlap("a.ids", "c.ids"), F.transform(F.filter("a.own", meets), lambda x: x["name_key"])
    return no_id & (F.col("a.key") == F.array_min(names)) if priority == 2 else no_id & (F.size(names) == 0) & first("affils")


def _eligible(instances: DataFrame) -> DataFrame:
    """(id, author_id, name_key, year_int, name_affil) of instances that aren't truncated, each once."""
    return instances.filter(~F.col("truncation_flag")).select(
        F.col("author_instance_id").alias("id"), "author_id", "name_key", "year_int",
        F.when((F.col("name_key") != "") & (F.col("record_affil_prefix") != ""), F.concat_ws("|", "name_key", "record_affil_prefix")).alias("name_affil"),
    ).distinct()


def author_number_pairs(instances: DataFrame, year_window: int = YEAR_WINDOW) -> DataFrame:
    """``author_pairs`` of instances whose ids are numbers already."""
    e = _eligible(instances)
    passes = [
        pass_pairs(e, e, "author_id", "id", "pass1_author_id", 1, "author_id:"),
        pass_pairs(e, e, "name_key", "id", "pass2_name_key", 2, "name_key:", within_years(year_window)),
        pass_pairs(e, e, "name_affil", "id", "pass3_name_key_affil", 3, "name_key_affil:"),
    ]
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return best_pass(out)


def author_context_pairs(instances: DataFrame, unique: DataFrame, k: int = TOP_K, year_window: int = YEAR_WINDOW) -> DataFrame:
    """Those of ``author_number_pairs`` that can be among the k best of their anchor by the context score,
    without all pairs of a name block: their number grows with the instances, not with the squares of blocks.

    The score of a pair without a common co-author and affiliation prefix is 0, and equal scores go by id.
    So an anchor needs the pairs of the first and third pass, the pairs of its name block that have a
    co-author or the prefix in common, and of its block's ids within the years the k + 1 smallest."""
    e = _eligible(instances)
    named = e.filter(F.col("name_key") != "").select("id", "name_key", "year_int").distinct()
    context = F.concat(
        F.transform(F.coalesce("coauthor_keys", F.array().cast("array<string>")), lambda x: F.concat(F.lit("c|"), x)),
        F.when(F.col("record_affil_prefix") != "", F.array(F.concat(F.lit("p|"), "record_affil_prefix"))).otherwise(F.array().cast("array<string>")),
    )
    posted = named.join(unique.select(F.col("author_instance_id").alias("id"), F.explode(F.array_distinct(context)).alias("shared")), "id")
    posted = posted.withColumn("key", F.xxhash64("name_key", "shared").cast("string"))
    a, c = posted.alias("a"), posted.alias("c")
    meets = (F.col("a.key") == F.col("c.key")) & (F.col("a.name_key") == F.col("c.name_key")) & (F.col("a.id") != F.col("c.id")) & within_years(year_window)
    found = a.join(c, meets).select(F.col("a.id").alias("anchor_id"), F.col("c.id").alias("candidate_id"), F.col("a.name_key").alias("name_key")).distinct()

    place = F.row_number().over(W.partitionBy("name_key", "year_int").orderBy("id"))
    first = named.withColumn("_n", place).filter(F.col("_n") <= k + 1).drop("_n")
    groups = named.select("name_key", "year_int").distinct()
    near = groups.alias("a").join(first.alias("c"), (F.col("a.name_key") == F.col("c.name_key")) & within_years(year_window))
    near = near.select(F.col("a.name_key").alias("name_key"), F.col("a.year_int").alias("year_int"), F.col("c.id").alias("candidate_id")).distinct()
    nearest = near.withColumn("_n", F.row_number().over(W.partitionBy("name_key", "year_int").orderBy("candidate_id"))).filter(F.col("_n") <= k + 1).drop("_n")
    lists = nearest.groupBy("name_key", "year_int").agg(F.collect_list("candidate_id").alias("ids"))  # k + 1 numbers at most
    same = (F.col("a.name_key") == F.col("c.name_key")) & F.col("a.year_int").eqNullSafe(F.col("c.year_int"))
    fill = named.alias("a").join(lists.alias("c"), same).select(F.col("a.id").alias("anchor_id"), F.explode("c.ids").alias("candidate_id"), F.col("a.name_key").alias("name_key")).filter("anchor_id <> candidate_id")
    second = found.unionByName(fill).select(
        "anchor_id", "candidate_id", F.lit("pass2_name_key").alias("pass_id"), F.lit(2).alias("priority"), F.lit(0).alias("key_pos"), F.concat(F.lit("name_key:"), "name_key").alias("block_key")
    )
    passes = [pass_pairs(e, e, "author_id", "id", "pass1_author_id", 1, "author_id:"), second, pass_pairs(e, e, "name_affil", "id", "pass3_name_key_affil", 3, "name_key_affil:")]
    return best_pass(passes[0].unionByName(passes[1]).unionByName(passes[2]))


def name_ratios(instances: DataFrame, unique: DataFrame, names: DataFrame) -> DataFrame:
    """(a_name, c_name, name_ratio), a_name < c_name, of the numbers of distinct names that meet in a block of
    any pass; unique: author_instance_id, name; names: (id, n)."""
    named = _eligible(instances).join(unique.select(F.col("author_instance_id").alias("id"), "name"), "id")
    keys = named.select("name", F.explode(F.array(F.concat(F.lit("i|"), F.nullif("author_id", F.lit(""))), F.concat(F.lit("n|"), F.nullif("name_key", F.lit(""))))).alias("key")).filter("key is not null").distinct()
    a, c = keys.toDF("a_name", "key"), keys.toDF("c_name", "key")
    half = a.join(c, "key").filter("a_name < c_name").select("a_name", "c_name").distinct()
    texts = half.join(names.toDF("_a", "a_name"), "a_name").join(names.toDF("_c", "c_name"), "c_name")
    return texts.select("a_name", "c_name", sim.ratio(F.col("_a"), F.col("_c")).alias("name_ratio"))


def capped(df: DataFrame, key: str, order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def affiliation_pairs(instances: DataFrame, cap: int = BLOCK_CAP, order: tuple = ("record_id", "affil_pos", "id")) -> DataFrame:
    """Pairs of affiliation instances by shared acronym, three-word prefix and twelve-letter prefix.

    Each block's candidate side holds its first ``cap`` instances in ``order``; every instance is an
    anchor, so the relation isn't symmetric.  Within the acronym pass the anchor's first acronym wins.
    """
    e = instances.select(F.col("affil_instance_id").alias("id"), "record_id", "affil_pos", "affil_acronyms", "token_prefix_key", "prefix_key")
    acronyms = e.select("id", "record_id", "affil_pos", F.posexplode("affil_acronyms").alias("key_pos", "acronym"))
    passes = [
        pass_pairs(acronyms, capped(acronyms, "acronym", order, cap), "acronym", "id", "ain_acro", 1, "acro:"),
        pass_pairs(e, capped(e, "token_prefix_key", order, cap), "token_prefix_key", "id", "ain_tok3", 2, "tok3:"),
        pass_pairs(e, capped(e, "prefix_key", order, cap), "prefix_key", "id", "ain_pre12", 3, "pre12:"),
    ]
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return best_pass(out)


def with_sides(pairs: DataFrame, instances: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """Pairs with the instance columns of both sides as a_* and c_*."""
    sides = pairs
    for prefix, key in (("a_", "anchor_id"), ("c_", "candidate_id")):
        sides = sides.join(instances.select(F.col(id_).alias(key), *(F.col(x).alias(f"{prefix}{x}") for x in columns)), key)
    return sides


def top_k(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """Adds rank and keeps rank <= k: pass_priority ascending, score descending, candidate_id ascending."""
    order = W.partitionBy("anchor_id").orderBy("pass_priority", F.col("score").desc(), "candidate_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def author_candidates(
    instances: DataFrame, unique: DataFrame, columns: list[str], score, k: int = TOP_K, year_window: int = YEAR_WINDOW, name: str = "author_norm"
) -> DataFrame:
    """The k best candidates of each anchor with rank and score; unique: one row per instance with its ``name``
    and ``columns``, which ``score`` finds as a_* and c_*, and the name ratio as name_ratio.  Ids are named
    only for what is kept; a pair of names is compared once, however many instances have them."""
    scratch = Scratch(instances.sparkSession, "names")
    numbers = numbered(instances.select("author_instance_id"))
    named = unique.withColumn("name", F.coalesce(name, F.lit("")))
    names = numbered(named.select("name"))
    own = scratch.keep(with_numbers(with_numbers(named.select("author_instance_id", "name", *columns), "author_instance_id", numbers), "name", names))
    known = with_numbers(instances, "author_instance_id", numbers)
    ratios = scratch.keep(name_ratios(known, own, names))
    sides = with_sides(author_number_pairs(known, year_window), own, "author_instance_id", ["name", *columns])
    both = sides.withColumns({"_x": F.least("a_name", "c_name"), "_y": F.greatest("a_name", "c_name")}).join(ratios.toDF("_x", "_y", "name_ratio"), ["_x", "_y"], "left").drop("_x", "_y")
    scored = both.withColumn("name_ratio", F.coalesce("name_ratio", F.lit(1.0))).withColumn("score", score)  # only equal names aren't in the table
    return with_names(top_k(scored, k), ["anchor_id", "candidate_id"], numbers)


def author_context_candidates(instances: DataFrame, unique: DataFrame, k: int = TOP_K, year_window: int = YEAR_WINDOW) -> DataFrame:
    """The k best candidates of each anchor by the context score alone (co-authors and affiliation prefix)."""
    columns = ["coauthor_keys", "record_affil_prefix"]
    numbers = numbered(instances.select("author_instance_id"))
    own = with_numbers(unique.select("author_instance_id", *columns), "author_instance_id", numbers)
    pairs = author_context_pairs(with_numbers(instances, "author_instance_id", numbers), own, k, year_window)
    scored = with_sides(pairs, own, "author_instance_id", columns).withColumn("score", sim.and_context_score("a_", "c_"))
    return with_names(top_k(scored, k), ["anchor_id", "candidate_id"], numbers)


def affiliation_candidates(mentions: DataFrame, score, k: int = TOP_K, cap: int = BLOCK_CAP) -> DataFrame:
    """The k best candidates of each affiliation mention: pairs of ``affiliation_pairs``, scored by ``score`` over
    a_* and c_* columns, with similarity_score, rank and both query frames; year_diff is always null."""
    unique = mentions.groupBy("affil_instance_id").agg(F.min_by(F.struct("affil_norm", "affil_acronyms", "query_frame"), F.struct("query_frame", "year_int", "record_id")).alias("m")).select("affil_instance_id", "m.*")
    numbers = numbered(mentions.select("affil_instance_id"))
    named = with_numbers(mentions, "affil_instance_id", numbers)
    sides = with_sides(affiliation_pairs(named, cap), with_numbers(unique, "affil_instance_id", numbers), "affil_instance_id", ["affil_norm", "affil_acronyms", "query_frame"])
    ranked = with_names(top_k(sides.withColumn("score", score), k), ["anchor_id", "candidate_id"], numbers)
    return ranked.select(
        F.lit("AIN").alias("task"), "anchor_id", "candidate_id", "best_pass_id", "best_block_key", "pass_priority", F.col("score").alias("similarity_score"), "rank", F.lit(None).cast("int").alias("year_diff"),
        text.blank_if_null(F.col("a_query_frame")).alias("query_frame_anchor"), text.blank_if_null(F.col("c_query_frame")).alias("query_frame_candidate"),
    )


def block_sizes(keys: DataFrame, n: int = 20) -> DataFrame:
    """(pass_id, block_key, size) of the n largest blocks per pass; keys: (pass_id, block_key)."""
    sizes = keys.filter(F.col("block_key").isNotNull()).groupBy("pass_id", "block_key").agg(F.count(F.lit(1)).alias("size"))
    order = W.partitionBy("pass_id").orderBy(F.col("size").desc(), "block_key")
    return sizes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
