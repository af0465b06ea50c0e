"""Affiliation packets cover whole blocks."""

from pyspark.sql import functions as F

from weft.plans import extra_queries


def test_packets_of_whole_blocks(spark, tmp_path):
    cells = {
        "query_frame": "q", "Affiliations": "Lab Xyzzy Unit Of, City", "affiliations_norm": "lab xyzzy unit of, city", "authors_norm": "doe0, john", "authors_with_affiliations_norm": "",
        "source_file": "f", "Title": "t", "Source title": "s",
    }
    ids = spark.range(8).coalesce(1).select(F.format_string("r%02d", "id").alias("record_id"), F.format_string("e%02d", "id").alias("EID"), F.col("id").cast("int").alias("row_id_in_file"), F.lit(2020).alias("year_int"))
    ids.select("*", *(F.lit(v).alias(k) for k, v in cells.items())).write.parquet(f"{tmp_path}/records_normalised.parquet")
    got = extra_queries.affiliation_packets(spark, str(tmp_path)).collect()
    assert len({(r.anchor_id, r.candidate_id) for r in got}) == len(got) == 8 * 7 and {r.label for r in got} == {"match"}
