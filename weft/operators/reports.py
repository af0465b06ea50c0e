"""Counts and summaries of tables, runs and systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.text import strip


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_missing, n_rows): null, or blank where a text; all columns in one pass."""
    names = columns or df.columns
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    counts = [F.count_if(F.col(f"`{c}`").isNull() | (strip(F.col(f"`{c}`")) == "" if c in texts else F.lit(False))).alias(f"c{i}") for i, c in enumerate(names)]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_missing")) for i, c in enumerate(names)))
    return one.select(F.explode(cells).alias("x"), "n_rows").select("x.column", "x.n_missing", "n_rows")


def filled_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_filled): neither null nor empty (text or array)."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def filled(c):
        col = F.col(f"`{c}`")
        return col.isNotNull() & (col != "" if kinds[c] == "string" else F.size(col) > 0 if kinds[c] == "array" else F.lit(True))

    one = df.agg(*(F.count_if(filled(c)).alias(f"c{i}") for i, c in enumerate(columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_filled")) for i, c in enumerate(columns)))).alias("x")).select("x.*")


def changed_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(column, n_changed): raw present and different from its normalised form."""
    one = df.agg(*(F.count_if(F.col(f"`{r}`").isNotNull() & ~F.col(f"`{r}`").eqNullSafe(F.col(f"`{n}`"))).alias(f"c{i}") for i, (r, n) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(r).alias("column"), F.col(f"c{i}").alias("n_changed")) for i, (r, _) in enumerate(pairs)))).alias("x")).select("x.*")


def instance_stats(instances: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return instances.agg(
        n.alias("total"), F.count_if("truncation_flag").alias("truncated"), F.count_if(~F.col("truncation_flag")).alias("eligible"),
        F.round(F.try_divide(100.0 * F.count_if(F.coalesce("author_id", F.lit("")) == ""), n), 6).alias("missing_id_pct"),
        F.round(F.try_divide(100.0 * F.count_if(F.col("year_int").isNull()), n), 6).alias("missing_year_pct"),
    )


def element_frequency(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """(element, count) of the n most frequent elements of an array column; ties by element."""
    return df.select(F.explode(column).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "element").limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct): with two digits of percent of all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / total, 2))


def cost_report(decisions: DataFrame, price_in: float = 3.0, price_out: float = 15.0) -> DataFrame:
    """Tokens, rows with a retry, errors, cost and time span per model and in total (model 'TOTAL').

    Stub rows (backend requests_only) are counted as n_stubs and take no part in the rest; averages are
    over the rows with token counts; an error is a label 'error' or a reason code api_error..."""
    real = ~F.coalesce(F.col("backend") == "requests_only", F.lit(False))
    sums = {c: F.coalesce(F.sum(F.when(real, F.col(c))), F.lit(0)) for c in ("input_tokens", "output_tokens")}
    used = F.count(F.when(real, F.col("input_tokens")))
    cost = sums["input_tokens"] / 1e6 * price_in + sums["output_tokens"] / 1e6 * price_out
    failed = (F.col("label") == "error") | F.col("reason_code").startswith("api_error")
    named = decisions.withColumn("model", F.coalesce("model_id", F.lit("")))
    rolled = named.rollup("model").agg(
        F.grouping("model").alias("_all"), F.count(F.lit(1)).alias("n_decisions"), F.count_if(~real).alias("n_stubs"), used.alias("n_with_usage"),
        F.count_if(real & (F.col("retry_count") > 0)).alias("n_retries"), F.count_if(real & failed).alias("n_api_errors"),
        sums["input_tokens"].alias("input_tokens"), sums["output_tokens"].alias("output_tokens"),
        F.round(F.try_divide(sums["input_tokens"], used), 6).alias("avg_input_tokens"), F.round(F.try_divide(sums["output_tokens"], used), 6).alias("avg_output_tokens"),
        F.round(cost, 6).alias("cost_usd"), F.round(F.try_divide(cost * 1000, used), 6).alias("cost_per_1k"),
        F.min(F.when(real, F.col("timestamp"))).alias("first_seen"), F.max(F.when(real, F.col("timestamp"))).alias("last_seen"),
    )
    seconds = F.unix_timestamp(F.col("last_seen").try_cast("timestamp")) - F.unix_timestamp(F.col("first_seen").try_cast("timestamp"))
    return rolled.withColumn("duration_s", seconds).withColumn("model", F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("model"))).drop("_all")


#: Stages of a run; only the time span of the verification is in its log.
VERIFY_STAGE = "C5 (LLM verify -- API call span)"
UNTIMED_STAGES = ("C4 (blocking/candidate generation)", "C6 (guard application)", "C7 (clustering/union-find)")


def runtime_summary(costs: DataFrame, task: str) -> DataFrame:
    """(task, stage, duration_sec, duration_min, n_pairs, sec_per_1k_pairs, data_available) from the TOTAL row of
    ``cost_report``; one row of nulls for each stage whose time isn't in the log."""
    d, n = F.col("duration_s").cast("double"), F.col("n_with_usage")
    verify = costs.filter("model = 'TOTAL'").select(
        F.lit(task).alias("task"), F.lit(VERIFY_STAGE).alias("stage"), d.alias("duration_sec"), (d / 60).alias("duration_min"), n.alias("n_pairs"),
        F.try_divide(d * 1000, n).alias("sec_per_1k_pairs"), (n > 0).alias("data_available"),
    )
    stages = costs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, UNTIMED_STAGES))).alias("stage"))
    return verify.unionByName(stages.withColumns({"task": F.lit("all"), "data_available": F.lit(False)}), allowMissingColumns=True)


def score_summary(df: DataFrame, by: str, score: str) -> DataFrame:
    s = F.when(~F.isnan(F.col(score)), F.col(score))
    return df.groupBy(by).agg(F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.round(F.avg(s), 12).alias("mean_score"), F.count(s).alias("n_scored"))


def best_system(metrics: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """The system of the highest value per group, ties to the smaller name."""
    best = F.min_by(F.struct(F.col(name), F.col(value)), F.struct((-F.col(value)).alias("v"), F.col(name).alias("n")))
    return metrics.filter(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def system_order(df: DataFrame, name: str, main: str, auxiliary: list[str]) -> DataFrame:
    """Sorted: the main system, the others by name, auxiliary ones last; adds place."""
    group = F.when(F.col(name) == main, 0).when(F.col(name).isin(*auxiliary), 2).otherwise(1)
    return df.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(group, name)))


def to_markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a small collected frame; numbers with four digits."""

    def cell(v):
        return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return "\n".join([head, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)])


def to_latex(rows: list[dict], columns: list[str]) -> str:
    def cell(v):
        out = "--" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
        return "".join("\\" + ch if ch in "&%$#_{}" else ch for ch in out)

    body = " \\\\\n".join(" & ".join(cell(r.get(c)) for c in columns) for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(columns)}}}\n\\hline\n{' & '.join(map(cell, columns))} \\\\\n\\hline\n{body} \\\\\n\\hline\n\\end{{tabular}}"
