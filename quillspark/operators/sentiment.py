"""How topics relate to a binary label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.stats import average_rank, benjamini_hochberg, binomial_p, chi2_p, wilson
from quillspark.functions.vectors import as_doubles, dot, mean_vector, normalise
from quillspark.sources.io import small

OUTLIER = -1


def inside() -> Column:
    """Documents of a topic; ids may be numbers or names."""
    return F.col("topic").cast("string") != str(OUTLIER)


def base_rate(reviews: DataFrame) -> DataFrame:
    """One row: the mean label of all documents, outliers too."""
    return reviews.agg(F.avg(F.col("label").cast("double")).alias("base"))


def topic_share(reviews: DataFrame) -> DataFrame:
    """n, n_pos, share_pos and diff_pp of each topic but the outliers'."""
    per = reviews.where(inside()).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("n_pos"))
    return per.crossJoin(F.broadcast(base_rate(reviews))).withColumn("share_pos", F.col("n_pos") / F.col("n")).withColumn("diff_pp", 100 * (F.col("share_pos") - F.col("base")))  # one row


def sentiment_table(reviews: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Shares with Wilson intervals, exact two-sided tests against the base rate, q values and directions, by diff_pp."""
    t = topic_share(reviews).withColumn("ci_low", wilson(F.col("n_pos"), F.col("n"), False)).withColumn("ci_high", wilson(F.col("n_pos"), F.col("n"), True))
    t = benjamini_hochberg(t.withColumn("p_value", binomial_p("n_pos", "n", "base")), "p_value", "topic")
    t = t.withColumn("significant", F.col("q_value") < alpha)
    direction = F.when(~F.col("significant"), "neutre").when(F.col("diff_pp") > 0, "positif").otherwise("négatif")
    columns = ["topic", "n", "n_pos", "share_pos", "diff_pp", "ci_low", "ci_high", "p_value", "q_value", "significant"]
    return t.withColumn("direction", direction).select(*columns, "direction").orderBy("diff_pp", "topic")


def crosstab(reviews: DataFrame) -> DataFrame:
    return reviews.where(inside()).groupBy("topic").agg(F.count_if(F.col("label") == 0).alias("n_neg"), F.count_if(F.col("label") == 1).alias("n_pos"))


def global_test(reviews: DataFrame) -> DataFrame:
    """One row: chi2, dof, p_value, cramers_v of topic x label; Yates' correction with one degree of freedom."""
    cells = reviews.where(inside()).groupBy("topic", "label").agg(F.count(F.lit(1)).alias("o"))
    tests = reviews.where(inside()).agg(F.countDistinct("topic").alias("r"), F.countDistinct("label").alias("c"), F.count(F.lit(1)).alias("n"))
    rows, columns = cells.groupBy("topic").agg(F.sum("o").alias("row_n")), cells.groupBy("label").agg(F.sum("o").alias("col_n"))
    full = rows.crossJoin(F.broadcast(columns)).join(cells, ["topic", "label"], "left").crossJoin(F.broadcast(tests))  # two labels, one row
    e = F.col("row_n") * F.col("col_n") / F.col("n")
    gap = F.abs(F.coalesce("o", F.lit(0)) - e)
    gap = F.when((F.col("r") - 1) * (F.col("c") - 1) == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = full.groupBy("r", "c", "n").agg(F.sum(gap * gap / e).alias("chi2")).withColumn("dof", ((F.col("r") - 1) * (F.col("c") - 1)).cast("long"))
    return out.select("chi2", "dof", chi2_p("chi2", "dof").alias("p_value"), F.sqrt(F.col("chi2") / (F.col("n") * (F.least("r", "c") - 1))).alias("cramers_v"))


def final_vs_raw(final: DataFrame, raw: DataFrame) -> DataFrame:
    """Two sentiment tables side by side, the second with the suffix _raw."""
    return final.join(raw.select("topic", *(F.col(c).alias(f"{c}_raw") for c in raw.columns if c != "topic")), "topic")


def robustness(final: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: Pearson, Spearman and share of equal directions of the two tables' diff_pp."""
    both = final_vs_raw(final, raw).select("diff_pp", "diff_pp_raw", "direction", "direction_raw")
    ranked = both.withColumn("ra", average_rank("diff_pp")).withColumn("rb", average_rank("diff_pp_raw"))
    return ranked.agg(F.corr("diff_pp", "diff_pp_raw").alias("pearson"), F.corr("ra", "rb").alias("spearman"), F.avg((F.col("direction") == F.col("direction_raw")).cast("double")).alias("same_direction"))


def sentiment_summary(reviews: DataFrame, raw: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: tests of the final and the raw topics, numbers of topics by direction, robustness."""
    final, before = sentiment_table(reviews, alpha), sentiment_table(raw, alpha)
    counts = final.agg(F.count(F.lit(1)).alias("n_topics"), F.count_if("significant").alias("n_significant"), F.count_if(F.col("direction") == "positif").alias("n_positive"), F.count_if(F.col("direction") == "négatif").alias("n_negative"))
    tests = global_test(reviews).select("chi2", "cramers_v").crossJoin(global_test(raw).select(F.col("chi2").alias("chi2_raw"), F.col("cramers_v").alias("cramers_v_raw")))
    return base_rate(reviews).crossJoin(counts).crossJoin(tests).crossJoin(robustness(final, before))


def representative_reviews(reviews: DataFrame, k: int = 3) -> DataFrame:
    """The k documents of each topic and label nearest to the centroid of the topic's native members (topic_raw = topic).

    reviews: doc_id, label, topic, topic_raw, embedding. A topic without native members uses all of its own.
    """
    members = reviews.where(inside())
    native = mean_vector(members.where(F.col("topic") == F.col("topic_raw")), ["topic"], "embedding", "native")
    every = mean_vector(members, ["topic"], "embedding", "every")
    centroids = every.join(native, "topic", "left").select("topic", normalise(F.coalesce("native", "every")).alias("centroid"))
    near = members.join(small(centroids), "topic").withColumn("similarity", F.round(dot(normalise(as_doubles(F.col("embedding"))), F.col("centroid")), 8))
    place = F.row_number().over(Window.partitionBy("topic", "label").orderBy(F.desc("similarity"), "doc_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k)


def diversified_examples(representatives: DataFrame, k: int = 3) -> DataFrame:
    """Per topic: the best document of each label first, then the others by similarity."""
    by = [F.desc("similarity"), F.col("doc_id")]
    t = representatives.withColumn("_best", F.row_number().over(Window.partitionBy("topic", "label").orderBy(*by)) == 1)
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("_best"), *by)))
    return t.where(F.col("place") <= k).drop("_best")


def diverging_data(table: DataFrame, names: DataFrame) -> DataFrame:
    """What a diverging bar chart shows: name, difference and the two arms of the interval in points."""
    t = table.join(small(names), "topic", "left")
    return t.select("topic", F.concat_ws(" · ", F.col("topic").cast("string"), "name").alias("name"), "diff_pp", (100 * (F.col("ci_high") - F.col("share_pos"))).alias("plus"), (100 * (F.col("share_pos") - F.col("ci_low"))).alias("minus"), "direction")


def extremes(table: DataFrame, k: int = 3, only_significant: bool = True) -> DataFrame:
    """The k topics with the largest and with the smallest difference: side, place, topic, diff_pp."""
    t = table.where("significant") if only_significant else table
    side = lambda name, order: t.orderBy(order, "topic").limit(k).select(F.lit(name).alias("side"), "topic", "diff_pp").withColumn("place", F.row_number().over(Window.orderBy(order, "topic")))
    return side("best", F.desc("diff_pp")).unionByName(side("worst", F.asc("diff_pp")))
