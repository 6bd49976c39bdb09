"""How alike two clusterings are: weighted best-match F, and normalised mutual information for overlapping covers.

Both work on the pairs of clusters that share a member. For mutual information, where disjoint pairs count
too, all disjoint partners of one size are alike for all clusters of one size: pairs are made of distinct sizes,
of which there are fewer than the square root of twice the memberships on either side. Only a cluster that meets
every partner of some size looks at the sizes by itself.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.hashing import entropy_term
from sketchloom.functions.storage import join_shuffled, materialise
from sketchloom.operators.clusters import renamed, sizes, with_floor

EPSILON = sys.float_info.epsilon


def intersections(test: DataFrame, base: DataFrame) -> DataFrame:
    """(x_label, y_label, x_size, y_size, common) for the pairs that share a member."""
    x = test.distinct().select(F.col("label").alias("x_label"), "member")
    y = base.distinct().select(F.col("label").alias("y_label"), "member")
    common = join_shuffled(x, y, "member").groupBy("x_label", "y_label").agg(F.count(F.lit(1)).alias("common"))
    xs, ys = sizes(test).toDF("x_label", "x_size"), sizes(base).toDF("y_label", "y_size")
    return join_shuffled(join_shuffled(common, xs, "x_label"), ys, "y_label").select("x_label", "y_label", "x_size", "y_size", "common")


def f_score(common: Column, x_size: Column, y_size: Column) -> Column:
    p, q = common / x_size, common / y_size
    return 2 * p * q / (p + q)


def best_matches(test: DataFrame, base: DataFrame) -> DataFrame:
    """(side, label, size, best): each cluster's best F against the other side, 0 if it meets none."""
    pairs = intersections(test, base).withColumn("f", f_score(F.col("common"), F.col("x_size"), F.col("y_size")))
    out = []
    for side, clusters, label in (("X", test, "x_label"), ("Y", base, "y_label")):
        best = pairs.groupBy(F.col(label).alias("label")).agg(F.max("f").alias("best"))
        own = join_shuffled(sizes(clusters), best, "label", "left")
        out.append(own.select(F.lit(side).alias("side"), "label", "size", F.coalesce("best", F.lit(0.0)).alias("best")))
    return out[0].unionByName(out[1])


def f_value(test: DataFrame, base: DataFrame, floor: int = 0, rename: bool = False) -> DataFrame:
    """One row (f_test, f_base, f_avg); an empty side gives nulls. ``floor`` drops smaller clusters first."""
    if rename:
        test, base = renamed(test), renamed(base)
    if floor > 0:
        test, base = with_floor(test, floor), with_floor(base, floor)
    best = best_matches(test, base)

    def weighted(side: str) -> Column:
        own = F.col("side") == side
        return F.try_divide(F.sum(F.when(own, F.col("size") * F.col("best"))), F.sum(F.when(own, F.col("size"))))

    return best.agg(weighted("X").alias("f_test"), weighted("Y").alias("f_base")).withColumn("f_avg", (F.col("f_test") + F.col("f_base")) / 2)


def conditional_entropy(a: Column, b: Column, c: Column, d: Column, n: Column) -> Column:
    """H(x | y) of one pair from its four counts; d common, c only in x, b only in y, a in neither."""
    h = lambda w: entropy_term(w, n)
    joint = h(a) + h(b) + h(c) + h(d) - h(b + d) - h(a + c)
    joint = F.when(joint < EPSILON, 0.0).otherwise(joint)
    return F.when(h(a) + h(d) >= h(b) + h(c), joint).otherwise(h(c + d) + h(a + b))


def _entropies(xs: DataFrame, ys: DataFrame, met: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """One-row frames of H(X) and H(X | Y) from (x_label, x_size), (y_label, y_size) and their intersections."""
    total = F.lit(float(n))
    own = xs.agg(F.sum(entropy_term(F.col("x_size").cast("double"), total) + entropy_term(total - F.col("x_size"), total)).alias("h"))
    d = F.col("common").cast("double")
    b, c = F.col("y_size") - d, F.col("x_size") - d
    of_met = met.select("x_label", conditional_entropy(total - b - c - d, b, c, d, total).alias("h"))
    # A partner of some size is disjoint if more partners have that size than meet the cluster.
    by_size = ys.groupBy("y_size").agg(F.count(F.lit(1)).alias("all"))
    meeting = met.groupBy("x_label", "y_size").agg(F.count(F.lit(1)).alias("meeting"))
    zero, b, c = F.lit(0.0), F.col("y_size").cast("double"), F.col("x_size").cast("double")
    apart = xs.select("x_size").distinct().crossJoin(by_size).withColumn("h", conditional_entropy(total - b - c, b, c, zero, total))
    full = meeting.join(by_size, "y_size").filter("meeting = all").select("x_label", "y_size")
    exceptional = full.select("x_label").distinct()
    usual = xs.join(exceptional, "x_label", "left_anti").join(apart.groupBy("x_size").agg(F.min("h").alias("h")), "x_size").select("x_label", "h")
    unusual = xs.join(exceptional, "x_label", "left_semi").join(apart, "x_size").join(full, ["x_label", "y_size"], "left_anti").select("x_label", "h")
    least = of_met.unionByName(usual).unionByName(unusual).groupBy("x_label").agg(F.min("h").alias("h"))
    return own, least.agg(F.sum("h").alias("h"))


def nmi(test: DataFrame, base: DataFrame, n: int) -> DataFrame:
    """One row (h_x, h_y, h_x_given_y, h_y_given_x, nmi_max, nmi_lfk) for covers of n members; empty sides give nulls."""
    xs, ys = materialise(sizes(test).toDF("x_label", "x_size"), "sizes"), materialise(sizes(base).toDF("y_label", "y_size"), "sizes")
    met = materialise(intersections(test, base), "met")  # read six times, from either side
    turned = {"x_label": "y_label", "x_size": "y_size", "y_label": "x_label", "y_size": "x_size"}
    hx, hxy = _entropies(xs, ys, met, n)
    hy, hyx = _entropies(*(t.select(*(F.col(c).alias(turned.get(c, c)) for c in t.columns)) for t in (ys, xs, met)), n)
    row = hx.toDF("h_x").crossJoin(hy.toDF("h_y")).crossJoin(hxy.toDF("h_x_given_y")).crossJoin(hyx.toDF("h_y_given_x"))
    # What one side tells of the other is never negative; rounding of sums in another order must not make it so.
    told = F.greatest(F.col("h_x") - F.col("h_x_given_y"), F.lit(0.0)) + F.greatest(F.col("h_y") - F.col("h_y_given_x"), F.lit(0.0))
    best = F.when(F.col("h_x").isNotNull() & F.col("h_y").isNotNull(), F.try_divide(told / 2, F.greatest("h_x", "h_y")))
    lfk = 1 - (F.try_divide(F.col("h_x_given_y"), F.col("h_x")) + F.try_divide(F.col("h_y_given_x"), F.col("h_y"))) / 2
    return row.withColumn("nmi_max", best).withColumn("nmi_lfk", lfk)
