"""Evaluation statistics over long rows (block columns..., item, k, p, gold): k numbers the outcomes, p is renormalised."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOR = 1e-12


def top(probs: Column | str) -> Column:
    """Index of the largest probability; ties go to the first outcome."""
    p = F.col(probs) if isinstance(probs, str) else probs
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def renormalise(probs: Column | str) -> Column:
    p = F.col(probs) if isinstance(probs, str) else probs
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: x / total)


def temper(probs: Column, t: float) -> Column:
    """softmax(ln p / T); zero stays zero."""
    raised = F.transform(probs, lambda x: F.when(x > 0, F.pow(x, F.lit(1 / t))).otherwise(F.lit(0.0)))
    return renormalise(raised)


def scored(df: DataFrame, probs: str = "probs", gold: str = "gold") -> DataFrame:
    """df with predicted, hit, confidence, brier (0 to 2) and nll; rows without a gold answer are left out."""
    p = F.col(probs)
    brier = F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == F.col(gold)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    out = df.where(F.col(gold).isNotNull()).withColumn("predicted", top(probs))
    return out.withColumns({"hit": (F.col("predicted") == F.col(gold)).cast("int"), "confidence": F.array_max(p), "brier": brier, "nll": -F.ln(F.greatest(F.get(p, F.col(gold)), F.lit(FLOOR)))})


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("brier").alias("brier"), F.sqrt(F.avg("brier") / 2).alias("root_brier"), F.avg("nll").alias("nll"))


def macro_f1(df: DataFrame, by: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Mean F1 over the classes seen as gold or predicted."""
    side = lambda c, g, p: df.select(*by, F.col(c).alias("class"), F.lit(g).alias("g"), F.lit(p).alias("p"), ((F.col(gold) == F.col(predicted)) & F.lit(g == 1)).cast("int").alias("tp"))
    counts = side(gold, 1, 0).union(side(predicted, 0, 1)).groupBy(*by, "class").agg((2 * F.sum("tp") / (F.sum("g") + F.sum("p"))).alias("f1"))
    return counts.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_classes"))


def ece(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal, right-closed bins of confidence."""
    bucket = F.greatest(F.ceil(F.col("confidence") * bins), F.lit(1))
    cells = df.groupBy(*by, bucket.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("hit").alias("a"))
    return cells.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def _ties(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups of tied confidences, most confident first, with running rows and losses: within 1,024 bins of confidence, to
    which the bins' own running sums are added."""
    groups = df.groupBy(*by, "confidence").agg(F.count("*").alias("n"), F.sum(1 - F.col("hit")).alias("loss")).withColumn("_bin", F.floor((1 - F.col("confidence")) * 1024))
    bins = groups.groupBy(*by, "_bin").agg(F.sum("n").alias("_n"), F.sum("loss").alias("_loss"))
    up, whole = W.partitionBy(*by).orderBy("_bin"), W.partitionBy(*by)
    bins = bins.select(*by, "_bin", (F.sum("_n").over(up) - F.col("_n")).alias("_rows"), (F.sum("_loss").over(up) - F.col("_loss")).alias("_losses"), F.sum("_n").over(whole).alias("all"))
    w = W.partitionBy(*by, "_bin").orderBy(F.desc("confidence"))
    inner = groups.withColumns({"rows": F.sum("n").over(w), "losses": F.sum("loss").over(w)}).join(bins, [*by, "_bin"])
    return inner.withColumns({"rows": F.col("rows") + F.col("_rows"), "losses": F.col("losses") + F.col("_losses")}).drop("_bin", "_rows", "_losses")


def augrc(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean over coverages of the running loss over N, ties sharing their mean loss; normalised by (N + 1) / 2N.

    Within a tie group of n rows after R rows and L losses the running losses are L + i l / n, i = 1..n, so a group adds n L + l (n + 1) / 2."""
    g = _ties(df, by)
    part = F.col("n") * (F.col("losses") - F.col("loss")) + F.col("loss") * (F.col("n") + 1) / 2
    return g.groupBy(*by).agg((F.sum(part) / F.pow(F.max("all"), F.lit(2))).alias("augrc"), F.max("all").alias("n")).withColumn("augrc_normalised", F.col("augrc") / ((F.col("n") + 1) / (2 * F.col("n"))))


def coverage_at_risk(df: DataFrame, by: list[str], risk: float) -> DataFrame:
    """The largest confident prefix of whole tie groups with a mean loss of at most risk: its threshold and share."""
    ok = F.col("losses") <= risk * F.col("rows")
    return _ties(df, by).groupBy(*by).agg(F.min(F.when(ok, F.col("confidence"))).alias("threshold"), F.coalesce(F.max(F.when(ok, F.col("rows"))) / F.max("all"), F.lit(0.0)).alias("coverage"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = hits / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def confidence_scores(probs: Column) -> dict[str, Column]:
    """Max probability, negative normalised entropy, gap of the best two, and DOCTOR's collision score."""
    k = F.size(probs)
    entropy = F.aggregate(F.transform(probs, lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    ordered = F.sort_array(probs, asc=False)
    squares = F.aggregate(F.transform(probs, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return {"max_prob": F.array_max(probs), "neg_entropy": -entropy / F.ln(k.cast("double")), "gap": F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)), "doctor": -(1 - squares) / squares}


def holm(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """df with the step-down adjusted p."""
    order = W.partitionBy(*by).orderBy(p)
    raw = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(W.partitionBy(*by)) - F.row_number().over(order) + 1))
    return df.withColumn("_raw", raw).withColumn("adjusted", F.max("_raw").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_raw")


#: How often an item is in a draw: Poisson(1), by where 32 bits of a hash fall among these bounds (its cumulated probabilities).
POISSON = [f"{int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32):08x}" for k in range(9)]


def resample(items: DataFrame, by: list[str], item: str, values: list[str], draws: int, salt: str) -> DataFrame:
    """(by..., draw, means of the values over the resampled items), draws being a multiple of 8. An item's weight in a draw is a hash of (salt, item,
    draw) alone, so that blocks share their resamples, and a draw is one aggregate with partial sums: nothing is ranked or joined."""
    from ..functions.hashing import digest

    # a row becomes draws / 8 rows, so the few bytes of each are dealt to all tasks first
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = items.select(*by, *values, F.col(item).alias("_item")).repartition(tasks, "_item").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws // 8 - 1))))
    hashed = blocks.withColumn("_hex", digest(salt, "_b", "_item"))

    def weight(j: int) -> Column:
        u, out = F.substring("_hex", 8 * j + 1, 8), F.lit(len(POISSON))
        for k in reversed(range(len(POISSON))):
            out = F.when(u < POISSON[k], k).otherwise(out)
        return out

    weighted = hashed.select(*by, *values, "_b", *[weight(j).alias(f"_w{j}") for j in range(8)])
    # eight draws of a hash are eight aggregates of one row
    mean = lambda j, v: F.sum(F.col(f"_w{j}") * F.col(v)) / F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col(f"_w{j}"))), F.lit(0))
    sums = weighted.groupBy(*by, "_b").agg(F.array(*[F.struct(*[mean(j, v).alias(v) for v in values]) for j in range(8)]).alias("_m"))
    out = sums.select(*by, "_b", F.posexplode("_m").alias("_j", "_x")).select(*by, (F.col("_b") * 8 + F.col("_j")).alias("draw"), "_x.*")
    return out.dropna(subset=values, how="all")


def bootstrap(items: DataFrame, by: list[str], item: str, value: str, draws: int, salt: str) -> DataFrame:
    """Percentile interval of the mean of value over resampled items. Items are aggregated before."""
    means = resample(items, by, item, [value], draws, salt)
    return means.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired(items: DataFrame, by: list[str], item: str, gain: str, draws: int, salt: str) -> DataFrame:
    """Mean of the paired differences, its percentile interval and the two-sided p: twice the smaller share of draws on a side of zero."""
    observed = items.groupBy(*by).agg(F.avg(gain).alias("difference"))
    side = lambda c: F.avg(c.cast("double"))
    p = F.least(F.lit(1.0), 2 * F.least(side(F.col(gain) <= 0), side(F.col(gain) >= 0)))
    q = resample(items, by, item, [gain], draws, salt).groupBy(*by).agg(F.percentile(gain, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), p.alias("p"))
    return observed.join(q, by).select(*by, "difference", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p")


def cramers_v(table: list[list[Column]]) -> Column:
    """Cramer's V of a table of counts (doubles) with two columns or rows; cells of an empty margin add nothing, and an empty table has none."""
    rows, cols = [sum(r, F.lit(0.0)) for r in table], [sum(c, F.lit(0.0)) for c in zip(*table, strict=True)]
    n = sum(rows, F.lit(0.0))
    part = lambda i, j: F.when(rows[i] * cols[j] > 0, F.pow(table[i][j] - rows[i] * cols[j] / n, F.lit(2.0)) / (rows[i] * cols[j] / n)).otherwise(0.0)
    return F.sqrt(sum((part(i, j) for i in range(len(rows)) for j in range(len(cols))), F.lit(0.0)) / F.nullif(n, F.lit(0.0)))


def position_effect(questions: DataFrame, key: str, runs: str, places: list[int], right: list[int], shuffles: int, salt: str) -> DataFrame:
    """(v, p): Cramer's V of runs' place by right (runs: array of struct(..., p, c), at most eight a question), and the share of
    shuffles of the places within each question that reach it, the observed table counted as one of them.

    A question whose places are all the same, or whose runs are all right or all wrong, gives each shuffle the cells that it has, so it is
    counted once. The others become a row for each shuffle, in which a run's place goes to the run of its rank; ranks come from
    comparing the runs' words in pairs, since functions of arrays would be evaluated per element. Equal words stand in order of place."""
    from ..functions.hashing import digest
    from .cut import cut

    spark, n_cells = questions.sparkSession, len(places) * len(right)
    q = cut(questions.select(F.col(key).cast("string").alias("_q"), F.col(f"{runs}.p").alias("_p"), F.col(f"{runs}.c").alias("_c")))
    fixed = F.least(F.size(F.array_distinct("_p")), F.size(F.array_distinct("_c"))) < 2
    cell = F.zip_with("_p", "_c", lambda p, c: p * len(right) + c)
    each = q.select(F.size("_p").alias("_n"), fixed.alias("_fixed"), F.explode(cell).alias("_cell"))
    is_in = [F.col("_cell") == i for i in range(n_cells)]
    most, *counts = each.agg(F.max("_n"), *[F.count_if(x) for x in is_in], *[F.count_if(x & F.col("_fixed")) for x in is_in]).first()
    if not most:
        return spark.range(1).select(F.lit(None).cast("double").alias("v"), F.lit(1 / (shuffles + 1)).alias("p"))

    # a row becomes as many as there are shuffles, so the few bytes of each are dealt to all tasks first; the first run by place is run 0
    by_place, numbers = F.sort_array(F.transform("_p", lambda p, i: F.struct(p.alias("p"), (8 * i + 1).alias("at")))), range(most)
    mixed = q.where(~fixed).select("_q", "_c", by_place.alias("_by"))
    mixed = mixed.select("_q", "_c", *[F.get("_by", F.lit(i))[c].alias(f"_{c}{i}") for i in numbers for c in ("p", "at")])
    x = mixed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_q").select("*", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("_k"))
    ps = [f"_p{i}" for i in numbers]
    x = x.withColumn("_hex", digest(salt, "_k", "_q")).select("_k", "_c", *ps, *[F.substring("_hex", F.col(f"_at{i}"), F.lit(8)).alias(f"_u{i}") for i in numbers])
    # 1 if run j, which is after run i by place, is dealt before it
    x = x.select("_k", "_c", *ps, *[F.when(F.col(f"_u{j}") < F.col(f"_u{i}"), 1).otherwise(0).alias(f"_s{i}_{j}") for j in numbers for i in range(j)])
    rank = [sum((F.col(f"_s{i}_{j}") for j in range(i + 1, most)), F.lit(i)) - sum((F.col(f"_s{j}_{i}") for j in range(i)), F.lit(0)) for i in numbers]
    x = x.select("_k", *[(F.col(ps[i]) * len(right) + F.get("_c", rank[i])).alias(f"_cell{i}") for i in numbers])
    count = lambda c: F.sum(sum((F.when(F.col(f"_cell{i}") == c, 1).otherwise(0) for i in numbers), F.lit(0)))
    tables = x.groupBy("_k").agg(*[count(c).alias(f"_o{c}") for c in range(n_cells)])

    table = lambda of: [[of(i * len(right) + j) for j in range(len(right))] for i in range(len(places))]
    seen = cramers_v(table(lambda c: F.lit(float(counts[c]))))
    v = cramers_v(table(lambda c: (F.col(f"_o{c}") + counts[n_cells + c]).cast("double")))
    # without questions to shuffle there is no row, and every shuffle is the observed table
    below = tables.select(v.alias("v")).agg(F.count_if(F.col("v") < seen - 1e-12).alias("_below"))
    return below.select(seen.alias("v"), ((shuffles + 1 - F.col("_below")) / F.lit(float(shuffles + 1))).alias("p"))


def fit_temperature(df: DataFrame, by: list[str], probs: str, gold: str, low: float = 0.05, high: float = 20.0, points: int = 49) -> DataFrame:
    """The temperature of least cross-entropy on a grid even in log T; at a bound of the grid there is no fit, and 1.0 holds."""
    grid = [math.exp(math.log(low) + i * (math.log(high) - math.log(low)) / (points - 1)) for i in range(points)]
    each = df.where(F.col(gold).isNotNull()).select(*by, F.col(probs).alias("_p"), F.col(gold).alias("_g"), F.explode(F.array(*[F.lit(t) for t in grid])).alias("t"))
    tempered = F.transform("_p", lambda x: F.when(x > 0, F.pow(x, 1 / F.col("t"))).otherwise(F.lit(0.0)))
    loss = -F.ln(F.greatest(F.get("_x", F.col("_g")) / F.aggregate("_x", F.lit(0.0), lambda a, x: a + x), F.lit(FLOOR)))
    per_t = each.withColumn("_x", tempered).groupBy(*by, "t").agg(F.avg(loss).alias("loss"))
    best = per_t.groupBy(*by).agg(F.min(F.struct("loss", "t")).alias("b"))
    bound = (F.col("b.t") == grid[0]) | (F.col("b.t") == grid[-1])
    return best.select(*by, F.when(bound, 1.0).otherwise(F.col("b.t")).alias("temperature"), F.col("b.loss").alias("loss"))


def board(blocks: DataFrame, model: str, axis: str, value: str, weights: dict[str, float]) -> DataFrame:
    """Weighted geometric mean of the axes that every model has; 0 if one is 0; null composites rank last."""
    weight = F.coalesce(*[F.when(F.col(axis) == a, F.lit(w)) for a, w in weights.items()])
    models = blocks.select(model).distinct().agg(F.count("*").alias("_models"))
    full = blocks.where(F.col(value).isNotNull()).groupBy(axis).agg(F.count_distinct(model).alias("_has")).join(F.broadcast(models)).where("_has = _models").select(axis)
    used = blocks.join(F.broadcast(full), axis).withColumn("_w", weight)
    mean = F.when(F.min(value) <= 0, F.lit(0.0)).otherwise(F.exp(F.sum(F.col("_w") * F.ln(F.when(F.col(value) > 0, F.col(value)))) / F.sum("_w")))
    out = used.groupBy(model).agg(mean.alias("composite"))
    return out.withColumn("place", F.rank().over(W.orderBy(F.desc("composite"))))


def confident(rows: DataFrame, task: str, key: str) -> DataFrame:
    """(task, key) of the scored rows whose given label looks wrong, by confident learning with pruning by noise rate.

    An outcome's bar is the mean probability of the outcome on rows given it. A row counts in the joint at its given label
    and the likeliest outcome above its bar; a given label's counts are stretched to its rows. From each cell off the
    diagonal the stretched number of rows with the largest margins of outcome over label is flagged, if above zero. Margins
    are counted in 1,024 bins first, so that only the bin in which a cell's number runs out is ranked."""
    wide = rows.select(task, key, "gold", F.posexplode("probs").alias("k", "p"), F.get("probs", F.col("gold")).alias("pg"))
    bars = rows.groupBy(task, F.col("gold").alias("k")).agg(F.avg(F.get("probs", F.col("gold"))).alias("bar"))
    per = bars.groupBy(task).agg(F.map_from_entries(F.collect_list(F.struct("k", "bar"))).alias("bars"))
    at = F.transform("probs", lambda x, i: F.when(x >= F.try_element_at("bars", i), F.struct(x.alias("p"), i.alias("k"))))
    joint = rows.join(per, task).select(task, "gold", F.array_max(at)["k"].alias("k")).groupBy(task, "gold", "k").agg(F.count("*").alias("n"))
    given = W.partitionBy(task, "gold")
    share = F.col("n") / F.sum(F.when(F.col("k").isNotNull(), F.col("n"))).over(given) * F.sum("n").over(given)
    quota = joint.select(task, "gold", "k", F.bround(share).cast("bigint").alias("quota")).where("k <> gold")
    cell = [task, "gold", "k"]
    margins = wide.where("k <> gold AND p > pg").select(*cell, key, (F.col("p") - F.col("pg")).alias("margin")).withColumn("bin", F.floor((1 - F.col("margin")) * 1024))
    bins = margins.groupBy(*cell, "bin").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy(*cell).orderBy("bin")))
    bins = bins.join(quota, cell).where("upto - n < quota").select(*cell, "bin", F.when(F.col("upto") > F.col("quota"), F.col("quota") - F.col("upto") + F.col("n")).alias("room"))
    near = margins.join(bins, [*cell, "bin"])
    last = near.where("room IS NOT NULL").withColumn("rank", F.row_number().over(W.partitionBy(*cell, "bin").orderBy(F.desc("margin"), F.desc(key))))
    return near.where("room IS NULL").select(task, key).union(last.where("rank <= room").select(task, key)).distinct()
