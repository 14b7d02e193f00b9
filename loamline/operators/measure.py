"""Evaluation statistics, histories and counters as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.operators.running import running_sum


def accuracy(df: DataFrame, by: list[str], right: Column, invalid: Column) -> DataFrame:
    """n, accuracy, invalid rate and binomial standard error."""
    p = F.avg(right.cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), p.alias("accuracy"), F.avg(invalid.cast("double")).alias("invalid"), F.sqrt(p * (1 - p) / F.count("*")).alias("stderr"))


def guess_credited(df: DataFrame, by: list[str], right: Column, invalid: Column, choices: Column) -> DataFrame:
    """An invalid answer earns one over the number of choices."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(invalid, 1.0 / choices).otherwise(right.cast("double"))).alias("accuracy"))


def macro(df: DataFrame, subject: str, right: Column) -> DataFrame:
    """The plain mean of subject accuracies; n counts subjects."""
    each = df.groupBy(subject).agg(F.avg(right.cast("double")).alias("a"))
    return each.agg(F.count("*").alias("n"), F.avg("a").alias("macro_accuracy"))


def weighted_merge(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean over the shards that have the value."""
    has = F.col(value).isNotNull()
    return df.groupBy(*by).agg(F.sum(weight).alias("n"), F.try_divide(F.sum(F.when(has, F.col(value) * F.col(weight))), F.sum(F.when(has, F.col(weight)))).alias("value"))


def mean_stderr(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """n, mean and sample standard error (0 for one value); values that aren't finite are left out."""
    kept = df.withColumn("_v", value).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v") / F.sqrt(F.count("*")), F.lit(0.0)).alias("stderr"))


def letter_grade(value: Column, partial: bool) -> Column:
    """C is 1, P a half if partial credit is given; I, P and blank are 0; others don't count."""
    out = F.when(value == "C", 1.0)
    return (out.when(value == "P", 0.5) if partial else out).when(value.isin("I", "P", ""), 0.0)


def macro_f1(df: DataFrame, target: str, prediction: str, labels: list[str]) -> DataFrame:
    """Mean over labels of one-against-the-rest F1, 0 where nothing is there."""
    sums = []
    for i, label in enumerate(labels):
        t, p = F.col(target) == label, F.coalesce(F.col(prediction) == label, F.lit(False))
        sums += [F.count_if(t & p).alias(f"tp{i}"), F.count_if(~t & p).alias(f"fp{i}"), F.count_if(t & ~p).alias(f"fn{i}")]
    counts = df.agg(*sums)
    f1 = [F.coalesce(F.try_divide(2 * F.col(f"tp{i}"), 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")), F.lit(0.0)) for i in range(len(labels))]
    return counts.select((sum(f1[1:], f1[0]) / len(labels)).alias("macro_f1"))


def matthews(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Multi-class Matthews correlation; a null prediction is a class of its own; 0 where it isn't defined."""
    pairs = df.select(F.col(target).cast("string").alias("t"), F.coalesce(F.col(prediction).cast("string"), F.lit("__invalid__")).alias("p")).filter("t is not null")
    cells = pairs.groupBy("t", "p").agg(F.count("*").alias("n"))
    ends = cells.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("nt"), F.lit(0).cast("long").alias("np"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("c")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("nt"), F.col("n").alias("np"), F.lit(0).cast("long").alias("c")))).alias("e")).select("e.*")
    sides = ends.groupBy("k").agg(F.sum("nt").alias("nt"), F.sum("np").alias("np"), F.sum("c").alias("c"))
    s, c = F.sum("nt").cast("double"), F.sum("c").cast("double")
    tp, tt, pp = (F.sum(F.col(a) * F.col(b)).cast("double") for a, b in (("nt", "np"), ("nt", "nt"), ("np", "np")))
    root = F.sqrt((s * s - tt) * (s * s - pp))
    return sides.agg(F.when(root > 0, (c * s - tp) / root).otherwise(0.0).alias("mcc"))


def set_scores(df: DataFrame, by: list[str], guess: str, gold: str) -> DataFrame:
    """Precision, recall, F1 and exact share over array columns taken as sets."""
    tp = F.sum(F.size(F.array_intersect(guess, gold)))
    fp, fn = F.sum(F.size(F.array_except(guess, gold))), F.sum(F.size(F.array_except(gold, guess)))
    exact = F.avg((F.size(F.array_except(guess, gold)) + F.size(F.array_except(gold, guess)) == 0).cast("double"))
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), exact.alias("exact"))


def clustered_error(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Mean over rows, and its error where rows of a cluster go together."""
    mean = df.agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    joined = sums.join(F.broadcast(mean))  # one row
    v = F.sum(F.pow(F.col("s") - F.col("k") * F.col("m"), 2))
    c = F.count("*")
    return joined.groupBy("m", "n").agg(F.when(c > 1, F.sqrt(v * c / (c - 1)) / F.col("n")).otherwise(0.0).alias("stderr")).select(F.col("m").alias("mean"), "stderr", "n")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k of ``c`` right ones among ``n`` tries."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, j: acc * (n - c - j) / (n - j))
    return F.when(n - c < k, 1.0).otherwise(1.0 - miss)


def majority(df: DataFrame, by: list[str], vote: str, pos: str) -> DataFrame:
    """The most frequent vote, ties to the one seen first."""
    counts = df.groupBy(*by, vote).agg(F.count("*").alias("n"), F.min(pos).alias("_first"))
    return counts.groupBy(*by).agg(F.max_by(vote, F.struct(F.col("n"), (-F.col("_first")).alias("f"))).alias("majority"), F.max("n").alias("votes"))


def normalised(metric: Column, value: Column, percent: str | None = None) -> Column:
    """To 0..1: values over 1 and those under the prefix ``percent`` are percentages, negatives 0, above 100 none."""
    share = (value > 1) | metric.startswith(percent) if percent else value > 1
    return F.when(value > 100, None).when(value < 0, 0.0).when(share, value / 100).otherwise(value)


def section_averages(df: DataFrame, by: list[str], section: str, value: str, expected: int | None = None) -> DataFrame:
    """Mean of the values present and their count; with ``expected``, null unless all are there."""
    mean = F.avg(value)
    return df.groupBy(*by, section).agg((mean if expected is None else F.when(F.count(value) == expected, mean)).alias("average"), F.count(value).alias("n"))


def coalesce_rows(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value that isn't null for each key."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def fullest_row(df: DataFrame, key: str, filled: str, order: str) -> DataFrame:
    """The row with most fields of each key, the earliest of equals."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(filled), order))
    return df.withColumn("_k", rank).filter("_k = 1").drop("_k")


def interpolated(df: DataFrame, x: str, boundaries: list[tuple[float, float]]) -> Column:
    """Piecewise-linear through ``(x, y)`` boundaries, carried on by the last slope."""
    out = None
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(boundaries, boundaries[1:])):
        line = y0 + (F.col(x) - x0) * ((y1 - y0) / (x1 - x0))
        if i == len(boundaries) - 2:
            out = line if out is None else out.otherwise(line)
        else:
            out = F.when(F.col(x) < x1, line) if out is None else out.when(F.col(x) < x1, line)
    return out


def intervals(df: DataFrame, job: str, event: str, at: str, start: str, end: str) -> DataFrame:
    """Over jobs with a start and an end (the last of each): count, summed seconds, and seconds from first start to last end."""
    last = lambda e: F.max(F.when(F.col(event) == e, F.unix_timestamp(F.col(at).cast("timestamp"))))
    jobs = df.groupBy(job).agg(last(start).alias("s"), last(end).alias("e")).filter("s is not null and e is not null")
    return jobs.agg(F.count("*").alias("jobs"), F.sum(F.col("e") - F.col("s")).alias("seconds"), (F.max("e") - F.min("s")).alias("wall"))


def open_jobs(df: DataFrame, job: str, event: str, at: str, order: str, opening: list[str], closing: list[str]) -> DataFrame:
    """Jobs whose last opening or closing event is an opening one."""
    told = df.filter(F.col(event).isin(*opening, *closing)).groupBy(job).agg(F.max_by(F.struct(event, at), F.struct(at, order)).alias("l"))
    return told.filter(F.col(f"l.{event}").isin(*opening)).select(job, f"l.{event}", f"l.{at}")


def loops(df: DataFrame, by: str, order: list[str], done: str, total: str) -> DataFrame:
    """Runs of a counter: a new one when it falls or its total changes; the last point of each."""
    w = Window.partitionBy(by).orderBy(*order)
    fresh = F.coalesce((F.col(done) < F.lag(done).over(w)) | (F.col(total) != F.lag(total).over(w)), F.lit(True))
    runs = df.withColumn("loop", F.sum(fresh.cast("int")).over(w)).withColumn("_k", F.row_number().over(w))
    return runs.groupBy(by, "loop").agg(F.max_by(done, "_k").alias(done), F.max_by(total, "_k").alias(total), F.count("*").alias("points"))


def attempts(df: DataFrame, by: list[str], ok: Column, out_of_memory: Column, batch: str, free: str) -> DataFrame:
    """Attempts, successes, failures for memory, greatest batch that worked, and least, median (cut) and greatest free memory."""
    return df.groupBy(*by).agg(
        F.count("*").alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(out_of_memory).alias("ooms"), F.max(F.when(ok, F.col(batch))).alias("max_batch"),
        F.min(F.when(ok, F.col(free))).alias("min_free"), F.median(F.when(ok, F.col(free))).cast("long").alias("median_free"), F.max(F.when(ok, F.col(free))).alias("max_free"),
    )


def counters(df: DataFrame, sets: list[list[str]], keep: Column) -> DataFrame:
    """Audited, kept, dropped and keep rate (null without rows), over grouping sets."""
    names = sorted({c for s in sets for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(
        F.count("*").alias("audited"), F.count_if(keep).alias("keep"), F.count_if(~keep).alias("drop"), F.try_divide(F.count_if(keep), F.count("*")).alias("keep_rate")
    )


def token_progress(df: DataFrame, by: str, keep: Column, tokens: str, target: Column) -> DataFrame:
    """Tokens of kept rows against a target, and the share rejected (0 without rows)."""
    got = F.coalesce(F.sum(F.when(keep, F.col(tokens))), F.lit(0))
    return df.groupBy(by).agg(got.alias("tokens"), F.max(target).alias("target"), (got >= F.max(target)).alias("complete"), F.coalesce(F.try_divide(F.count_if(~keep), F.count("*")), F.lit(0.0)).alias("reject_rate"))


def round_robin(df: DataFrame, weight: str, name: str, n: int) -> DataFrame:
    """Resources dealt in turn by falling weight: ``lane``."""
    placed = running_sum(df.withColumn("_light", -F.col(weight)), [], ["_light", name], F.lit(1), "_place")
    return placed.withColumn("lane", (F.col("_place") - 1) % n).drop("_light", "_place")


def lane_finish(seconds: list[float], busy: list[float], lanes: int) -> float:
    """When the last of queued jobs ends, if each goes to the least loaded lane."""
    import heapq

    loads = sorted(busy)[:lanes] + [0.0] * max(0, lanes - len(busy))
    heapq.heapify(loads)
    for s in seconds:
        heapq.heapreplace(loads, loads[0] + s)
    return max(loads)


def lane_finishes(jobs: DataFrame, by: list[str], order: str, seconds: str, busy: list[float], lanes: int) -> DataFrame:
    """``lane_finish`` of each queue, whose jobs go in ``order``: ``n, finish``.  A queue is one row, for each job waits for the ones before it."""
    start = F.array(*[F.lit(float(x)) for x in sorted([*sorted(busy)[:lanes], *[0.0] * max(0, lanes - len(busy))])])
    queue = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(seconds).cast("double"), F.lit(0.0)).alias("s"))))
    placed = lambda loads, job: F.array_sort(F.concat(F.array(loads[0] + job["s"]), F.slice(loads, 2, lanes)))
    return jobs.groupBy(*by).agg(F.count("*").alias("n"), F.array_max(F.aggregate(queue, start, placed)).alias("finish"))


def failures(df: DataFrame, by: list[str], bucket: Column, example: str) -> DataFrame:
    """Count and first example of each bucket."""
    return df.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(example).alias("example"))


def bootstrap(df: DataFrame, key: str, value: str, rounds: int, seed: int) -> DataFrame:
    """Mean and 95 % interval of means over Poisson resamples drawn by hash: each row's weight in a round is a draw of mean one."""
    from loamline.functions import hashing as H

    u = H.draw(seed, F.col("round"), F.col(key))
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))
    rounds_ = df.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("w", weight)
    means = rounds_.groupBy("round").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    sd = F.stddev_samp("m") / F.sqrt(F.count("*"))
    return means.agg(F.avg("m").alias("mean"), (F.avg("m") - 1.96 * sd).alias("low"), (F.avg("m") + 1.96 * sd).alias("high"))
