"""Joins, set operations, samples, caps and budgets over corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import hashing as H
from loamline.functions import text as X
from loamline.operators.running import running_sum
from loamline.shared import small


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; it is enough that one list has it."""
    return df.join(ids.select(key), key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed."""
    return df.join(ids.select(key), key, "left_anti")


def content_key(*columns: str) -> Column:
    """SHA-1 of the columns as canonical JSON."""
    return F.sha1(F.to_json(F.struct(*columns)))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest ``order`` for each key, by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least ``order`` for each key, by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def superseded_union(base: DataFrame, newer: DataFrame, key: str, replaces: str) -> DataFrame:
    """Base rows that no newer row replaces, and the newer rows."""
    gone = newer.select(F.col(replaces).alias(key))
    return base.join(gone, key, "left_anti").unionByName(newer.drop(replaces))


def union_base_wins(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Base rows, and extra rows under keys that the base doesn't have."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti"))


def union_or_fail(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows; a key that occurs twice is an error, found by a count of keys before any row is given."""
    out = reduce(DataFrame.unionByName, parts)
    if twice := duplicate_ids(out.select(key), key).take(1):
        raise ValueError(f"key occurs twice: {twice[0][0]}")
    return out


def union_alike(parts: list[tuple[DataFrame, dict]], key: str) -> DataFrame:
    """``union_or_fail`` of parts that were made with the same tokenizer: what describes it must be equal."""
    infos = [info for _, info in parts]
    if any(info != infos[0] for info in infos):
        raise ValueError("the parts were made with different tokenizers")
    return union_or_fail([p for p, _ in parts], key)


def clean_rows(df: DataFrame, bad: Column) -> DataFrame:
    """Every distinct row once, without the bad ones; a row in which ``bad`` can't be told is kept."""
    return df.dropDuplicates().filter(~F.coalesce(bad, F.lit(False)))


def reorder(df: DataFrame, key: str, order: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows with the place that an external list gives their key; unlisted keys get none."""
    return df.join(order.select(key, pos), key, "left")


def prefix_rule(df: DataFrame, name: str, rules: list[tuple[str, int]], default: int) -> DataFrame:
    """``rule_pos, repeat`` of the first rule whose prefix a name has."""
    pos, repeat = F.lit(-1), F.lit(default)
    for i, (prefix, value) in reversed(list(enumerate(rules))):
        hit = F.col(name).startswith(prefix)
        pos, repeat = F.when(hit, i).otherwise(pos), F.when(hit, value).otherwise(repeat)
    return df.withColumn("rule_pos", pos).withColumn("repeat", repeat)


def key_difference(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """shared, changed, missing or new for each key of two tables."""
    both = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_ina")).join(b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_inb")), key, "full_outer")
    state = F.when(F.col("_inb").isNull(), "missing").when(F.col("_ina").isNull(), "new").when(F.abs(F.col("_a") - F.col("_b")) > tolerance, "changed").otherwise("shared")
    return both.select(key, F.col("_a").alias("before"), F.col("_b").alias("after"), state.alias("state"))


def shots(dev: DataFrame, target: DataFrame, subject: str, order: str, text: str, k: int) -> DataFrame:
    """Target rows with the first ``k`` development texts of their subject in front."""
    rank = F.row_number().over(Window.partitionBy(subject).orderBy(order))
    few = dev.withColumn("_k", rank).filter(F.col("_k") <= k).groupBy(subject).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", text))), lambda r: r[text]), "\n\n").alias("shots"))
    return target.join(few, subject, "left")


def gram_matches(left: DataFrame, left_key: str, right: DataFrame, right_key: str, grams: str = "grams") -> DataFrame:
    """Pairs that share n-grams, and how many, by an equi-join on the grams; each side has an array of distinct ones."""
    # explode_outer: in front of explode a filter is put that computes the array again, twice; the join drops nulls
    a = left.select(left_key, F.explode_outer(grams).alias("_g"))
    b = right.select(right_key, F.explode_outer(grams).alias("_g"))
    return a.join(b, "_g").groupBy(left_key, right_key).agg(F.count("*").alias("shared"))


def text_matches(left: DataFrame, left_key: str, right: DataFrame, right_key: str, text: str, n: int) -> DataFrame:
    """``gram_matches`` of texts, where ``right`` has few of the grams: rows of ``left`` without the hash of any of its grams never have their grams made."""
    hashes = lambda df, key: df.select(key, F.explode_outer(X.gram_hashes(X.words(F.col(text)), n)).alias("_h"))
    known = small(hashes(right, right_key).select("_h").distinct(), 2_000_000)
    near = hashes(left, left_key).join(known, "_h", "left_semi").select(left_key).distinct()
    grams = lambda df: df.withColumn("grams", X.ngrams(X.words(F.col(text)), n))
    return gram_matches(grams(left.join(near, left_key, "left_semi")), left_key, grams(right), right_key)


def cap(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of each group with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def proportional_cap(df: DataFrame, file: str, order: str, target: int, files: int) -> DataFrame:
    """At most ceil(target / files) rows of a file, and ``target`` rows in all, in the order of file and row."""
    per_file = cap(df, [file], [F.col(order)], -(-target // files))
    return per_file.orderBy(file, order).limit(target)


def prefix_budget(df: DataFrame, by: list[str], order: list[str], length: str, target: int) -> DataFrame:
    """The smallest prefix of each group whose lengths reach ``target``, one row at least."""
    out = running_sum(df, by, order, F.col(length), "_upto")
    return out.filter(F.col("_upto") - F.col(length) < target).drop("_upto") if target > 0 else cap(df, by, [F.col(c) for c in order], 1)


def budget_passes(df: DataFrame, by: list[str], order: list[str], length: str, target: int, repeat: int) -> DataFrame:
    """Rows of up to ``repeat`` passes, while the tokens before are at most ``target`` (overshoots by a row); ``pass``."""
    passes = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("pass"))
    return running_sum(passes, by, ["pass", *order], F.col(length), "_upto").filter(F.col("_upto") - F.col(length) <= target).drop("_upto")


def evenly_spaced(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """``k`` rows of each group at round(i * last / (k - 1)), halves to even; all of a smaller group."""
    sizes = small(df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("_n")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    rows = running_sum(df, by, order, F.lit(1), "_upto").join(sizes, same).withColumn("_i", F.col("_upto") - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / float(max(1, k - 1))).cast("int"))
    return rows.filter((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i").cast("int"))).select(*df.columns)


def cyclic(requests: DataFrame, index: str, seeds: DataFrame, position: str, n: int) -> DataFrame:
    """Request i uses seed i mod n."""
    return requests.withColumn("_p", (F.col(index) % n).cast("long")).join(seeds.withColumn("_p", F.col(position).cast("long")), "_p").drop("_p")


def byte_shards(df: DataFrame, order: str, text: str, shards: int) -> DataFrame:
    """Shard of each row by the bytes in front of it, ``shards`` at most."""
    size = F.octet_length(text) + 1
    share = max(1, (df.agg(F.sum(size)).first()[0] or 1) // shards)
    out = running_sum(df.withColumn("_size", size), [], [order], F.col("_size"), "_upto")
    return out.withColumn("shard", F.least(F.floor((F.col("_upto") - F.col("_size")) / share), F.lit(shards - 1)).cast("int")).drop("_upto", "_size")


def row_shards(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Consecutive blocks of ``rows`` rows."""
    return running_sum(df, [], [order], F.lit(1), "_k").withColumn("shard", F.floor((F.col("_k") - 1) / rows).cast("int")).drop("_k")


def sample(df: DataFrame, rate: float, seed: int, *key: str) -> DataFrame:
    return df.filter(H.sampled(rate, seed, *[F.col(k) for k in key]))


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """A deterministic permutation by hash: ``place`` within the whole is left to whoever needs it."""
    return df.withColumn("order_key", H.digest(seed, *[F.col(k) for k in key]))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def product(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """Every pair of two short lists, ``n`` times; ``i``."""
    return left.join(right).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
