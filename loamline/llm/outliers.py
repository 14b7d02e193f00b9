"""Robust multivariate outliers among documents (op 1), in DataFrame functions alone.

Base statistics of whole texts: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, and two plain limits (``base_failed``).

The statistics are transformed into a vector of ``DIMS`` numbers that hardly depend on length: log mean word length, and square
roots of symbols by words, duplicate lines by words, and repeated words by words.  For each language and source the centre and scatter of
these vectors are estimated by minimum covariance determinant.  Concentration steps, each keeping the ``share`` of the group with the smallest Mahalanobis
distances and taking mean and covariance of these anew, go on until no determinant moves any more, from three starts: coordinate-wise medians and
spreads; the rows of the central box; all rows.  The end with the least determinant is the estimate.
The scatter is made consistent for the normal distribution, and regularised by a floor on each variance, for most texts have no symbols
at all.  A document is rejected when its squared distance exceeds ``limit`` (about the 0.99995 quantile of chi-squared with four degrees of freedom).

Groups with fewer than ``least`` documents that pass the base limits are too small for an estimate of their own: they are estimated together by language, small
languages all together.
Means and products are sums (combined before the shuffle); quantiles are approximate ones (mergeable too); so no group
meets in one task; what joins back to documents is a row for each group, broadcast if there are 200,000 at most, else joined.

Rules: a null text has no words and fails the base limits, as does any text of under 50 words; null languages and sources are groups of
their own; with nothing to estimate from, documents are judged by the base limits alone; repeated rows count each; a very long text is one row, held whole in the JVM with a
struct for each word; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.shared import cut, small

DIMS = 4
#: Least variances of the transformed statistics.
FLOORS = (0.08**2, 0.10**2, 0.10**2, 0.25**2)
#: Starts of the concentration steps: medians and spreads, the central box, all rows.
STARTS = ("spread", "box", "all")
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeated(text: Column) -> Column:
    """Words and, of these, how many lie in 3-word windows that occur twice or more: a struct (n, r)."""

    def count(w: Column) -> Column:
        windows = F.zip_with(F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.struct(a, b)), F.slice(w, 3, 1 << 30), lambda ab, c: F.xxhash64(ab, c))
        keyed = F.transform(F.slice(windows, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def covered(s: Column) -> Column:
            twice = F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
            # a window covers three words; of two overlapping ones each word counts once
            return _let(F.array_sort(twice), lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"]))

        covered_words = F.when(F.size(w) >= 4, _let(F.array_sort(keyed), covered)).otherwise(0)
        return F.struct(F.size(w).cast("long").alias("n"), covered_words.cast("long").alias("r"))

    return _let(F.filter(F.split(text, "[ \t\n\x0b\f\r]+"), lambda x: x != ""), count)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang, source`` and the base statistics."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, SPACE, "")
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), _repeated(text).alias("w"), F.length(bare).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines")).select(
        *keep, "doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    """The vector, from the base statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.ln((F.col("word_chars") + 1) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def _cholesky(cov: dict[tuple[int, int], Column]) -> list[tuple[str, Column]]:
    """Columns of the inverse of the lower factor's diagonal (``r{i}``) and its other entries (``l{i}{j}``), each by those before it."""
    out = []
    for i in range(DIMS):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out.append((f"r{i}", 1 / F.sqrt(F.greatest(rest, F.lit(FLOORS[i] / 100)))) if i == j else (f"l{i}{j}", rest * F.col(f"r{j}")))
    return out


def distance() -> Column:
    """Squared Mahalanobis distance of ``x0..`` from centre ``m0..`` with factor ``l, r`` in the same row."""
    z: list[Column] = []
    for i in range(DIMS):
        value = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * z[j]
        z.append(value * F.col(f"r{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


_MODEL = [f"m{i}" for i in range(DIMS)] + [f"l{i}{j}" for i in range(DIMS) for j in range(i)] + [f"r{i}" for i in range(DIMS)]


def _factored(moments: DataFrame, scale: Column) -> DataFrame:
    """Group, start, centre, factor and log determinant from means ``m``, covariances ``c``; the variances have their floors."""
    cov = {(i, j): F.col(f"c{i}{j}") * scale + (FLOORS[i] if i == j else 0) for i in range(DIMS) for j in range(i + 1)}
    out = moments
    for name, value in _cholesky(cov):
        out = out.withColumn(name, value)
    logdet = sum((-2 * F.ln(f"r{i}") for i in range(1, DIMS)), -2 * F.ln("r0"))
    return out.select("grp", "start", *_MODEL, logdet.alias("logdet"))


def _moments(rows: DataFrame) -> DataFrame:
    """Means and covariances of ``x0..`` by group and start."""
    pairs = [(i, j) for i in range(DIMS) for j in range(i + 1)]
    return rows.groupBy("grp", "start").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMS)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in pairs])


def _starts(vectors: DataFrame, accuracy: int) -> DataFrame:
    """The first models of each group, a row for each start."""
    middle = small(vectors.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy).alias(f"q{i}") for i in range(DIMS)]))
    spread = [(F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 for i in range(DIMS)]
    zero = [(F.pow(spread[i], 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)]
    first = _factored(middle.select("grp", F.lit(STARTS[0]).alias("start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(DIMS)], *zero), F.lit(1.0))
    inside = F.lit(True)
    for i in range(DIMS):
        inside = inside & (F.abs(F.col(f"x{i}") - F.col(f"q{i}")[1]) <= 1.5 * spread[i] + FLOORS[i] ** 0.5)
    box = F.explode(F.when(inside, F.array(F.lit(STARTS[1]), F.lit(STARTS[2]))).otherwise(F.array(F.lit(STARTS[2]))))
    rest = vectors.join(middle, "grp").select("grp", *[f"x{i}" for i in range(DIMS)], box.alias("start"))
    return first.unionByName(_factored(_moments(rest), F.lit(1.0)))


def estimates(vectors: DataFrame, *, share: float = 0.75, most_steps: int = 30, settled: float = 1e-3, accuracy: int = 2000) -> DataFrame:
    """``grp``, centre, factored scatter and ``logdet`` of each group of ``x0..`` by minimum covariance determinant.

    The steps end when no log determinant moves by more than ``settled``; that one number comes to the driver.
    """
    model = small(_starts(vectors, accuracy))
    for _ in range(most_steps):
        near = vectors.join(model, "grp").select("grp", "start", *[f"x{i}" for i in range(DIMS)], distance().alias("d"))
        ends = small(near.groupBy("grp", "start").agg(F.percentile_approx("d", share, accuracy).alias("end")))
        # a normal sample cut to its central part has this much of its variance (chi-squared with four degrees of freedom)
        new = small(_factored(_moments(near.join(ends, ["grp", "start"]).filter("d <= end")), F.lit(1 / CENTRAL[share])))
        moved = new.join(model.select("grp", "start", F.col("logdet").alias("was")), ["grp", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        model = new
        if moved is None or moved <= settled:
            break
    return model.groupBy("grp").agg(F.min_by(F.struct(*_MODEL, "logdet"), F.struct(F.round("logdet", 6), "start")).alias("m")).select("grp", "m.*")


def _central(share: float) -> float:
    """P(chi2 with 6 degrees < q) / share, where P(chi2 with 4 degrees < q) = share; by bisection of the closed forms."""
    import math

    lo, hi = 0.0, 100.0
    for _ in range(80):
        q = (lo + hi) / 2
        lo, hi = (q, hi) if 1 - math.exp(-q / 2) * (1 + q / 2) < share else (lo, q)
    return (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8)) / share


CENTRAL = {s / 100: _central(s / 100) for s in range(50, 100)}


def judge(docs: DataFrame, *, least: int = 60, share: float = 0.75, limit: float = 25.0, **columns: str) -> DataFrame:
    """``doc_id``, base statistics, ``base_failed``, ``distance`` and ``kept`` of each document."""
    stats = cut(statistics(docs, **columns).withColumn("base_failed", base_failed()))
    fit = stats.filter("not base_failed")
    sizes = fit.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = sizes.groupBy("lang").agg(F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).alias("small"))
    own = F.concat_ws("|", F.lit("s"), F.to_json(F.array("lang", "source")))
    grp = F.when(F.col("n") >= least, own).when(F.col("small") >= least, F.concat_ws("|", F.lit("l"), F.to_json(F.array("lang")))).otherwise("all")
    groups = small(sizes.join(langs.withColumnRenamed("lang", "lang2"), F.col("lang").eqNullSafe(F.col("lang2"))).select(F.col("lang").alias("lang2"), F.col("source").alias("source2"), grp.alias("grp")))
    same = F.col("lang").eqNullSafe(F.col("lang2")) & F.col("source").eqNullSafe(F.col("source2"))
    vectors = fit.join(groups, same).select("grp", *[c.alias(f"x{i}") for i, c in enumerate(transformed())])
    model = estimates(cut(vectors), share=share)
    known = small(groups.join(model, "grp").drop("grp"))
    x = stats.select("*", *[c.alias(f"x{i}") for i, c in enumerate(transformed())]).join(known, same, "left")
    out = x.withColumn("distance", F.when(~F.col("base_failed"), distance()))
    rejected = F.coalesce(F.col("distance") > limit, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & ~rejected).alias("kept"))
