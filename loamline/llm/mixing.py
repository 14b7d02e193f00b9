"""Mixing sources to target weights by temperature (op 3), in DataFrame functions alone.

A source's share ``p`` of all tokens (words between ASCII white space) is raised to an exponent and normalised,
``w = p^a / sum(p^a)``.  The exponent is bisected, between 0 (equal weights) and 1 (shares as they are): to the target
entropy ``H(p) + entropy * (ln(sources) - H(p))``, or to the least exponent at which no source is repeated more than
``repeats`` times; with both, the greater exponent holds.  Each bisection job evaluates the sums for 15 exponents at once, which is four halvings.

The budget is ``budget`` tokens (default: all there are), or with ``cover`` the least with which no source is cut short.
A source's quota is ``w * budget``: whole passes over its documents, and the rest as a part of one more pass.  In each pass
a source's blocks (documents by hash; about ``block_tokens`` tokens, ``most_blocks`` blocks a source at most) stand in a permutation seeded by source
and pass.  The last pass takes blocks in this order while the tokens before are under the rest; the block in which it ends is taken document by document,
in the order of a seeded hash, so a quota is overshot by less than one document.

Words are counted once, into a narrow table.  What follows shuffles counts by source and block; documents meet the small tables by source and by block
in joins (a hot source has many blocks, and a skewed side can be split).

Rules: null sources are one source; documents without words go with their block; a source without any words has weight zero,
and with ``cover`` one pass; null texts have no words; repeated rows and equal hashes stay together (they are taken or left alike), as do rows with a null id of one source;
a very long text is one row, held whole in the JVM; an empty table gives no rows; other columns come back as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.shared import cut, named, packed, small, unpacked

SEED = "mix-1"


def words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^ \t\n\x0b\f\r]+", "x")
    return F.length(F.translate(squeezed, " \t\n\x0b\f\r", "")).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def exponent(shares: DataFrame, *, entropy: float | None, repeats: float | None, budget: float | None, total: int) -> float:
    """The exponent for source shares ``p`` (positive, of sum one); see the module."""

    def probe(points: list[float]) -> list[tuple[float, float]]:
        """For each exponent the entropy of the weights, and the most that a source is repeated."""
        z = [F.sum(F.pow("p", F.lit(a))) for a in points]
        u = [F.sum(F.pow("p", F.lit(a)) * F.ln("p")) for a in points]
        most = [F.max(F.pow("p", F.lit(a - 1))) for a in points]
        least = [F.min(F.pow("p", F.lit(a - 1))) for a in points]
        r = shares.agg(*z, *u, *most, *least).first()
        k = len(points)
        z, u, most, least = ([float(x) for x in r[i * k : (i + 1) * k]] for i in range(4))
        scale = [budget / total / z[i] if budget is not None else 1 / least[i] for i in range(k)]
        return [(math.log(z[i]) - points[i] * u[i] / z[i], most[i] * scale[i]) for i in range(k)]

    def least_that(holds, rounds: int = 10) -> float:
        lo, hi = 0.0, 1.0
        if holds(probe([0.0])[0]):
            return 0.0
        for _ in range(rounds):
            points = [lo + (hi - lo) * i / 16 for i in range(1, 16)]
            good = [i for i, x in enumerate(probe(points)) if holds(x)]
            lo, hi = (points[good[0] - 1] if good and good[0] else lo if good else points[-1], points[good[0]] if good else hi)
        return round(hi, 9)

    (h0, _), (h1, _) = probe([0.0, 1.0])
    found = [0.0] if repeats is not None or entropy is not None else [1.0]
    if entropy is not None:
        target = h1 + entropy * (h0 - h1)
        found.append(least_that(lambda x: x[0] <= target + 1e-12))
    if repeats is not None:
        found.append(least_that(lambda x: x[1] <= repeats + 1e-12))
    return max(found)


def plan(docs: DataFrame, *, entropy: float | None = 0.5, repeats: float | None = 2.0, budget: float | None = None, cover: bool = False, block_tokens: int = 250_000, most_blocks: int = 10_000, most_broadcast: int = 200_000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is taken: rows ``source, block, pass, block_rank, rest`` of blocks, and each document's block, hash and tokens.

    ``rest`` is null where a block is taken whole, else the tokens of it that are still wanted.
    """
    counted = cut(docs.select(named(source_col).alias("s"), _hash(named(source_col), named(id_col)).alias("_h"), words(named(text_col)).alias("_n")))
    sources = cut(counted.groupBy(F.col("s").alias("source")).agg(F.sum("_n").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not cover and budget is None:
        budget = float(total)
    shares = sources.filter("tokens > 0").select((F.col("tokens") / F.lit(float(total or 1))).alias("p"))
    a = exponent(shares, entropy=entropy, repeats=repeats, budget=None if cover else budget, total=total) if total else 1.0
    p = F.col("tokens") / F.lit(float(total or 1))
    powered = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a))).otherwise(0.0)
    z, least = sources.agg(F.sum(powered), F.min(F.when(F.col("tokens") > 0, powered / F.col("tokens")))).first()
    spend = 1 / least if cover and least else (budget or 0.0) / (z or 1.0)  # tokens for each unit of p^a
    quota = F.floor(powered * spend + 1e-6).cast("long")
    blocks_of = F.least(F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)), F.lit(most_blocks)).cast("long")
    passes = F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(1 if cover else 0).cast("int")
    rest = F.when(F.col("tokens") > 0, quota - passes * F.col("tokens")).otherwise(0)
    budgets = small(sources.select("source", blocks_of.alias("blocks"), passes.alias("passes"), rest.alias("rest")), most_broadcast)
    placed = counted.join(budgets, F.col("s").eqNullSafe(F.col("source"))).withColumn("block", _number(F.col("_h")) % F.col("blocks"))
    blocks = placed.groupBy("source", "passes", "rest", "block").agg(F.sum("_n").alias("n"))
    each = cut(blocks).select("*", F.explode(F.expr("sequence(0, passes)")).alias("pass"))
    rank = F.expr("row_number() over (partition by source, pass order by h, block)")
    before = F.expr("sum(n) over (partition by source, pass order by h, block rows between unbounded preceding and current row) - n")
    ranked = each.withColumn("h", _hash(F.col("source"), F.col("pass"), F.col("block"))).select("*", rank.alias("block_rank"), before.alias("before"))
    taken = ranked.filter("pass < passes or before < rest").select("source", "block", "pass", "block_rank", F.expr("case when pass = passes and before + n > rest then rest - before end").alias("rest"))
    return cut(taken), placed.select("source", "block", "blocks", "_h", "_n")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", columns: list[str] | None = None, most_broadcast: int = 200_000, passes: bool = True, **options) -> DataFrame:
    """The documents of the mixture (``columns``, default all), each as often as it is taken, with ``pass`` and ``block_rank`` if ``passes``.

    The tables by source and by block are broadcast if they have ``most_broadcast`` rows at most, else joined.
    """
    columns = docs.columns if columns is None else columns
    taken, placed = plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, most_broadcast=most_broadcast, **options)
    ends = taken.filter("rest is not null").select(F.col("source").alias("s"), F.col("block").alias("b"), "rest")  # one block of each source at most
    order = placed.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).groupBy("s", "rest", "_h").agg(F.sum("_n").alias("_n"))
    before = order.selectExpr("s", "_h", "rest", "sum(_n) over (partition by s order by _h rows between unbounded preceding and current row) - _n as before")
    last = before.filter("before < rest").groupBy("s").agg(F.max("_h").alias("_until"))  # the hash up to which the block is taken
    blocks = placed.groupBy("source").agg(F.max("blocks").alias("_blocks"))
    sized = blocks.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("_s"), "_blocks", "_until")
    chosen = small(taken.join(sized, F.col("source").eqNullSafe(F.col("_s"))).select("_s", F.col("block").alias("_b"), F.col("pass").alias("_pass"), F.col("block_rank").alias("_rank"), F.when(F.col("rest").isNotNull(), F.coalesce("_until", F.lit(""))).alias("_until")), most_broadcast)
    sized = small(sized, most_broadcast)
    rows = packed(docs.select(*[named(c) for c in columns]) if set(columns) >= {id_col, source_col} else docs, _of=named(source_col), _h=_hash(named(source_col), named(id_col)))
    keyed = rows.join(sized.select(F.col("_s").alias("_whose"), "_blocks"), F.col("_of").eqNullSafe(F.col("_whose"))).withColumn("_block", _number(F.col("_h")) % F.col("_blocks"))
    met = keyed.join(chosen, F.col("_of").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")) & (F.col("_until").isNull() | (F.col("_h") <= F.col("_until"))))
    return unpacked(met, columns, *([F.col("_pass").alias("pass"), F.col("_rank").alias("block_rank")] if passes else []))


SQL = r"""
with recursive counted as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) as n,
    md5('mix-1|' || coalesce(source, '') || '|' || coalesce(cast(doc_id as varchar), '')) as h from documents),
sources as (select source, sum(n) as tokens from counted group by source),
total as (select sum(tokens) as t, count(*) filter (tokens > 0) as k from sources),
shares as (select tokens / cast(t as double) as p from sources, total where tokens > 0),
ends as (select ln(count(*)) as h0, -sum(p * ln(p)) as h1, list(p) as ps from shares),
halves(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when good then lo else mid end, case when good then mid else hi end
  from (select i, lo, hi, mid, ln(z) - mid * u / z <= target + 1e-12 as good
    from (select i, lo, hi, (lo + hi) / 2 as mid, h1 + 0.5 * (h0 - h1) as target,
        list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) as z, list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p))) as u
      from halves, ends where i < 40))),
limits(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when good then lo else mid end, case when good then mid else hi end
  from (select i, lo, hi, mid, most / z <= 2.0 + 1e-12 as good
    from (select i, lo, hi, (lo + hi) / 2 as mid,
        list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) as z, list_max(list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1))) as most
      from limits, ends where i < 40))),
exponent as (
  select greatest(case when h0 <= h1 + 0.5 * (h0 - h1) + 1e-12 then 0 else (select round(hi, 9) from halves where i = 40) end,
    case when list_max(list_transform(ps, lambda p: 1 / p)) / len(ps) <= 2.0 + 1e-12 then 0 else (select round(hi, 9) from limits where i = 40) end) as a from ends),
powered as (select source, tokens, case when tokens > 0 then pow(tokens / cast(t as double), a) else 0.0 end as w, t from sources, total, exponent),
budgets as (
  select source, tokens, greatest(ceil(tokens / 250000), 1)::bigint as blocks, floor(w * (t / (select sum(w) from powered)) + 1e-6)::bigint as quota from powered),
passes as (select source, blocks, case when tokens > 0 then cast(quota // tokens as bigint) else 0 end as passes, case when tokens > 0 then quota % tokens else 0 end as rest from budgets),
placed as (
  select c.doc_id, c.source, n, h, passes, rest, ('0x' || substr(h, 1, 12))::bigint % blocks as block from counted c join passes p on c.source is not distinct from p.source),
blocks as (select source, passes, rest, block, sum(n) as n from placed group by all),
ranked as (
  select *, row_number() over w as block_rank, sum(n) over (w rows between unbounded preceding and current row) - n as before
  from (select *, unnest(range(cast(passes as bigint) + 1)) as pass from blocks)
  window w as (partition by source, pass order by md5('mix-1|' || coalesce(source, '') || '|' || pass || '|' || block), block)),
taken as (
  select source, block, pass, block_rank, case when pass = passes and before + n > rest then rest - before end as left_over from ranked where pass < passes or before < rest),
together as (
  select p.doc_id, p.source, pass, block_rank, left_over, h, p.n from placed p join taken t on p.source is not distinct from t.source and p.block = t.block),
cutoff as (
  select source, h, left_over, sum(n) over (partition by source order by h rows between unbounded preceding and current row) - n as before
  from (select source, h, left_over, sum(n) as n from together where left_over is not null group by all))
select doc_id, source, cast(pass as int) as pass, cast(block_rank as int) as block_rank from together where left_over is null
union all
select t.doc_id, t.source, cast(pass as int), cast(block_rank as int) from together t semi join (select * from cutoff where before < left_over) k on t.source is not distinct from k.source and t.h = k.h
where left_over is not null
"""
