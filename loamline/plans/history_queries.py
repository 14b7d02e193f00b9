"""Queries for histories, plug-ins, manifests and the joins and ranks that round off the set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.operators import history as Hs
from loamline.plans import jobs as J
from loamline.plans.queries import Query, table
from loamline.shared import fresh_path
from loamline.sources import sinks

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_LONG = "select event_id as step, event_id % 10 / 4.0 as epoch, case when user_id % 2 = 0 then 'eval/' else 'train/' end || event_type as key, value from events"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("step"), (F.col("event_id") % 10 / 4.0).alias("epoch"), F.concat(F.when(F.col("user_id") % 2 == 0, "eval/").otherwise("train/"), "event_type").alias("key"), "value")


@query(f"""
with h as ({_LONG}) select step, epoch, key, value from h where not ((step = 41 or abs(epoch - 0.25) <= 1e-12) and starts_with(key, 'eval/'))
union all select 41, 0.25, 'eval/new', 1.5""")
def replaced_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows of a step and epoch replaced."""
    fresh = spark.createDataFrame([("eval/new", 1.5)], "key string, value double")
    return Hs.with_replacement(_long(spark, sf_dir), fresh, step=41, epoch=0.25, prefixes=["eval/"])


@query(f"""
with h as ({_LONG}) select step, key, value from h where not starts_with(key, 'eval/') and step % 3 <> 0 union all select step, key, value * 2 from h where starts_with(key, 'eval/') and not starts_with(key, 'eval/view')""")
def spliced_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of one run with evaluation rows of another."""
    h = _long(spark, sf_dir)
    return Hs.spliced(h.filter("step % 3 <> 0"), h.withColumn("value", F.col("value") * 2), evals=["eval/"], drop=["eval/view"])


@query(f"with h as ({_LONG}) select step, case when starts_with(key, 'eval/') then 'test/' || substr(key, 6) else 'fit/' || substr(key, 7) end as key, value from h where not contains(key, 'click') and not isnan(value) and not isinf(value)")
def renamed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two histories in one, finite, renamed, without marked keys."""
    h = _long(spark, sf_dir).select("step", "key", "value")
    both = Hs.appended(h.filter("step % 2 = 0"), h.filter("step % 2 = 1"), "click")
    return Hs.renamed(Hs.finite_rows(both), [("eval/", "test/"), ("train/", "fit/")], strict=True)


@query("select user_id, coalesce(case when user_id % 3 = 0 then event_id end, case when user_id % 3 = 1 then user_id end, 7) as step from events")
def axis_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first axis that has a value."""
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("user_id") % 3 == 0, F.col("event_id")).alias("a"), F.when(F.col("user_id") % 3 == 1, F.col("user_id")).alias("b"), F.lit(7).alias("c"))
    return Hs.steps_of(e, ["a", "b", "c"]).select("user_id", "step")


@query("select doc_id from documents where n_chars > 500 and doc_id not in (select doc_id from labels)")
def newly_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete files without a marker."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).alias("complete"))
    return Hs.newly_complete(d, table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("select doc_id, source as campaign_source, 'c1' as campaign, lang as kind from documents")
def joined_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards in one table, with a nested field renamed and one set."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("source").alias("old"), "lang").alias("s"))
    both = d.filter("doc_id % 2 = 0").unionByName(d.filter("doc_id % 2 = 1"))
    out = Hs.renamed_field(both, "s", "old", "source", {"campaign": F.lit("c1")})
    return out.select("doc_id", F.col("s.source").alias("campaign_source"), F.col("s.campaign").alias("campaign"), F.col("s.lang").alias("kind"))


@query("select sha256(string_agg(r_name || chr(10), '' order by r_name)) as sha256, count(*) as rows from region")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum and rows of a written file."""
    path = fresh_path(spark, "manifest")
    names = table(spark, sf_dir, "region").agg(F.array_join(F.array_sort(F.collect_list("r_name")), "\n").alias("value"))
    names.write.text(path)
    return sinks.checksums(spark, f"{path}/part-*").filter("length > 0").select("sha256", F.col("rows").cast("long").alias("rows"))


@query("select '## Regions' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || (select string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) order by r_regionkey) from region) || chr(10) as report")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as a Markdown table."""
    text = sinks.report(table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_regionkey", "r_name"), "Regions")
    return spark.createDataFrame([(text,)], "report string")


@query("select p_partkey, n_name from part join (select n_name, n_nationkey * 70 as lo, n_nationkey * 70 + 100 as hi from nation) r on p_partkey >= lo and p_partkey < hi")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in ranges, by blocks."""
    ranges = table(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") * 70).alias("lo"), (F.col("n_nationkey") * 70 + 100).alias("hi"))
    return Hs.within(table(spark, sf_dir, "part").select("p_partkey"), ranges, "p_partkey", "lo", "hi", 64).select("p_partkey", "n_name")


@query("""
with p as (select user_id, event_id from events where event_id % 2 = 0), s as (select user_id, event_id, value from events where event_id % 2 = 1)
select p.user_id, p.event_id, s.value from p asof left join s on p.user_id = s.user_id and p.event_id >= s.event_id""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state at or before each point."""
    e = table(spark, sf_dir, "events")
    return Hs.as_of(e.filter("event_id % 2 = 0").select("user_id", "event_id"), e.filter("event_id % 2 = 1").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("""
select p_partkey, rank() over w as r, dense_rank() over w as d, ntile(4) over (partition by p_brand order by p_size, p_partkey) as q, lead(p_partkey) over (partition by p_brand order by p_size, p_partkey) as next
from part window w as (partition by p_brand order by p_size)""")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, dense rank, quartile and lead."""
    w, u = Window.partitionBy("p_brand").orderBy("p_size"), Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(u).cast("long").alias("q"), F.lead("p_partkey").over(u).alias("next"))


@query("select event_id, event_type, (row_number() over (partition by event_type order by event_id) - 1) // 16 as block from events")
def request_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that go together, in blocks."""
    return Hs.blocks(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"], "event_id", 16)


@query("select 'parts' as benchmark, count(*) as n, round(avg(case when p_partkey % 4 = 0 then 0.0 else 1 end), 9) as accuracy from part")
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark found by name, answered by a client, and measured."""
    found = J.Registry()

    @found.register("parts")
    class Parts(J.Benchmark):
        settings = {"wrong": 4}

        def prompts(self) -> DataFrame:
            return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_partkey").cast("string").alias("prompt"), F.col("p_partkey").cast("string").alias("truth"))

        def metrics(self, answered: DataFrame) -> DataFrame:
            return answered.agg(F.count("*").alias("n"), F.round(F.avg((F.col("generation") == F.col("truth")).cast("double")), 9).alias("accuracy"))

    bench = found["parts"]()
    wrong = bench.options()["wrong"]
    return bench.metrics(J.generate(bench.prompts(), lambda texts: ["" if int(t) % wrong == 0 else t for t in texts])).select(F.lit("parts").alias("benchmark"), "n", "accuracy")
