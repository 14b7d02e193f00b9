"""Queries for source adapters, document rules and what is left of the job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.operators import sequential as S
from loamline.plans.queries import Query, table
from loamline.plans import jobs as J
from loamline.functions import text as X
from loamline.operators import measure as M
from loamline.sources import adapters as A

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(rf"""
select doc_id, 'cot' as condition, source as instruction, {_STRIP.format("case when doc_id % 2 = 0 then lang || chr(10) || chr(10) || text else text end")} as response from documents where {_STRIP.format("text")} <> ''""")
def reasoned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, target and reasoning."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("prompt"), F.col("text").alias("target"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("reasoning"))
    return A.ADAPTERS["prompt_target"](d, "doc_id")


@query("select doc_id, 'direct' as condition, source || chr(10) || chr(10) || lang as instruction, 'a' || doc_id as response from documents where doc_id % 5 <> 0")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context, question and the first answer with text."""
    answers = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.lit(" "), F.concat(F.lit("a"), F.col("doc_id"))))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("context"), F.col("lang").alias("question"), answers.alias("answers"))
    return A.ADAPTERS["extractive_qa"](d, "doc_id")


@query(f"select doc_id, 'direct' as condition, source as instruction, {_STRIP.format('text')} as response from documents where {_STRIP.format('text')} <> ''")
def generic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known names of prompts and answers."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(" ").alias("prompt"), F.col("source").alias("question"), F.col("text").alias("output"))
    return A.ADAPTERS["generic"](d, "doc_id")


@query(rf"""
with d as (select doc_id, text as src, case when doc_id % 3 = 0 then text else text || '!' end as tgt, case doc_id % 2 when 0 then 'gec' else 'other' end as task from documents)
select doc_id, 'direct' as condition, {_STRIP.format("case task when 'gec' then 'Correct the text.' else 'Rewrite the text.' end || chr(10) || chr(10) || src")} as instruction, {_STRIP.format("tgt")} as response from d where {_STRIP.format("src")} <> {_STRIP.format("tgt")} and {_STRIP.format("tgt")} <> ''""")
def edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by task."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("src"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("tgt"), F.when(F.col("doc_id") % 2 == 0, "GEC").otherwise("other").alias("task"))
    return A.ADAPTERS["edit_pair"](d, {"gec": "Correct the text."}, "doc_id")


@query("""
select doc_id, 'direct' as condition, lang || chr(10) || chr(10) || source as instruction, 'first' as response from documents union all
select doc_id, 'direct', lang || chr(10) || chr(10) || source, '[''first'', ''second'']' from documents""")
def instruction_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with one target or a list of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("definition"), F.col("source").alias("inputs"), F.array(F.lit("first"), F.lit("second")).alias("targets"))
    return A.ADAPTERS["instruction_task"](d, "doc_id").unionByName(A.instruction_task(d, "doc_id", first=False))


@query(rf"select d.doc_id, 'cot' as condition, source as instruction, {_STRIP.format('text')} as response from documents d join labels l using (doc_id) where quality = 1 and toxic = 0 and {_STRIP.format('text')} <> ''")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose flags are all valid."""
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.select("doc_id", F.col("source").alias("problem"), F.col("text").alias("solution"), yes(F.col("quality") == 1).alias("problem_is_valid"), yes(F.col("toxic") == 0).alias("solution_is_valid"))
    return A.ADAPTERS["valid_math"](rows, "doc_id")


@query(rf"""
with h as (select doc_id, {_STRIP.format("substr(text, 1, 200)")} as head, {_STRIP.format("substr(text, 201)")} || repeat('z', 500) as tail from documents where length(text) > 400)
select doc_id, 'direct' as condition, {_STRIP.format("'Summarise:' || chr(10) || chr(10) || tail")} as instruction, head as response from h where length(head) >= 120""")
def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The abstract of a paper, and the rest."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 400)
    head, tail = X.strip(F.substring("text", 1, 200)), F.concat(X.strip(F.expr("substring(text, 201)")), F.lit("z" * 500))
    d = d.select("doc_id", F.concat(F.lit("Title\nAbstract: "), head, F.lit("\n\n"), tail).alias("t"))
    return A.ADAPTERS["abstract"](d, "t", "doc_id")


@query("""
with s as (select doc_id, text, case when length(text) * 2 <= 3000 then text when length(text) + length(lang) <= 3000 then lang else '' end as r from documents)
select doc_id, case when length(r) > 3 then 'long' else 'short' end as kind from s where trim(r) <> ''""")
def summary_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first summary that fits."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("full"), F.col("lang").alias("compact"))
    return A.ADAPTERS["summary_cascade"](d, "text", ["full", "compact"], 3000, "doc_id").select("doc_id", F.when(F.length("response") > 3, "long").otherwise("short").alias("kind"))


@query("select doc_id, 'math,mcq' as condition, source as instruction, lang as response, case doc_id % 3 when 0 then 'x' when 1 then 'y' else 'z' end as choice from documents")
def last_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last question of a text, and options by letter, number and text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Question: old Answer: no Question: "), "source", F.lit(" Answer: "), "lang").alias("t"), F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "1").otherwise(" Z").alias("answer"))
    choice = A.choice_text(F.array(*map(F.lit, "xyz")), F.col("answer"))
    return A.ADAPTERS["last_question"](d, "t", "doc_id").join(d.select("doc_id", choice.alias("choice")), "doc_id")


@query("""
select doc_id, case cast(('0x' || substr(md5('3|' || doc_id), 1, 13)) as bigint) % 2 when 0 then 'Read: ' || source else source || '?' end as instruction from documents""")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn template for each row (P20)."""
    return A.templated(table(spark, sf_dir, "documents"), ["Read: {text}", "{text}?"], 3, "doc_id", "source")


@query("""
with d as (select doc_id, source, source || '/d' || doc_id || '.md' as path, lang, n_chars from documents), f as (select distinct source from d)
select path, 'unknown type' as issue from d where lang not in ('en', 'de') union all select path, 'too large' from d where n_chars >= 900 union all select source, 'no index' from f where source in ('src1', 'src4')
union all select path, 'not listed' from d where source not in ('src1', 'src4') and doc_id % 3 = 0 union all select source || '/index.md', 'dead link' from f where source not in ('src1', 'src4')""")
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a bundle of documents in folders, two of them without index."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("source", F.lit("/d"), "doc_id", F.lit(".md")).alias("path"), F.col("lang").alias("kind"), F.col("n_chars").alias("size"))
    listed = d.filter(~F.col("source").isin("src1", "src4")).withColumn("index", F.concat("source", F.lit("/index.md")))
    index = listed.select("index").distinct()
    docs = d.select("path", "kind", "size").unionByName(index.select(F.col("index").alias("path"), F.lit(None).cast("string").alias("kind"), F.lit(10).alias("size")))
    links = listed.filter("doc_id % 3 <> 0").select(F.col("index").alias("source"), F.col("path").alias("target")).unionByName(index.select(F.col("index").alias("source"), F.replace("index", F.lit("index"), F.lit("gone")).alias("target")))
    return A.document_issues(docs, links, kinds=("en", "de"), most_bytes=900)


@query("select user_id % 5 as family, user_id as epoch, event_type as task, arg_max(event_id, (value, ts, event_id)) as path from events where value > 5 and event_id % 7 <> 0 group by 1, 2, 3")
def best_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best archive of each family, epoch and task."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("family"), F.col("user_id").alias("epoch"), F.col("event_type").alias("task"), F.col("event_id").alias("path"), F.col("value").alias("n"), F.col("ts").alias("mtime"), ((F.col("event_id") % 7 != 0) & (F.col("value") > 5)).alias("complete"))
    return A.archive_choice(e)


@query("""
with k as (select event_id, event_id % 4 as dialect, event_type, user_id from events)
select event_id, 0::bigint as idx, 'get_' || event_type as name, '{"k": ' || user_id || '}' as arguments from k where dialect = 0
union all select event_id, 0, 'run.' || event_type, '{"a": ' || user_id || ', "b": "x, y"}' from k where dialect = 1 union all select event_id, 1, 'run.' || event_type || '_2', '{}' from k where dialect = 1
union all select event_id, 0, 'tool_' || user_id || '_' || event_type, '{"value": "plain"}' from k where dialect = 2""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of tools in several dialects, with names that can be used; prose has none."""
    kind = F.col("event_id") % 4
    as_object = F.format_string('So be it: {"name": "get %s", "arguments": {"k": %d}}', "event_type", "user_id")
    as_python = F.format_string("[run.%s(b='x, y', a=%d), run.%s()]", "event_type", "user_id", "event_type")
    as_text = F.format_string('{"name": "%d %s", "parameters": "plain"}', "user_id", "event_type")
    text = F.when(kind == 0, as_object).when(kind == 1, as_python).when(kind == 2, as_text).otherwise(F.concat(F.lit("no call of "), "event_type"))

    def calls(_, t):
        found = S.parse_calls(t)
        return list(zip(S.unique_names([n for n, _ in found]), (a for _, a in found)))

    return S.each_text(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "event_id", "text", calls, "name string, arguments string")


@query("select event_type || '/a_b' as key, value from (select event_type, round(avg(value), 6) as value from events group by 1)")
def nested_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in nested objects."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    j = e.select(F.to_json(F.create_map(F.col("event_type"), F.create_map(F.lit("a b"), F.col("v")))).alias("json"), F.lit(1).alias("id"))
    import json

    return S.each_text(j, "id", "json", lambda _, t: S.named_numbers(json.loads(t)), "key string, value double").select("key", "value")


@query("select source, count(*) - count(distinct text) as duplicates, count(*) filter (n_chars < 200) as short, case when count(*) > count(distinct text) or count(*) filter (n_chars < 200) > 5 then 'ERROR' else 'OK' end as state from documents group by source")
def shard_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates and faults of generated shards."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg((F.count("*") - F.count_distinct("text")).alias("duplicates"), F.count_if(F.col("n_chars") < 200).alias("short"))
    return d.withColumn("state", F.when((F.col("duplicates") > 0) | (F.col("short") > 5), "ERROR").otherwise("OK"))


@query("select event_type, round(sum(value) / count(*), 6) as ratio from events group by event_type")
def reduced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and divisors of ranks added, then divided."""
    ranks = table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 4).alias("rank")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return ranks.groupBy("event_type").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("ratio"))


@query("select p_partkey, (p_partkey + 3) // 4 as own, case when p_size = 0 then null else round((100 - p_size) * 60.0 / p_size, 6) end as eta from part")
def shard_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a shard and time left at the rate so far."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", J.shard_total(F.col("p_partkey"), F.lit(0), F.lit(4)).alias("own"), F.round(J.eta(F.col("p_size"), F.lit(60.0), 100 - F.col("p_size")), 6).alias("eta"))


@query("""
with recursive q as (select p_brand as brand, p_size::double as s, row_number() over (partition by p_brand order by p_partkey) as i from part),
lanes as (select distinct brand, 0::bigint as i, [0.0::double, 0.0::double, 20.0::double] as loads from q
  union all select q.brand, q.i, list_sort([loads[1] + s, loads[2], loads[3]]) from lanes join q on q.brand = lanes.brand and q.i = lanes.i + 1)
select brand, max(i) as n, arg_max(loads[3], i) as finish from lanes group by brand""")
def lane_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the queued jobs of each plan end on the least loaded of three lanes, one of them busy."""
    return M.lane_finishes(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "brand"), ["brand"], "p_partkey", "p_size", [20.0], 3)


@query()
def masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with drops by context hash (X11)."""
    import numpy as np

    def drops(_, text):
        ids = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        return [(int((S.goldfish_mask(ids, ids, np.array([0]), 4, 8, 123) == -100).sum()), len(ids))]

    return S.each_text(table(spark, sf_dir, "documents"), "doc_id", "text", drops, "dropped long, n long").drop("idx")
