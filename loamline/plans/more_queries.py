"""Queries for the operators that work in sequence, on files, on job tables and on streams."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import text as X
from loamline.operators import curate as C
from loamline.operators import sequential as S
from loamline.plans import jobs as J
from loamline.plans.queries import Query, table
from loamline.shared import fresh_path
from loamline.sources import files, sinks
from loamline.streaming import events as E

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def boundary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at sentences."""
    return S.boundary_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1500)


@query()
def denoising_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denoising and span-filling tasks."""
    return S.text_tasks(table(spark, sf_dir, "documents"), "doc_id", "text", 3000)


@query()
def reorder_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph reordering; these texts have lines for paragraphs."""
    return S.reorder_tasks(table(spark, sf_dir, "documents"), "doc_id", "text", sep="\n", least_chars=40)


@query()
def multipack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each shard packed into lanes."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("shard"), F.least("n_chars", F.lit(4096)).alias("n"))
    return S.multipack(d, "shard", "doc_id", "n", lanes=2, capacity=8192)


@query()
def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic tokenised table, laid out for two epochs."""
    return sinks.sampled_dataset(S.random_rows(spark, 64, 5, 11, 512, 1), epochs=2, seed=1, context=17)


_TRIPLETS = "select 'direct' as condition, source as instruction, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as response from documents where trim(text) <> ''"


@query(_TRIPLETS)
def triplet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets written and read back by their schema."""
    path = fresh_path(spark, "triplets")
    sinks.write_triplets(table(spark, sf_dir, "documents").select(F.col("source").alias("instruction"), F.col("text").alias("response"), "lang"), path)
    return files.parquet_rows(spark, path)


@query("select source, lang as category, count(*) as n from (select source, lang, row_number() over (partition by source, lang order by doc_id) as k from documents) where k <= 3 group by 1, 2")
def category_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by category with caps, read back."""
    path = fresh_path(spark, "categories")
    sinks.write_categories(table(spark, sf_dir, "documents").select("source", "doc_id", F.col("lang").alias("category")), path, file="source", order="doc_id", most=3)
    return spark.read.parquet(path).groupBy("source", "category").agg(F.count("*").alias("n"))


@query("select count(*) as n, cast(sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as bigint) as chars from documents where trim(text) <> ''")
def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat lines, gzipped, read back strictly."""
    path = fresh_path(spark, "chat")
    sinks.write_chat(table(spark, sf_dir, "documents").select(F.col("source").alias("instruction"), F.col("text").alias("response")), path)
    m = files.json_lines(spark, path, "messages array<struct<role: string, content: string>>")
    return m.agg(F.count("*").alias("n"), F.sum(F.length(F.col("messages")[1]["content"])).alias("chars"))


@query("select 250::bigint as rows, 1::bigint as bad_lines".replace("250", "(select count(*) from events)"))
def lenient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that parse, and a count of those that don't."""
    path = fresh_path(spark, "lines")
    e = table(spark, sf_dir, "events").select("props").unionByName(spark.createDataFrame([("{broken",)], "props string"))
    e.write.text(path)
    good, bad = files.json_lines_lenient(spark, path, "k string, _x string")
    return good.agg(F.count("*").alias("rows")).select("rows", F.lit(bad.first()[0]).cast("long").alias("bad_lines"))


@query("select n_name as name, n_regionkey::varchar as region, row_number() over (order by n_name) - 1 as idx from nation")
def joined_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects over several lines, one behind another."""
    path = fresh_path(spark, "objects")
    n = table(spark, sf_dir, "nation")
    lines = n.select("n_name", F.format_string('{"name": "%s",\n "region": "%d"}', "n_name", "n_regionkey").alias("j"))
    lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "j"))), lambda r: r["j"]), "\n").alias("value")).write.text(path)
    return files.json_objects(spark, path).select(F.get_json_object("json", "$.name").alias("name"), F.get_json_object("json", "$.region").alias("region"), "idx")


@query("select n_name, cast(n_nationkey as varchar) as n_nationkey, nullif(case when n_regionkey = 1 then '' else 'r' end, '') as flag from nation")
def tab_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated text, blanks null."""
    path = fresh_path(spark, "tsv")
    n = table(spark, sf_dir, "nation").select("n_name", "n_nationkey", F.when(F.col("n_regionkey") == 1, "").otherwise("r").alias("flag"))
    n.write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return files.tsv(spark, path)


@query("""
with m as (select user_id, event_type as section, count(*) as n, max(value) as most from events group by 1, 2)
select user_id, section, 'n' as key, n::double as value from m union all select user_id, section, 'most', most from m where most < 180""")
def summary_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics out of text logs, one of each user, where values that are no finite numbers are left out."""
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    most = F.when(F.col("most") < 180, F.col("most").cast("string")).when(F.col("n") % 2 == 0, "nan").otherwise("none")
    part = F.concat(F.lit("--- "), "event_type", F.lit(" ---\nn....: "), "n", F.lit("\nmost..: "), most, F.lit("\nnote: two words\n"))
    logs = m.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(part)), "").alias("value"))
    return files.summary_metrics(logs, keep=["user_id"])


@query("""
select date_trunc('second', ts) as ts, ['START', 'END', 'FAILED', 'STOPPED'][event_id % 5 + 1] as action, event_type || event_id as job, case when event_id % 3 = 0 then '' else user_id % 8 || ',' || event_id % 8 end as gpus, case when event_id % 2 = 0 then '-' else user_id::varchar end as batch
from events where event_id % 5 < 4""")
def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of a status log with other lines between."""
    devices = F.when(F.col("event_id") % 3 == 0, "gpu_none").otherwise(F.concat(F.lit("gpu_"), F.col("user_id") % 8, F.lit(","), F.col("event_id") % 8))
    batch = F.when(F.col("event_id") % 2 == 0, "-").otherwise(F.col("user_id").cast("string"))
    action = F.get(F.array(*map(F.lit, ("START", "END", "FAILED", "STOPPED", "noise"))), (F.col("event_id") % 5).cast("int"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\t"), action, F.lit(" "), "event_type", "event_id", F.lit(" until step_100 "), devices, F.lit(" attempt_1_of_2 batch_"), batch)
    log = files.event_log(table(spark, sf_dir, "events").select(line.alias("value")))
    return log.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "action", "job", F.array_join(F.col("gpus").cast("array<string>"), ",").alias("gpus"), "batch")


@query("""
select 'job ' || event_id as job, event_id as done, event_id + user_id as total, round(case when event_id % 2 = 0 then user_id % 8 + 0.5 else 1 / (user_id % 8 + 0.5) end, 9)::double as per_second from events where event_id % 10 <> 0
union all select 'job ' || event_id, null, null, null from events where event_id % 10 = 0""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last progress entry of each log, null where there is none."""
    entry = F.concat(F.lit("1/9 [00:01<00:01,  9.00it/s]\r 38%| "), "event_id", F.lit("/"), F.col("event_id") + F.col("user_id"), F.lit(" [02:12<28:58:27,  "), F.col("user_id") % 8, F.when(F.col("event_id") % 2 == 0, ".50it/s]").otherwise(".50s/it]"))
    text = F.concat(F.lit("job "), "event_id", F.lit("\n"), F.when(F.col("event_id") % 10 != 0, entry).otherwise(""))
    out = files.progress(table(spark, sf_dir, "events").select(text.alias("value")))
    return out.select(F.split("value", "\n")[0].alias("job"), "done", "total", F.round("per_second", 9).alias("per_second"))


def _put(folder: str, contents: dict[str, bytes]) -> None:
    """Small files in a folder that executors share."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
    store.create_dir(at, recursive=True)
    for name, data in contents.items():
        with store.open_output_stream(f"{at}/{name}") as out:
            out.write(data)


@query("select 'a' || n_regionkey || '.eval' as archive, 's' || n_nationkey || '.json' as member, n_name as name, n_nationkey as score from nation")
def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON samples out of zip archives, one of each region, with members and a file that are none."""
    nations, archives = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").collect(), {"broken.eval": b"no archive"}
    for region in {n[0] for n in nations}:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("header.json", "{}")
            for _, key, name in (n for n in nations if n[0] == region):
                z.writestr(f"samples/s{key}.json", json.dumps({"name": name, "score": key}))
        archives[f"a{region}.eval"] = data.getvalue()
    folder = fresh_path(spark, "zips")
    _put(folder, archives)
    z = files.zipped_samples(spark, f"{folder}/*.eval")
    last, field = lambda c: F.regexp_extract(c, "([^/]+)$", 1).alias(c), lambda c: F.get_json_object("json", f"$.{c}")
    return z.select(last("archive"), last("member"), field("name").alias("name"), field("score").cast("long").alias("score"))


@query("select 'r' || n_regionkey || '.npy' as name, string_agg(n_nationkey, ',' order by n_name desc) as vals from nation group by n_regionkey")
def number_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors out of npy files, one of each region."""
    import numpy as np

    vectors: dict[str, bytes] = {}
    for region, keys in table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))))["n_nationkey"]).collect():
        data = io.BytesIO()
        np.save(data, np.array(keys, np.uint32))
        vectors[f"r{region}.npy"] = data.getvalue()
    folder = fresh_path(spark, "npy")
    _put(folder, vectors)
    v = files.numpy_vectors(spark, f"{folder}/*.npy")
    return v.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"))


@query("select user_id, event_type as metric, round(sum(value), 6) as value from events group by 1, 2")
def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows with maps as a long table."""
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return files.long_history(m.withColumn("step", F.lit(1)), "user_id", "step", "m").select("user_id", "metric", F.round("value", 6).alias("value"))


@query("select source as name, doc_id from documents where (lang = 'en' or source = 'src3' or n_chars < 500) and source not in ('src1', 'src7') and doc_id % 5 <> 0")
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by group, list and gate."""
    groups = F.array(F.col("lang"), F.col("source"), F.when(F.col("n_chars") < 500, "short").otherwise("long"))
    gated = F.when(F.col("doc_id") % 5 == 0, True).when(F.col("doc_id") % 5 == 1, False)
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), groups.alias("groups"), gated.alias("gated"), "doc_id")
    return files.chosen(c, ["en", "src3", "short"], skip=["src1", "src7"]).select("name", "doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that have no output yet."""
    return files.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at paths of JSON text."""
    return files.nested(table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": "$.k"}).select("event_id", "k")


_STATES = ("DONE", "DONE", "DONE", "PENDING", "RUNNING", "FAILED", "DONE", "SKIPPED", "PENDING", "DONE", "PENDING")


@query(f"""
with recursive j as (select p_partkey as k, {list(_STATES)}[p_partkey % 11 + 1] as status, p_size % 3 = 0 as terminal from part),
e as (select distinct k, dep from (select k, k // 2 as dep from j where k > 0 union all select k, k // 3 from j where k > 0 union all select k, -1 from j where k % 23 = 5)),
lost as (select k from j where status in ('FAILED', 'SKIPPED') union select j.k from lost join e on e.dep = lost.k join j on j.k = e.k where j.status not in ('DONE', 'RUNNING') and not j.terminal),
d as (select e.k, s.status as dep_status, e.dep in (select k from lost) as lost from e left join j s on s.k = e.dep)
select j.k as job_id, coalesce(bool_and(case when terminal then dep_status is not null and (dep_status in ('DONE', 'FAILED', 'SKIPPED') or lost) else coalesce(dep_status = 'DONE', false) end) filter (d.k is not null), true) as satisfied
from j left join d on d.k = j.k group by j.k""")
def job_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies in success and terminal mode, over chains of jobs and jobs that are missing."""
    k = F.col("p_partkey")
    deps = F.array_distinct(F.array_compact(F.array(F.when(k > 0, F.floor(k / 2)), F.when(k > 0, F.floor(k / 3)), F.when(k % 23 == 5, F.lit(-1)))))
    status, mode = F.get(F.array(*map(F.lit, _STATES)), (k % 11).cast("int")), F.when(F.col("p_size") % 3 == 0, "terminal").otherwise("success")
    return J.ready(table(spark, sf_dir, "part").select(k.alias("job_id"), status.alias("status"), deps.cast("array<long>").alias("deps"), mode.alias("deps_mode")))


@query("select p_partkey, printf('gen %d', p_partkey) as generation from part")
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations from a client, a stand-in here."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("prompt"))
    return J.generate(p, lambda texts: [f"gen {t}" for t in texts]).drop("prompt")


@query("select doc_id, length(source) as n_inst, length(text) as n_resp from documents where length(text) >= 2")
def tokenised_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and answer ids where one begins the other; characters stand in for tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("instruction"), F.col("text").alias("response"))
    t = J.tokenised(d, lambda s: [ord(c) for c in s], lambda i, r: (i, i + r))
    return t.select("doc_id", F.size("inst_tokens").cast("long").alias("n_inst"), F.size("resp_tokens").cast("long").alias("n_resp"))


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over a stream."""
    s = E.windows(E.read_events(spark, f"{sf_dir}/events.parquet"), "1 day", "1 hour")
    out = E.run_to_end(s, "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select event_id, user_id from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each key within the watermark of a stream that brings every event twice."""
    events = E.read_events(spark, f"{sf_dir}/events.parquet")
    s = E.deduplicated(events.unionByName(E.read_events(spark, f"{sf_dir}/events.parquet")), "event_id", "36500 days")
    return E.run_to_end(s.select("event_id", "user_id"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(event_type, (ts, event_id)) in ('view', 'click') as open from events where event_type in ('view', 'click', 'purchase') group by user_id")
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that holds for each user after a stream."""
    return E.run_to_end(E.last_states(E.read_events(spark, f"{sf_dir}/events.parquet"), ("view", "click"), ("purchase",)), "update", ["user_id"])


@query("select source, source || '_v2' as renamed, contains(lower(text), 'the and') as marked from documents")
def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names rewritten, and a marker in text."""
    return table(spark, sf_dir, "documents").select("source", F.concat("source", F.lit("_v2")).alias("renamed"), F.contains(F.lower("text"), F.lit("the and")).alias("marked"))


@query("select doc_id, case when doc_id % 3 = 0 then lang else upper(lang) end as lang from documents")
def base_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union in which the base wins."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.union_base_wins(d.filter("doc_id % 3 = 0"), d.withColumn("lang", F.upper("lang")), "doc_id")


@query("select page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as title, length(regexp_replace(html, '<[^>]*>', '', 'g')) as n from pages")
def pattern_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields taken out of text by patterns."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n"))
