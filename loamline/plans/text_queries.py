"""Queries for scores of texts, checks of leaks and contracts, sections, resumed streams and joined trees."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import text as X
from loamline.operators import curate as C
from loamline.operators import filters as R
from loamline.operators import scoring as G
from loamline.operators import sequential as S
from loamline.plans import jobs as J
from loamline.plans.queries import WORDS, Query, table
from loamline.shared import cut, fresh_path
from loamline.sources import files
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


def _grams(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


_TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
_KINDS = [("r1", "cw", "rw", 1), ("r2", "cw", "rw", 2), *((f"b{n}", "ct", "rt", n) for n in range(1, 5))]
#: A pair is a turn and the one before it; f has, for each kind of gram, how many are shared and how many each side has.
_PAIRS = f"""
with p as (select role, conv_id, turn, text as c, lag(text) over (partition by conv_id order by turn) as r from conversations),
q as (select role, conv_id, turn, {WORDS.format("c")} as cw, {WORDS.format("r")} as rw, {_TOKENS.format("c")} as ct, {_TOKENS.format("r")} as rt from p where r is not null),
k as ({" union all ".join(f"select '{k}' as kind, role, conv_id, turn, {_grams(a, n)} as a, {_grams(b, n)} as b from q" for k, a, b, n in _KINDS)}),
ua as (select kind, conv_id, turn, g, count(*) as n from (select kind, conv_id, turn, unnest(a) as g from k) group by all),
ub as (select kind, conv_id, turn, g, count(*) as n from (select kind, conv_id, turn, unnest(b) as g from k) group by all),
m as (select kind, conv_id, turn, sum(least(ua.n, ub.n)) as m from ua join ub using (kind, conv_id, turn, g) group by all),
f as (select k.kind, k.role, k.conv_id, k.turn, len(a) as na, len(b) as nb, coalesce(m, 0) as m from k left join m on k.kind = m.kind and k.conv_id = m.conv_id and k.turn = m.turn)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").selectExpr("role", "conv_id", "turn", "text", "lag(text) over (partition by conv_id order by turn) as before").filter("before is not null")
    return G.scored(t, ["role", "conv_id", "turn"], "text", "before")


@query(f"""{_PAIRS}
select conv_id, turn, round(coalesce(max(2 * m / nullif(na + nb, 0)) filter (kind = 'r1'), 0), 9) as rouge1, round(coalesce(max(2 * m / nullif(na + nb, 0)) filter (kind = 'r2'), 0), 9) as rouge2 from f group by conv_id, turn""")
def turn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE of each turn against the one before."""
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round("rouge1", 9).alias("rouge1"), F.round("rouge2", 9).alias("rouge2"))


@query(f"""{_PAIRS},
s as (select role, kind, sum(m) as m, sum(na) as na, sum(nb) as nb from f where kind like 'b%' group by role, kind),
z as (select *, sum(case when m = 0 then 1 else 0 end) over (partition by role order by kind) as zeros from s where na > 0),
l as (select role, sum(m) as hits, avg(ln(case when m = 0 then 1 / (pow(2, zeros) * na) else m / na end)) as mean, max(na) filter (kind = 'b1') as c, max(nb) filter (kind = 'b1') as r from z group by role)
select role, (select count(*) from q where q.role = l.role) as n, round(case when hits = 0 then 0 else 100 * case when c >= r then 1 else exp(1 - r / c) end * exp(mean) end, 6) as bleu from l""")
def role_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of all turns of a role together."""
    return G.corpus_scores(_pairs(spark, sf_dir), ["role"]).select("role", "n", F.round("bleu", 6).alias("bleu"))


@query()
def ordered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L, chrF and chrF++ of all turns of a role together."""
    return G.corpus_scores(_pairs(spark, sf_dir), ["role"]).select("role", *[F.round(c, 6).alias(c) for c in ("rouge_l", "chrf", "chrf_pp")])


_NEIGHBOURS = "select conv_id * 1000 + turn as id, text, lag(text) over (partition by conv_id order by turn) as r0, lead(text) over (partition by conv_id order by turn) as r1 from conversations"


@query(f"""
with t as ({_NEIGHBOURS}),
s as (select id, k, {WORDS.format("text")} as a, {WORDS.format("coalesce(r, '')")} as b from (select id, text, 0 as k, r0 as r from t union all select id, text, 1, r1 from t)),
ua as (select id, k, g, count(*) as n from (select id, k, unnest(a) as g from s) group by all),
ub as (select id, k, g, count(*) as n from (select id, k, unnest(b) as g from s) group by all),
m as (select id, k, sum(least(ua.n, ub.n)) as m from ua join ub using (id, k, g) group by all),
f as (select s.id, s.k, coalesce(2 * m / nullif(len(a) + len(b), 0), 0) as score from s left join m on s.id = m.id and s.k = m.k)
select id, round(max(score), 9) as score, cast(arg_max(k, (score, -k)) as bigint) as reference_idx from f group by id""")
def best_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which neighbour a turn is most like, the one before or the one after."""
    t = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn as id", "text", "array(lag(text) over (partition by conv_id order by turn), lead(text) over (partition by conv_id order by turn)) as refs")
    return S.best_reference(t, "id", "text", "refs").withColumn("score", F.round("score", 9))


_HITS = " || ".join(f"regexp_extract_all(text, '{p}')" for p in (R.EMAIL, R.PHONE, R.NAME))


@query(rf"""
with t as (select doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') as text from documents),
h as (select doc_id, {_HITS} as hits, regexp_replace(text, '{R.EMAIL}', '<address>', 'g') as masked from t)
select doc_id, len(hits) as hits, len(list_filter(hits, lambda h: length(h) > 0 and contains(masked, h))) as unchanged from h""")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text with its addresses masked still gives away of the original."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "_").alias("text"))
    left = R.unchanged_hits(F.col("text"), F.col("masked"))
    return d.withColumn("masked", F.regexp_replace("text", R.EMAIL, "<address>")).select("doc_id", F.size(R.pii_hits(F.col("text"))).cast("long").alias("hits"), F.size(left).cast("long").alias("unchanged"))


@query("""
with t as (select *, lag(role) over (partition by conv_id order by turn) as before, lag(turn) over (partition by conv_id order by turn) as was from conversations),
c as (select conv_id, arg_min(role, turn) as first, arg_max(role, turn) as last, count(*) filter (role = 'assistant') as answers, count(*) filter (role = before) as repeats, count(*) filter (turn <> coalesce(was, -1) + 1) as gaps, count(*) filter (length(trim(coalesce(text, ''))) = 0) as blanks from t group by conv_id),
f as (select first, conv_id, unnest(list_filter([case when answers = 0 then 'no_supervised_turn' end, case when first = 'assistant' then 'starts_with_answer' end, case when last <> 'assistant' then 'ends_without_answer' end,
  case when repeats > 0 then 'repeated_role' end, case when gaps > 0 then 'missing_turn' end, case when blanks > 0 then 'empty_turn' end], lambda x: x is not null)) as issue from c)
select first, issue, count(*) as n, array_to_string(list_sort(list(distinct conv_id))[1:5], ',') as examples from f group by first, issue""")
def conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that break the contract of training rows, by named issues with the first of each."""
    t = table(spark, sf_dir, "conversations").selectExpr("*", "lag(role) over (partition by conv_id order by turn) as before", "lag(turn) over (partition by conv_id order by turn) as at")
    gap, blank = F.col("turn") != F.coalesce("at", F.lit(-1)) + 1, F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    c = t.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first"), F.max_by("role", "turn").alias("last"), F.count_if(F.col("role") == "assistant").alias("answers"), F.count_if(F.col("role") == F.col("before")).alias("repeats"), F.count_if(gap).alias("gaps"), F.count_if(blank).alias("blanks"))
    tests = {"no_supervised_turn": F.col("answers") == 0, "starts_with_answer": F.col("first") == "assistant", "ends_without_answer": F.col("last") != "assistant", "repeated_role": F.col("repeats") > 0, "missing_turn": F.col("gaps") > 0, "empty_turn": F.col("blanks") > 0}
    out = R.issues(c, ["first"], tests, examples=5, order="conv_id")
    return out.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("""
select n_name as title, 0::bigint as idx, 'About ' || n_name as heading, '```' || chr(10) || '## no heading' || chr(10) || '```' as body from nation
union all select n_name, 1, 'Region', 'Region ' || n_regionkey || ' of ' || (select count(*) from region) from nation""")
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files with front matter, read back and cut at headings outside code."""
    path, regions = fresh_path(spark, "markdown"), table(spark, sf_dir, "region").agg(F.count("*").alias("regions"))
    page = F.format_string("---\ntitle: %s\nkind: note\n---\nIn front.\n\n## About %s\n```\n## no heading\n```\n\n## Region\nRegion %d of %d\n", "n_name", "n_name", "n_regionkey", "regions")
    table(spark, sf_dir, "nation").join(F.broadcast(regions)).select("n_nationkey", page.alias("value")).write.partitionBy("n_nationkey").text(path)
    read = files.markdown(spark, path).select(F.col("meta")["title"].alias("title"), "body")
    return S.each_text(read, "title", "body", lambda _, t: S.markdown_sections(t), "heading string, body string")


@query("select r_regionkey as region from region where r_regionkey % 2 = 1")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with files that the manifest of the last run doesn't have."""
    path = fresh_path(spark, "sources")
    nations = table(spark, sf_dir, "nation")
    nations.repartition("n_regionkey").write.partitionBy("n_regionkey").parquet(path)
    manifest = cut(files.changed_files(spark, path, spark.createDataFrame([], "path string, length long, modificationTime timestamp")))
    nations.filter("n_regionkey % 2 = 1").repartition("n_regionkey").write.mode("append").partitionBy("n_regionkey").parquet(path)
    return files.changed_files(spark, path, manifest).select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("region")).distinct()


@query("select event_id, user_id from events")
def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output that is appended to anew after its progress was lost, with every event twice in the stream."""
    path = fresh_path(spark, "appended")
    for _ in range(2):
        read = [E.read_events(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id") for _ in range(2)]
        E.append_new(read[0].unionByName(read[1]), "event_id", path, fresh_path(spark, "progress"))
    return spark.read.parquet(path)


@query("select user_id, 1::bigint as n from events where event_type = 'purchase' group by user_id")
def completed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users acted on when they become complete, over two runs of which the second meets most of them again."""
    inbox, done, acted, progress = (fresh_path(spark, x) for x in ("inbox", "done", "acted", "progress"))
    events = table(spark, sf_dir, "events")
    for side in (0, 1):
        events.filter(F.col("event_id") % 2 == side).write.mode("append").parquet(inbox)
        act = lambda rows: rows.select("user_id").distinct().write.mode("append").parquet(done)
        E.watch(E.read_events(spark, inbox), lambda b: b.filter("event_type = 'purchase'"), act, progress, "user_id", acted)
    return spark.read.schema("user_id long").parquet(done).groupBy("user_id").agg(F.count("*").alias("n"))


@query("select start, event_type, count(*) as n, round(sum(value), 4) as total from (select unnest([time_bucket(interval '1 day', ts), time_bucket(interval '1 day', ts) - interval '1 day']) as start, event_type, value from events) group by 1, 2")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days that start every day."""
    out = E.run_to_end(E.windows(E.read_events(spark, f"{sf_dir}/events.parquet"), "2 days", "1 hour", "1 day"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, min(ts) as start, max(ts) + interval '6 hours' as end, count(*) as n from s group by user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users without a pause of six hours."""
    out = E.run_to_end(E.sessions(E.read_events(spark, f"{sf_dir}/events.parquet"), "6 hours", "1 hour"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""
with m as (select max(ts) filter (event_id % 2 = 0) - interval '1 hour' as first, max(ts) - interval '1 hour' as second from events),
e as (select time_bucket(interval '1 day', ts) as start, event_type, event_id from events)
select start, event_type, count(*) as n from e, m where start + interval '1 day' <= second and (event_id % 2 = 0 or start + interval '1 day' > first) group by start, event_type""")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows given out when the watermark has passed them; the second half of the events comes too late for most."""
    inbox, out, progress = (fresh_path(spark, x) for x in ("inbox", "windows", "progress"))
    events = table(spark, sf_dir, "events")
    for side in (0, 1):
        events.filter(F.col("event_id") % 2 == side).write.mode("append").parquet(inbox)
        found = E.run_to(E.windows(E.read_events(spark, inbox, 1_000_000), "1 day", "1 hour"), out, progress)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_TOKENIZER = {"file": "word_bpe_49k.json", "vocabulary": 49_152}


@query("select doc_id, lang, case when doc_id % 3 = 0 then 'base' else 'extra' end as tree from documents")
def joined_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of one tokenizer in one, where a key in both would be an error."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    base, extra = d.filter("doc_id % 3 = 0").withColumn("tree", F.lit("base")), d.filter("doc_id % 3 <> 0").withColumn("tree", F.lit("extra"))
    return C.union_alike([(base, _TOKENIZER), (extra, dict(_TOKENIZER))], "doc_id")


@query()
def encoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and answer ids of a public tokenizer."""
    import public_tokenizers

    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("\n")).alias("instruction"), F.coalesce("text", F.lit("")).alias("response"))
    t = J.tokenised(d, J.encoder(public_tokenizers.path("word_bpe_49k.json")), lambda i, r: (i, i + r))
    return t.select("doc_id", F.size("inst_tokens").cast("long").alias("n_inst"), F.size("resp_tokens").cast("long").alias("n_resp"), F.xxhash64("inst_tokens", "resp_tokens").alias("ids"))


@query(r"""
with t as (select doc_id, coalesce(text, '') as text, left(coalesce(text, ''), 400) as head from documents),
c as (select *, regexp_extract(head, '(?s)^(.*[.!?])(\s|$)', 1) as ended, case when contains(head, ' ') then length(head) - strpos(reverse(head), ' ') else -1 end as gap from t)
select doc_id, 0::bigint as idx, case when length(text) <= 400 then text when length(ended) >= 200 then ended when gap >= 200 then rtrim(left(head, gap)) else rtrim(head) end as trimmed from c""")
def trimmed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut behind their last whole sentence."""
    return S.each_text(table(spark, sf_dir, "documents"), "doc_id", "text", lambda _, t: [(S.trim_to_sentence(t, 400),)], "trimmed string")


@query()
def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with words deleted and marked."""
    return S.each_text(table(spark, sf_dir, "documents"), "doc_id", "text", lambda k, t: [(S.noisy_words(t, k),)], "noisy string")


@query("select distinct event_id, user_id, event_type, value from events where value <= 40")
def clean_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct row once and no bad one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return C.clean_rows(e.unionByName(e), F.col("value") > 40)


@query("select event_id, replace(replace(event_type, 'click', 'tap'), 'tap', 'touch') as kind, 'touch_' || event_id as name, 'click' as field from events")
def replaced_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements one after another in all texts of nested objects, but not in names of fields."""
    plan = F.to_json(F.struct(F.struct("event_type", F.array(F.concat(F.lit("click_"), "event_id")).alias("names")).alias("click")))
    pairs = [("click", "tap"), ("tap", "touch")]
    out = S.each_text(table(spark, sf_dir, "events").select("event_id", plan.alias("plan")), "event_id", "plan", lambda _, t: [(json.dumps(S.replaced_values(json.loads(t), pairs)),)], "plan string")
    at = lambda p: F.get_json_object("plan", p)
    return out.select("event_id", at("$.click.event_type").alias("kind"), at("$.click.names[0]").alias("name"), F.json_object_keys("plan")[0].alias("field"))


@query("""
select event_id, 'solved' as state, event_type || '(n=-' || user_id || ')' as atom from events
union all select event_id, 'solved', 'Vox' from events union all select event_id, 'failed', event_type || '-2(x,y z)' from events""")
def status_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms under the states of a status map, normalised."""
    text = F.concat(F.lit("as told; solved: "), "event_type", F.lit(" ( n = -  "), "user_id", F.lit(" ), Vox\nfailed : "), "event_type", F.lit("-2 (x , y  z)"))
    atoms = X.status_atoms(text, ("solved", "failed", "timeout"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(atoms).alias("a")).select("event_id", "a.*")


@query("""
with v as (select doc_id, cast(n_chars as bigint) * n_chars * 7 as size, case when doc_id % 4 = 0 then null else (doc_id % 16) / 64.0 end as share from documents)
select doc_id, case when size < 1024 then printf('%.1f B', size::double) when size < 1048576 then printf('%.1f KB', size / 1024.0::double) when size < 1073741824 then printf('%.1f MB', size / 1048576.0::double) else printf('%.1f GB', size / 1073741824.0::double) end as size,
  case when share is null then '—' else printf('%.1f%%', (share * 100)::double) end as share from v""")
def sizes_and_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in bytes and shares as text."""
    n = F.col("n_chars").cast("long")
    share = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 16 / 64.0)
    return table(spark, sf_dir, "documents").select("doc_id", X.byte_size(n * n * 7).alias("size"), X.percent(share).alias("share"))


@query("select source, lang, n, k as rank from (select source, lang, count(*) as n, row_number() over (partition by source order by count(*) desc, lang) as k from documents group by source, lang) where k <= 3")
def common_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent values of each group."""
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return C.top_k(n, ["source"], [F.desc("n"), F.col("lang")], 3).select("source", "lang", "n", F.col("rank").cast("long").alias("rank"))
