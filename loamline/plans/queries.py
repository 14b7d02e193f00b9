"""The library's own operators as queries over the test tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.functions import hashing as H
from loamline.functions import text as X
from loamline.operators import curate as C
from loamline.operators import expand as P
from loamline.operators import filters as R
from loamline.operators import measure as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
#: Words of function that tell English text.
LEAK_WORDS = ("the", "and", "of", "to", "with", "from", "this", "that")
UNIT = "cast(('0x' || substr(md5({0}), 1, 13)) as bigint)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nine(c: Column) -> Column:
    return F.round(c, 9)


_CLASS = [("prefix", "src1", "web"), ("suffix", "0", "books"), ("contains", "5", "forums")]
_CLASS_SQL = "case when starts_with(source, 'src1') then 'web' when ends_with(source, '0') then 'books' when contains(source, '5') then 'forums' else 'other' end"


@query(f"""
with audited as (
  select d.source, d.lang, {_CLASS_SQL} as kind, coalesce(l.quality = 1, false) and length(trim(text)) >= 200 and not contains(text, '[MISSING]') as keep
  from documents d join labels l using (doc_id))
select source, lang, kind, count(*) as audited, count(*) filter (keep) as keep, count(*) filter (not keep) as "drop", round(count(*) filter (keep) / count(*), 9) as keep_rate
from audited group by grouping sets ((source, lang), (kind), ())""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents under audit rules: kept and dropped by source and language, by kind, and in all."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    keep = R.all_true(F.col("quality") == 1, F.length(F.trim("text")) >= 200, ~F.contains(F.col("text"), F.lit("[MISSING]")))
    rows = d.select("source", "lang", R.name_class(F.col("source"), _CLASS, "other").alias("kind"), keep.alias("kept"))
    return M.counters(rows, [["source", "lang"], ["kind"], []], F.col("kept")).withColumn("keep_rate", _nine(F.col("keep_rate")))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as line, case when length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 80 then rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80)) || ' ...' else trim(regexp_replace(text, '\\s+', ' ', 'g')) end as short from documents".replace("\\\\", "\\"))
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts on one line, and cut."""
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_line(F.col("text")).alias("line"), X.clean_line(F.col("text"), 80).alias("short"))


@query(r"""
with t as (select doc_id, regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g') as b, replace(text, '<|endoftext|>', '') as e from documents)
select doc_id, regexp_replace(b, '^\s+|\s+$', '', 'g') as block, length(e) as n_left from t""")
def clean_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with lines kept, and without end marks."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.clean_block(F.col("text")).alias("block"), F.length(X.drop_end_mark(F.col("text"))).cast("long").alias("n_left"))


@query("""
select page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9.-]+', '_', 'g'), '^[_]+|[_]+$', '', 'g'), 1, 96) as slug,
  case when starts_with(url, 'https://') then 'web/' || substr(url, 9) else url end as key from pages""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from urls, and a rewritten prefix."""
    return table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"), X.rewrite_prefix(F.col("url"), "https://", "web/").alias("key"))


@query(r"""
with b as (select doc_id, translate(text, '{}', '[]') as t, n_chars from documents)
select doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') as boxed, n_chars as integer, chr(cast(65 + doc_id % 4 as int)) as letter from b""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers parsed back out of text that holds them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.translate("text", "{}", "[]").alias("t"))
    letter = F.char(65 + F.col("doc_id") % 4)
    told = F.concat(F.lit("so \\boxed{7} no, \\boxed{"), F.col("t"), F.lit("} (A) then ("), letter, F.lit(")."))
    return d.select("doc_id", X.last_boxed(told).alias("boxed"), X.to_integer(F.format_string("$%s.0", F.col("n_chars"))).alias("integer"), X.choice_letter(told).alias("letter"))


@query("""
select conv_id, turn, case when position('.' in text) = 0 then text else substr(text, 1, position('.' in text) - 1) end as head,
  text || chr(10) || 'A. ' || role || chr(10) || 'B. ' || cast(turn as varchar) as prompt from conversations where text is not null""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts up to a stop mark, and as questions with lettered options."""
    t = table(spark, sf_dir, "conversations").filter("text is not null")
    return t.select("conv_id", "turn", X.cut_at_stop(F.col("text"), ["."]).alias("head"), X.format_choices(F.col("text"), F.array("role", F.col("turn").cast("string"))).alias("prompt"))


@query("""
select event_id, case when v is null then 'unknown' when v >= 3600 then printf('%dh%02dm', v // 3600, v % 3600 // 60) when v >= 60 then printf('%dm%02ds', v // 60, v % 60) else printf('%ds', v) end as took,
  greatest(1, cast(ceil((event_id % 64 + 1) / pow(2, event_id % 5)) as bigint)) as batch,
  round(0.001 * case when event_id < 100 then event_id / 100.0 else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((event_id - 100) / 900.0, 0), 1))) end, 12) as rate
from (select event_id, cast(floor(value * 60) as bigint) as v from events)""")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, halved batches and a learning rate."""
    e = table(spark, sf_dir, "events")
    rate = X.cosine_rate(F.col("event_id"), peak=0.001, warm=100, total=1000, least=0.1)
    return e.select("event_id", X.duration(F.col("value") * 60).alias("took"), X.retry_batch(F.col("event_id") % 64 + 1, F.col("event_id") % 5).alias("batch"), F.round(rate, 12).alias("rate"))


@query("""
select event_id, json_valid(props) as valid, case when isnan(v) or isinf(v) then null else v end as number from (select event_id, props, try_cast(value as double) as v from events)""")
def maybe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects found in text, and finite numbers."""
    return table(spark, sf_dir, "events").select("event_id", X.outer_object(F.concat(F.lit("so: "), F.col("props"))).isNotNull().alias("valid"), X.finite(F.col("value")).alias("number"))


@query(rf"""
with s as (select doc_id, text, regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g') as marked from documents),
c as (select doc_id, text, len(list_filter(string_split(marked, chr(1)), lambda x: length(trim(x)) > 0)) as n,
  len(list_filter({WORDS.format("text")}, lambda w: w in ('the', 'and', 'of', 'to', 'with', 'from', 'this', 'that'))) as leaks from s)
select doc_id, case when length(trim(text)) = 0 then 'empty' when starts_with(lower(text), 'the and') then 'preamble' when leaks >= 40 then 'language_leak' when length(trim(text)) > 4000 then 'too_long'
  when n <> 9 then 'sentence_count' else 'accepted' end as reason from c""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a text fails as an answer."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", R.acceptance(F.col("text"), preambles=("the and",), leak_words=LEAK_WORDS, leak_limit=40, max_chars=F.lit(4000), sentences=F.lit(9)).alias("reason"))


@query(r"""
with t as (select doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') as text from documents)
select doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+\b')) + len(regexp_extract_all(text, '\b(\+?\d[\d .()/-]{7,}\d)\b'))
  + len(regexp_extract_all(text, '\b(\d{1,5}\s+)?[A-Z][a-z]+(\s+[A-Z][a-z]+){1,3}\b')) as hits from t""")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that look like addresses, phone numbers or names; letters beyond ASCII are made one that all engines take for part of a word."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(R.pii_hits(plain)).cast("long").alias("hits"))


@query(rf"""
with w as (select conv_id, turn, {WORDS.format("text")} as w, lag({WORDS.format("text")}) over (partition by conv_id order by turn) as p from conversations),
s as (select conv_id, turn, list_distinct(w) as a, list_distinct(p) as b from w where p is not null)
select conv_id, turn, round(case when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b)) / least(len(a), len(b)) end, 9) as overlap from s""")
def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word overlap of a turn with the one before."""
    t = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", "lag(text) over (partition by conv_id order by turn) as before").filter("before is not null")
    return t.select("conv_id", "turn", _nine(R.word_overlap(F.col("text"), F.col("before"))).alias("overlap"))


def _grams_sql(of: str, key: str) -> str:
    return f"select {key}, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) else [] end as g from (select {key}, {WORDS.format('text')} as w from {of})"


@query(f"""
with d as ({_grams_sql("documents", "doc_id")}), b as ({_grams_sql("benchmark", "item_id")}),
m as (select doc_id, item_id, count(*) as shared from (select doc_id, unnest(g) as g from d) x join (select item_id, unnest(g) as g from b) y using (g) group by doc_id, item_id)
select doc_id, item_id, shared, round(shared / greatest(1, len(b.g)), 9) as ratio from m join b using (item_id)""")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share word 5-grams with benchmark items, by a join on the grams."""
    b = table(spark, sf_dir, "benchmark")
    m = C.text_matches(table(spark, sf_dir, "documents"), "doc_id", b, "item_id", "text", 5)
    return m.join(b.select("item_id", F.size(X.ngrams(X.words(F.col("text")), 5)).alias("n")), "item_id").select("doc_id", "item_id", "shared", _nine(F.col("shared") / F.greatest("n", F.lit(1))).alias("ratio"))


@query("""
select doc_id, length(text) as response_chars, length(text) > 0 as response_nonempty, contains(source, '<mask_') as contains_mask,
  contains(text, chr(65533)) or contains(text, '[MISSING]') as has_artifacts, len(regexp_extract_all(source || text, 'https?://')) as url_count from documents""")
def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the audit of a prompt and its answer."""
    h = R.heuristics(F.col("source"), F.col("text"))
    names = ("response_chars", "response_nonempty", "contains_mask", "has_artifacts", "url_count")
    return table(spark, sf_dir, "documents").select("doc_id", *[(h[n].cast("long") if n in ("response_chars", "url_count") else h[n]).alias(n) for n in names])


@query("""
select page_id, case when not regexp_full_match(url, '(?s)https?://.*') then 'not_included' when regexp_full_match(url, '(?s).*/de/.*') then 'allowed' when regexp_full_match(url, '(?s).*casino.*|.*/[^/]*page=.*') then 'denied' else 'allowed' end as state,
  contains(lower(url), 'pills') or contains(lower(url), 'bets') as listed from pages""")
def path_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-state selection of names by globs, and a deny list."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", R.glob_state(F.col("url"), ["http://*", "https://*"], ["*/de/*"], ["*casino*", "*page=*"]).alias("state"), R.denied(F.col("url"), ("pills", "bets")).alias("listed"))


@query("""
with f as (select source, doc_id, unnest(list_filter([case when n_chars < 500 then 'short' end, case when lang <> 'en' then 'foreign' end, case when contains(text, '@') then 'address' end], lambda x: x is not null)) as issue from documents)
select source, issue, count(*) as n, array_to_string(list_sort(list(distinct doc_id))[1:3], ',') as examples from f group by source, issue""")
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named row-level issues by source, with the first rows."""
    tests = {"short": F.col("n_chars") < 500, "foreign": F.col("lang") != "en", "address": F.contains(F.col("text"), F.lit("@"))}
    out = R.issues(table(spark, sf_dir, "documents"), ["source"], tests, examples=3)
    return out.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("select doc_id, 2048 - least(400, 2048) as allowed, least(n_chars, 1648) as kept from documents where n_chars >= 20")
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose answer has room in a context."""
    d = table(spark, sf_dir, "documents").withColumn("inst", F.lit(400).cast("long"))
    return R.fit_context(d, "inst", "n_chars", 2048, 20).select("doc_id", F.col("allowed").cast("long").alias("allowed"), F.col("kept").cast("long").alias("kept"))


@query("""
with t as (select conv_id, turn, lower(role) as role, trim(text) as body, case when trim(text) <> '' then upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ':' || chr(10) || trim(text) end as said from conversations),
h as (select *, string_agg(said, chr(10) || chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as instruction from t)
select conv_id, turn, 'direct' as condition, instruction, body as response from h where role = 'assistant' and body <> '' and coalesce(instruction, '') <> ''""")
def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each assistant turn, with its history."""
    return P.assistant_turns(table(spark, sf_dir, "conversations"))


@query("""
select doc_id, case when lang in ('', 'direct') then 2 else 3 end as n_messages, case when lang in ('', 'direct') then 'user' else 'system' end as first_role, nullif(trim(source), '') as instruction from documents""")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets as messages, and the first text among columns."""
    d = table(spark, sf_dir, "documents")
    m = d.select("doc_id", P.to_messages(F.col("lang"), F.col("source"), F.col("text")).alias("m"), P.first_text(d, ["prompt", "source", "text"]).alias("instruction"))
    return m.select("doc_id", F.size("m").cast("long").alias("n_messages"), F.col("m")[0]["role"].alias("first_role"), "instruction")


@query("""
with p as (select a.doc_id, a.text as x, b.text as y from documents a join documents b on b.doc_id = a.doc_id + 1 where trim(a.text) <> '' and trim(b.text) <> '')
select doc_id, 'Translate to two:' || chr(10) || chr(10) || x as instruction, y as response from p union all select doc_id, 'Translate to one:' || chr(10) || chr(10) || y, x from p""")
def translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each pair of texts."""
    d = table(spark, sf_dir, "documents")
    pairs = d.select("doc_id", F.col("text").alias("one")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("two")), "doc_id")
    return P.both_ways(pairs, "one", "two", "one", "two").select("doc_id", "instruction", "response")


@query(r"""
with b as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from documents),
c as (select doc_id, unnest(range(0, greatest(length(t), 1), 1200)) as i, t from b)
select doc_id, i // 1200 as chunk_idx, regexp_replace(substr(t, i + 1, 1200), '^\s+|\s+$', '', 'g') as chunk from c where regexp_replace(substr(t, i + 1, 1200), '^\s+|\s+$', '', 'g') <> ''""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in slices of 1200 characters."""
    return P.chunks(table(spark, sf_dir, "documents"), "text", 1200).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "chunk")


@query(r"""
with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from documents),
r as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos, ls[1] as title from l),
h as (select *, lead(line) over (partition by doc_id order by pos) as nx from r),
f as (select *, case when nx is null or length(line) > 140 or substr(line, 1, 1) in ('·', '-', '*', '•') or (regexp_matches(line, '^\d') and (ends_with(line, ')') or contains(substr(line, 1, 4), '.'))) or regexp_full_match(line, '\d+') then false
  when ends_with(line, '?') then true else right(line, 1) not in ('.', '!', ':', ';', ',') end as head from h where pos > 0),
s as (select *, sum(cast(head as int)) over (partition by doc_id order by pos) as section from f)
select doc_id, title, cast(section as bigint) as section, min_by(line, pos) as heading, string_agg(line, chr(10) order by pos) filter (not head) as body
from s where section > 0 group by doc_id, title, section having count(*) filter (not head) > 0""")
def titled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headed parts of texts."""
    return P.titled_sections(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(rf"""
with a as (select doc_id, text, length(text) as n, greatest(1, least(length(text) - 1, cast(floor(length(text) * (0.25 + 0.5 * ({UNIT.format("'17|' || doc_id")} / 4503599627370496.0))) as int))) as i from documents where length(text) > 1),
c as (select doc_id, text, n, least(i + length(regexp_extract(substr(text, i + 1), '^\S*')), greatest(i, n - 1)) as cut from a),
p as (select doc_id, regexp_replace(substr(text, 1, cut), '^\s+|\s+$', '', 'g') as prefix, regexp_replace(substr(text, cut + 1), '^\s+|\s+$', '', 'g') as suffix from c)
select * from p where prefix <> '' and suffix <> ''""")
def prefix_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into a prompt and its continuation."""
    return P.prefix_task(table(spark, sf_dir, "documents"), "doc_id", "text", 17)


@query(r"""
with s as (select conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as n from conversations),
p as (select e.conv_id, e.turn, k.turn as k, k.n, sum(k.n) over (partition by e.conv_id, e.turn order by k.turn desc) as total
  from s e join s k on e.conv_id = k.conv_id and k.turn < e.turn where e.n between 2 and 512)
select conv_id, turn, min(k) as first_turn, count(*) as turns, cast(max(total) as bigint) as words from p where total <= 120 group by conv_id, turn""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest history within a budget for each turn (P25)."""
    return P.turn_windows(table(spark, sf_dir, "conversations"), budget=120, least=2, most=512)


@query("""
select conv_id, arg_min(text, turn) filter (role = 'user') as prompt, arg_max(text, turn) filter (role = 'assistant') as chosen, arg_min(text, turn) filter (role = 'assistant') as rejected
from conversations group by conv_id having prompt is not null and chosen is not null and chosen <> rejected""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs from conversations."""
    return P.preference_pairs(table(spark, sf_dir, "conversations"))


_IDS = rf"list_transform({WORDS.format('text')}, lambda w: cast(('0x' || substr(md5(w), 1, 6)) as bigint) % 5000)"


@query(f"""
with i as (select doc_id, {_IDS} as ids from documents), p as (select doc_id, ids[1:10] as a, ids[11:] as b from i where len(ids) >= 12)
select doc_id, array_to_string(a || b[1:len(b) - 1], ',') as inputs, array_to_string(list_transform(range(9), lambda x: -100) || b, ',') as labels, len(a) + len(b) - 2 as last_position from p""")
def prefix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training arrays whose labels cover the response alone."""
    ids = F.transform(X.words(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % 5000)
    d = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).filter(F.size("ids") >= 12).select("doc_id", F.slice("ids", 1, 10).alias("a"), F.slice("ids", 11, 1 << 30).alias("b"))
    p = P.prefix_lm(F.col("a"), F.col("b"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return d.select("doc_id", joined(p["inputs"]).alias("inputs"), joined(p["labels"]).alias("labels"), F.array_max(p["positions"]).cast("long").alias("last_position"))


@query("select source, doc_id, cast(sum(n_chars) over (partition by source order by doc_id) - n_chars as bigint) as start from documents")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running offsets of rows in their file."""
    return P.offsets(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars").select("source", "doc_id", "start")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1) and doc_id not in (select doc_id from labels where toxic = 1)")
def keep_and_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on a keep list and not on an exclude list."""
    labels = table(spark, sf_dir, "labels")
    return C.anti(C.semi(table(spark, sf_dir, "documents"), labels.filter("quality = 1"), "doc_id"), labels.filter("toxic = 1"), "doc_id").select("doc_id", "source")


@query("select md5(text || '|' || lang) as key, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.md5(F.concat_ws("|", "text", "lang")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("select min(doc_id) as doc_id, text, arg_min(source, doc_id) as source from documents group by text")
def first_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each text."""
    d = table(spark, sf_dir, "documents").select("text", "doc_id", "source")
    return C.first_wins(d, ["text"], "doc_id").select("doc_id", "text", "source")


@query("""
with newer as (select doc_id + 1000000 as doc_id, doc_id as old, source from documents where doc_id % 7 = 0)
select doc_id, source from documents where doc_id not in (select old from newer) union all select doc_id, source from newer""")
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rows that nothing replaces, and the replacing rows."""
    base = table(spark, sf_dir, "documents").select("doc_id", "source")
    newer = base.filter("doc_id % 7 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.col("doc_id").alias("old"))
    return C.superseded_union(base, newer, "doc_id", "old")


@query("""
with en as (select doc_id % 500 as num, arg_max(text, doc_id) as text from documents where lang = 'en' group by 1),
o as (select doc_id, doc_id % 500 as num, text from documents where lang = 'de')
select o.doc_id, o.num, length(o.text) as a, length(en.text) as b from o join en using (num)""")
def parallel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides joined on a parsed key, the last duplicate of one side winning."""
    d = table(spark, sf_dir, "documents").withColumn("num", F.col("doc_id") % 500)
    en = C.last_wins(d.filter("lang = 'en'").select("num", "doc_id", "text"), ["num"], "doc_id").select("num", F.length("text").cast("long").alias("b"))
    return d.filter("lang = 'de'").select("doc_id", "num", F.length("text").cast("long").alias("a")).join(en, "num")


@query("""
select d.doc_id, coalesce(l.quality, 0) as quality, l.doc_id is null as missing from documents d left join labels l using (doc_id)""")
def lookup_with_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup whose misses are marked."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("_there"))
    return table(spark, sf_dir, "documents").join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.col("_there").isNull().alias("missing"))


@query("select doc_id, source, case when starts_with(source, 'src10') then 0 when starts_with(source, 'src1') then 1 else -1 end as rule_pos, case when starts_with(source, 'src10') then 3 when starts_with(source, 'src1') then 2 else 1 end as repeat from documents")
def prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule whose prefix a name has."""
    return C.prefix_rule(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", [("src10", 3), ("src1", 2)], 1)


@query("""
with o as (select unnest(['src9', 'src3', 'src0']) as source, unnest([0, 1, 2]) as pos)
select doc_id, source, cast(pos as bigint) as pos from documents left join o using (source)""")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place that an external list gives a row."""
    order = spark.createDataFrame([("src9", 0), ("src3", 1), ("src0", 2)], "source string, pos long")
    return C.reorder(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", order)


@query("""
with a as (select user_id, avg(value) as v from events where event_id % 2 = 0 group by user_id), b as (select user_id, avg(value) as v from events where event_id % 2 = 1 group by user_id)
select user_id, round(a.v, 6) as before, round(b.v, 6) as after, case when b.user_id is null then 'missing' when a.user_id is null then 'new' when abs(a.v - b.v) > 5 then 'changed' else 'shared' end as state
from a full join b using (user_id)""")
def metric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metric tables compared by key."""
    e = table(spark, sf_dir, "events")
    by = lambda side: e.filter(F.col("event_id") % 2 == side).groupBy("user_id").agg(F.avg("value").alias("v"))
    out = C.key_difference(by(0), by(1), "user_id", "v", 5)
    return out.select("user_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "state")


@query("""
with m as (select user_id, event_type, value, 0 as priority, event_id from events union all select user_id, event_type, value * 2, 1, event_id from events where event_id % 5 = 0)
select user_id, event_type, round(arg_max(value, priority * 1000000000 + event_id), 9) as value from m group by user_id, event_type""")
def metric_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later sources overwrite earlier ones by key."""
    e = table(spark, sf_dir, "events")
    m = e.select("user_id", "event_type", "value", F.lit(0).alias("priority"), "event_id").unionByName(e.filter("event_id % 5 = 0").select("user_id", "event_type", (F.col("value") * 2).alias("value"), F.lit(1).alias("priority"), "event_id"))
    return M.coalesce_rows(m, ["user_id", "event_type"], "value", ["priority", "event_id"]).select("user_id", "event_type", _nine(F.col("value")).alias("value"))


@query("""
with s as (select lang, string_agg(text, chr(10) || chr(10) order by k) as shots from (select lang, text, row_number() over (partition by lang order by doc_id) as k from documents) where k <= 3 group by lang)
select doc_id, lang, shots from documents left join s using (lang)""")
def few_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first texts of a subject in front of its questions."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return C.shots(d, d.select("doc_id", "lang"), "lang", "doc_id", "text", 3)


@query(f"select doc_id from documents where {UNIT.format(chr(39) + '5|' + chr(39) + ' || doc_id')} / 4503599627370496.0 < 0.3")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic sample."""
    return C.sample(table(spark, sf_dir, "documents"), 0.3, 5, "doc_id").select("doc_id")


@query("select doc_id, cast(cast(('0x' || substr(sha256(cast(doc_id as varchar)), 1, 16)) as ubigint) % 7 as bigint) as shard, doc_id % 4 as turn, md5('3|' || doc_id) as order_key from documents")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by hash and in turn, and a seeded order."""
    d = C.shuffled(table(spark, sf_dir, "documents"), 3, "doc_id")
    return d.select("doc_id", H.shard_of(F.col("doc_id").cast("string"), 7).alias("shard"), (F.col("doc_id") % 4).alias("turn"), "order_key")


@query("select o_orderkey, d.doc_id, d.lang from orders join documents d on d.doc_id = o_orderkey % (select count(*) from documents)")
def cyclic_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request i takes seed i mod n."""
    seeds = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.cyclic(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seeds, "doc_id", seeds.count())


@query("select source, lang, doc_id from (select *, row_number() over (partition by source, lang order by doc_id) as k from documents) where k <= 5")
def category_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five rows of each file and category, first come."""
    return C.cap(table(spark, sf_dir, "documents"), ["source", "lang"], [F.col("doc_id")], 5).select("source", "lang", "doc_id")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as k from documents) where k <= 10 order by source, doc_id limit 120")
def proportional_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target dealt over files."""
    return C.proportional_cap(table(spark, sf_dir, "documents"), "source", "doc_id", 120, 12).select("source", "doc_id")


@query("select p_brand, p_partkey, p_retailprice, rank from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part) where rank <= 3")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top rows of each group."""
    return C.top_k(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "p_retailprice", F.col("rank").cast("long").alias("rank"))


@query("select source, doc_id from (select source, doc_id, sum(n_chars) over (partition by source order by doc_id) - n_chars as b, row_number() over (partition by source order by doc_id) as k from documents) where b < 50000 or k = 1")
def token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest prefix that reaches a token target."""
    return C.prefix_budget(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 50000).select("source", "doc_id")


@query("select source, pass, doc_id from (select source, doc_id, pass, sum(n_chars) over (partition by source order by pass, doc_id) - n_chars as b from documents, (select unnest([0, 1, 2]) as pass)) where b <= 200000")
def token_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passes up to a token budget."""
    return C.budget_passes(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], "n_chars", 200000, 3).select("source", "pass", "doc_id")


@query("select doc_id, unnest(range(0, n_chars, 1600)) as at from documents")
def response_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets at which a long response is cut."""
    return table(spark, sf_dir, "documents").filter("n_chars > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(1600).cast("long"))).alias("at"))


@query("""
with r as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents)
select source, doc_id from r where n <= 6 or i in (select round_even(k * (n - 1) / 5.0, 0) from range(6) t(k))""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced rows of each group."""
    return C.evenly_spaced(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], 6).select("source", "doc_id")


@query("select doc_id, cast((row_number() over (order by doc_id) - 1) // 64 as int) as shard from documents")
def row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of rows."""
    return C.row_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64)


@query("with s as (select doc_id, octet_length(encode(text)) + 1 as n, sum(octet_length(encode(text)) + 1) over (order by doc_id) as upto, sum(octet_length(encode(text)) + 1) over () as total from documents) select doc_id, cast(least((upto - n) // greatest(1, total // 8), 7) as int) as shard from s")
def byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of about equal bytes."""
    return C.byte_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 8).select("doc_id", "shard")


@query("select a.n_name as one, b.r_name as two, i from nation a cross join region b cross join (select unnest([0, 1]) as i)")
def request_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of two short lists, several times."""
    return C.product(table(spark, sf_dir, "nation").select(F.col("n_name").alias("one")), table(spark, sf_dir, "region").select(F.col("r_name").alias("two")), 2)


@query("select lang, count(*) as n, round(avg(case when quality = 1 then 1.0 else 0 end), 9) as accuracy, round(avg(cast(toxic as double)), 9) as invalid, round(sqrt(avg(cast(quality as double)) * (1 - avg(cast(quality as double))) / count(*)), 9) as stderr from documents join labels using (doc_id) group by lang")
def accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, invalid rate and error by group."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = M.accuracy(d, ["lang"], F.col("quality") == 1, F.col("toxic") == 1)
    return out.select("lang", "n", *[_nine(F.col(c)).alias(c) for c in ("accuracy", "invalid", "stderr")])


@query("select lang, count(*) as n, round(avg(case when toxic = 1 then 0.25 else quality end), 9) as accuracy from documents join labels using (doc_id) group by lang")
def credited_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy where an invalid answer earns a guess."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.guess_credited(d, ["lang"], F.col("quality") == 1, F.col("toxic") == 1, F.lit(4)).select("lang", "n", _nine(F.col("accuracy")).alias("accuracy"))


@query("select count(*) as n, round(avg(a), 9) as macro_accuracy from (select source, avg(cast(quality as double)) as a from documents join labels using (doc_id) group by source)")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of subject accuracies."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.macro(d, "source", F.col("quality") == 1).select("n", _nine(F.col("macro_accuracy")).alias("macro_accuracy"))


@query("select event_type, cast(sum(user_id % 7 + 1) as bigint) as n, round(sum(value * (user_id % 7 + 1)) / sum(case when value is not null then user_id % 7 + 1 end), 6) as value from events group by event_type")
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means over shards (A10)."""
    e = table(spark, sf_dir, "events").withColumn("w", F.col("user_id") % 7 + 1)
    return M.weighted_merge(e, ["event_type"], "value", "w").select("event_type", "n", F.round("value", 6).alias("value"))


@query("select user_id, count(*) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value) / sqrt(count(*)), 0), 6) as stderr from events where value is not null group by user_id")
def means_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and standard error."""
    out = M.mean_stderr(table(spark, sf_dir, "events"), ["user_id"], F.col("value"))
    return out.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("stderr", 6).alias("stderr"))


@query("select source, count(g) as n, round(avg(g), 9) as accuracy from (select source, case when doc_id % 5 = 0 then 0.5 when quality = 1 then 1.0 when toxic = 0 then 0.0 end as g from documents join labels using (doc_id)) group by source")
def letter_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy from letter grades with partial credit."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    letter = F.when(F.col("doc_id") % 5 == 0, "P").when(F.col("quality") == 1, "C").when(F.col("toxic") == 0, "I").otherwise("X")
    g = M.letter_grade(letter, partial=True)
    return d.select("source", g.alias("g")).groupBy("source").agg(F.count("g").alias("n"), _nine(F.avg("g")).alias("accuracy"))


_PAIRS = "select cast(quality as varchar) as t, case when n_chars < 100 then null when n_chars > 800 then '1' else '0' end as p from documents join labels using (doc_id)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("quality").cast("string").alias("t"), F.when(F.col("n_chars") < 100, None).when(F.col("n_chars") > 800, "1").otherwise("0").alias("p"))


@query(f"with x as ({_PAIRS}) select round((select sum(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2 from (select l, count(*) filter (t = l and p = l) as tp, count(*) filter (t <> l and p = l) as fp, count(*) filter (t = l and p is distinct from l) as fn from x, (select unnest(['0', '1']) as l) group by l)), 9) as macro_f1")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 (A13)."""
    return M.macro_f1(_pairs(spark, sf_dir), "t", "p", ["0", "1"]).select(_nine(F.col("macro_f1")).alias("macro_f1"))


@query(f"""
with x as (select t, coalesce(p, '__invalid__') as p from ({_PAIRS})), k as (select unnest(['0', '1', '__invalid__']) as k),
c as (select k, (select count(*) from x where t = k) as nt, (select count(*) from x where p = k) as np, (select count(*) from x where t = k and p = k) as ok from k),
s as (select cast(sum(nt) as double) as s, cast(sum(ok) as double) as c, cast(sum(nt * np) as double) as tp, cast(sum(nt * nt) as double) as tt, cast(sum(np * np) as double) as pp from c)
select round(case when sqrt((s * s - tt) * (s * s - pp)) > 0 then (c * s - tp) / sqrt((s * s - tt) * (s * s - pp)) else 0 end, 9) as mcc from s""")
def matthews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matthews correlation with a class for invalid answers."""
    return M.matthews(_pairs(spark, sf_dir), "t", "p").select(_nine(F.col("mcc")).alias("mcc"))


@query(rf"""
with t as (select source, {WORDS.format("text")} as w from documents),
w as (select source, list_distinct(w[1:2 * len(w) // 3]) as a, list_distinct(w[len(w) // 3 + 1:]) as b from t),
c as (select source, len(list_intersect(a, b)) as tp, len(a) - len(list_intersect(a, b)) as fp, len(b) - len(list_intersect(a, b)) as fn from w),
s as (select source, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, avg(case when fp + fn = 0 then 1.0 else 0.0 end) as exact from c group by source)
select source, tp, fp, fn, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall, round(2.0 * tp / (2 * tp + fp + fn), 9) as f1, round(exact, 9) as exact from s""")
def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall over sets."""
    w = X.words(F.col("text"))
    d = table(spark, sf_dir, "documents").select("source", w.alias("w"))
    d = d.selectExpr("source", "slice(w, 1, 2 * size(w) div 3) as a", "slice(w, size(w) div 3 + 1, size(w)) as b")
    out = M.set_scores(d, ["source"], "a", "b")
    return out.select("source", "tp", "fp", "fn", *[_nine(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "exact")])


@query("""
with m as (select avg(value) as m, count(*) as n from events), s as (select user_id, sum(value) as s, count(*) as k from events group by user_id)
select round(m, 6) as mean, round(sqrt(sum(pow(s - k * m, 2)) * count(*) / (count(*) - 1)) / n, 6) as stderr, n from s, m group by m, n""")
def clustered_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster-robust error of a mean."""
    out = M.clustered_error(table(spark, sf_dir, "events"), "user_id", "value")
    return out.select(F.round("mean", 6).alias("mean"), F.round("stderr", 6).alias("stderr"), "n")


@query("""
with c as (select user_id, count(*) as n, count(*) filter (event_type = 'click') as c from events group by user_id having count(*) >= 3)
select user_id, n, c, round(case when n - c < 3 then 1.0 else 1.0 - (n - c) / n * (n - c - 1) / (n - 1) * (n - c - 2) / (n - 2) end, 9) as pass from c""")
def pass_at_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbiased pass@3."""
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("c")).filter("n >= 3")
    return c.select("user_id", "n", "c", _nine(M.pass_at_k(F.col("n"), F.col("c"), 3)).alias("pass"))


@query("""
with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2)
select user_id, event_type as majority, n as votes from (select *, row_number() over (partition by user_id order by n desc, f) as k from c) where k = 1""")
def majority_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent vote, ties to the first seen."""
    return M.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("""
with v as (select user_id, event_type, case when avg(value) > 100 then null when avg(value) < 0 then 0 when avg(value) > 1 then avg(value) / 100 else avg(value) end as v from events group by 1, 2)
select user_id, round(avg(v), 9) as average, count(v) as n, round(case when count(v) = 3 then avg(v) end, 9) as complete from v group by user_id""")
def suite_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of normalised metrics, and only where all are there."""
    v = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("a")).withColumn("v", M.normalised(F.col("event_type"), F.col("a")))
    loose, strict = M.section_averages(v, [], "user_id", "v"), M.section_averages(v, [], "user_id", "v", expected=3)
    return loose.select("user_id", _nine(F.col("average")).alias("average"), "n").join(strict.select("user_id", _nine(F.col("average")).alias("complete")), "user_id")


@query("select user_id, event_type, arg_max(value, (ts, event_id)) as value from events where value is not null group by user_id, event_type")
def coalesced_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each key of a sparse history."""
    return M.coalesce_rows(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("""
select user_id, event_id, f as filled from (select user_id, event_id, f, row_number() over (partition by user_id order by f desc, event_id) as k
  from (select user_id, event_id, length(props) as f from events)) where k = 1""")
def fullest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with most in it for each key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.length("props").cast("long").alias("filled"))
    return M.fullest_row(e, "user_id", "filled", "event_id")


@query("""
select min(event_id) as least, max(event_id) as most, 200 - count(distinct case when event_id < 200 then event_id end) as missing, count(*) filter (event_type like 'view%') as forbidden from events""")
def history_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required steps that are missing, ends, and forbidden names."""
    e = table(spark, sf_dir, "events")
    return e.agg(F.min("event_id").alias("least"), F.max("event_id").alias("most"), (200 - F.count_distinct(F.when(F.col("event_id") < 200, F.col("event_id")))).alias("missing"), F.count_if(F.col("event_type").startswith("view")).alias("forbidden"))


@query("select event_id, round(case when event_id < 100 then event_id * 0.01 when event_id < 500 then 1 + (event_id - 100) * 0.0025 else 2 + (event_id - 500) * 0.002 end, 9) as epoch from events")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps mapped to epochs by interpolation."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", _nine(M.interpolated(e, "event_id", [(0, 0), (100, 1), (500, 2), (1000, 3)])).alias("epoch"))


@query("""
select user_id, event_type, round(sum(value), 4) as total, count(*) as n from events group by grouping sets ((user_id), (event_type), ())""")
def nested_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters at several levels."""
    e = table(spark, sf_dir, "events")
    return e.groupingSets([[F.col("user_id")], [F.col("event_type")], []], "user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query("""
select source, cast(coalesce(sum(n_chars) filter (quality = 1), 0) as bigint) as tokens, 20000 as target, coalesce(sum(n_chars) filter (quality = 1), 0) >= 20000 as complete, round(count(*) filter (quality = 0) / count(*), 9) as reject_rate
from documents join labels using (doc_id) group by source""")
def token_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of kept tokens towards a target."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.token_progress(d, "source", F.col("quality") == 1, "n_chars", F.lit(20000)).withColumn("reject_rate", _nine(F.col("reject_rate")))


@query("""
select event_type, count(*) as attempts, count(*) filter (user_id % 3 <> 0) as successes, count(*) filter (user_id % 9 = 0) as ooms, max(user_id) filter (user_id % 3 <> 0) as max_batch,
  min(event_id) filter (user_id % 3 <> 0) as min_free, cast(trunc(median(event_id) filter (user_id % 3 <> 0)) as bigint) as median_free, max(event_id) filter (user_id % 3 <> 0) as max_free from events group by event_type""")
def attempt_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and what memory they found."""
    return M.attempts(table(spark, sf_dir, "events"), ["event_type"], F.col("user_id") % 3 != 0, F.col("user_id") % 9 == 0, "user_id", "event_id")


@query("""
with j as (select user_id, max(epoch(ts)) filter (event_type = 'view') as s, max(epoch(ts)) filter (event_type = 'purchase') as e from (select user_id, event_type, date_trunc('second', ts) as ts from events) group by user_id)
select count(*) as jobs, cast(sum(e - s) as bigint) as seconds, cast(max(e) - min(s) as bigint) as wall from j where s is not null and e is not null""")
def job_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between two events of a job."""
    return M.intervals(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "view", "purchase")


@query("""
select user_id, e as event_type, ts from (select user_id, arg_max(event_type, (ts, event_id)) as e, max(ts) as ts from events where event_type in ('view', 'click', 'purchase') group by user_id) where e in ('view', 'click')""")
def open_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose last event is an opening one."""
    return M.open_jobs(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", ["view", "click"], ["purchase"])


@query("""
with e as (select user_id, event_id, event_id % 11 as done, event_id // 400 as total from events),
f as (select *, coalesce(done < lag(done) over w or total <> lag(total) over w, true) as fresh, row_number() over w as k from e window w as (partition by user_id order by event_id)),
l as (select *, sum(cast(fresh as int)) over (partition by user_id order by event_id) as loop from f)
select user_id, cast(loop as bigint) as loop, arg_max(done, k) as done, arg_max(total, k) as total, count(*) as points from l group by user_id, loop""")
def progress_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a counter."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 11).alias("done"), F.expr("event_id div 400").alias("total"))
    return M.loops(e, "user_id", ["event_id"], "done", "total")


@query("select p_partkey, cast((row_number() over (order by p_retailprice desc, p_partkey) - 1) % 8 as bigint) as lane from part")
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources dealt in turn by weight."""
    return M.round_robin(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", 8).select("p_partkey", F.col("lane").cast("long").alias("lane"))


@query("""
select source, case when n_chars < 300 then 'short' when toxic = 1 then 'toxic' when quality = 0 then 'poor' else 'fine' end as bucket, count(*) as n, min(doc_id) as example from documents join labels using (doc_id) group by 1, 2""")
def failure_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules to buckets, with an example."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    bucket = F.when(F.col("n_chars") < 300, "short").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("fine")
    return M.failures(d, ["source"], bucket, "doc_id")


@query("select user_id, event_type || '/mean' as key, round(avg(value), 6) as value from events group by 1, 2 union all select user_id, event_type || '/n', count(*) from events group by user_id, event_type")
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metric rows as long ones."""
    w = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").cast("double").alias("n"))
    return w.unpivot(["user_id", "event_type"], ["mean", "n"], "metric", "value").select("user_id", F.concat_ws("/", "event_type", "metric").alias("key"), "value")


@query(f"""
with r as (select doc_id, quality, round, {UNIT.format("'9|' || round || '|' || doc_id")} / 4503599627370496.0 as u from labels, (select unnest(range(40)) as round)),
w as (select round, quality, case when u >= 0.9963401531726563 then 5 when u >= 0.9810118431238462 then 4 when u >= 0.9196986029286058 then 3 when u >= 0.7357588823428847 then 2 when u >= 0.36787944117144233 then 1 else 0 end as w from r),
m as (select round, sum(w * quality) / sum(w) as m from w group by round)
select round(avg(m), 9) as mean, round(avg(m) - 1.96 * stddev_samp(m) / sqrt(count(*)), 9) as low, round(avg(m) + 1.96 * stddev_samp(m) / sqrt(count(*)), 9) as high from m""")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap mean and interval by hashed draws."""
    out = M.bootstrap(table(spark, sf_dir, "labels"), "doc_id", "quality", 40, 9)
    return out.select(*[_nine(F.col(c)).alias(c) for c in ("mean", "low", "high")])


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, arithmetic and grouped sums over a large table."""
    l = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.expr("timestamp_ntz '1998-09-02 00:00:00'"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
select lang, source, grouping(lang) + 2 * grouping(source) as level, count(*) as n, count(distinct source) as sources, quantile_disc(n_chars, 0.5) as median
from documents group by cube (lang, source)""")
def cubed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by every combination of keys, with distinct counts and medians."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "n_chars", F.col("source").alias("s"))
    level = F.grouping("lang").cast("long") + 2 * F.grouping("source").cast("long")
    return d.cube("lang", "source").agg(level.alias("level"), F.count("*").alias("n"), F.count_distinct("s").alias("sources"), F.percentile_approx("n_chars", 0.5, 1_000_000).alias("median"))


@query("""
select lang, source, grouping(source) as level, sum(n_chars)::bigint as chars, approx_count_distinct(doc_id) between 0.8 * count(distinct doc_id) and 1.2 * count(distinct doc_id) + 2 as close
from documents group by rollup (lang, source)""")
def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals along a hierarchy; approximate distinct counts, held against exact ones."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "n_chars", "doc_id")
    out = d.rollup("lang", "source").agg(F.grouping("source").cast("long").alias("level"), F.sum("n_chars").alias("chars"), F.approx_count_distinct("doc_id", 0.02).alias("a"), F.count_distinct("doc_id").alias("e"))
    return out.select("lang", "source", "level", "chars", F.col("a").between(0.8 * F.col("e"), 1.2 * F.col("e") + 2).alias("close"))


@query("""
with a as (select distinct lang, source, n_chars // 500 as size from documents where doc_id % 2 = 0), b as (select distinct lang, source, n_chars // 500 as size from documents where doc_id % 2 = 1)
select *, 'both' as side from (select * from a intersect select * from b) union all select *, 'first' from (select * from a except select * from b) union all select *, 'second' from (select * from b except select * from a)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two tables share and what only one has."""
    d = table(spark, sf_dir, "documents").selectExpr("lang", "source", "n_chars div 500 as size", "doc_id % 2 as half")
    a, b = (d.filter(F.col("half") == i).drop("half") for i in (0, 1))
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "first")).unionByName(side(b.subtract(a), "second"))
