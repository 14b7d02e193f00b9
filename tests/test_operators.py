"""Operators on small cases worked out by hand."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamline.functions import hashing as H
from loamline.functions import text as X
from loamline.operators import curate as C
from loamline.operators import expand as P
from loamline.operators import filters as R
from loamline.operators import measure as M
from loamline.operators import sequential as S
from loamline.plans import jobs as J
from loamline.sources import files, sinks


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column, **given):
    df = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return df.select(column.alias("v")).first()[0]


@pytest.fixture
def lengths(spark):
    return spark.createDataFrame([("a", i, n) for i, n in enumerate((5, 7, 3, 10))], "g string, i int, n long")


@pytest.mark.parametrize(("target", "rows", "total"), [(12, 2, 12), (13, 3, 15), (1, 1, 5)])
def test_prefix_reaches_target(lengths, target, rows, total):
    got = values(C.prefix_budget(lengths, ["g"], ["i"], "n", target), "n")
    assert len(got) == rows and sum(n for (n,) in got) == total


@pytest.mark.parametrize(("left", "rows"), [(12, 3), (11, 2)])
def test_budget_overshoots_by_a_row(lengths, left, rows):
    assert C.budget_passes(lengths, ["g"], ["i"], "n", left, 1).count() == rows


@pytest.mark.parametrize(("n", "k", "want"), [(10, 4, [0, 3, 6, 9]), (11, 5, [0, 2, 5, 8, 10]), (6, 3, [0, 2, 5])])
def test_even_sample(spark, n, k, want):
    df = spark.range(n).withColumn("g", F.lit(1))
    assert sorted(i for (i,) in values(C.evenly_spaced(df, ["g"], ["id"], k), "id")) == want


def test_lane_packing():
    batches = S.lane_pack([6, 5, 4, 3, 3, 2, 7, 1], 2, 10)
    assert len(batches[0]) == 4
    loads = [sum(n for n, lane in zip((6, 5, 4, 3), batches[0]) if lane == k) for k in (0, 1)]
    assert sum(loads) == 18 and max(loads) <= 10
    assert S.lane_pack([], 2, 10) == [] and S.lane_pack([3], 2, 10) == []


def test_merged_shards(spark):
    df = spark.createDataFrame([(10, 0.5, 0.1), (30, 0.8, None)], "n long, acc double, invalid double").withColumn("g", F.lit(1))
    assert values(M.weighted_merge(df, ["g"], "acc", "n"), "n", "value") == [(40, pytest.approx(0.725))]
    assert values(M.weighted_merge(df, ["g"], "invalid", "n"), "value") == [(pytest.approx(0.1),)]


def test_mean_and_error(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (1.0,), (1.0,), (float("nan"),), (None,)], "v double").withColumn("g", F.lit(1))
    assert values(M.mean_stderr(df, ["g"], F.col("v")), "n", "mean", "stderr") == [(4, 0.75, pytest.approx(0.25))]


def test_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("b", None)], "t string, p string")
    assert M.macro_f1(df, "t", "p", ["a", "b"]).first()[0] == pytest.approx(2 / 3)
    assert M.matthews(df, "t", "p").first()[0] == pytest.approx(0.308607, abs=1e-6)


def test_pass_at_k(spark):
    assert one(spark, M.pass_at_k(F.col("n"), F.col("c"), 3), n=10, c=2) == pytest.approx(0.533333, abs=1e-6)
    assert one(spark, M.pass_at_k(F.col("n"), F.col("c"), 3), n=4, c=2) == 1.0


def test_overlap(spark):
    a, b = "The quick brown fox jumps over the lazy dog", "A quick brown fox jumps over a log today"
    assert one(spark, R.gram_overlap(F.lit(b), F.lit(a))) == pytest.approx(0.2)
    assert one(spark, R.word_overlap(F.lit(a), F.lit(b))) == pytest.approx(0.625)
    assert one(spark, R.word_overlap(F.lit(""), F.lit(b))) == 0.0
    assert one(spark, F.size(X.ngrams(X.words(F.lit("für été naïve")), 2))) == 2


def test_retry(spark):
    assert [one(spark, X.retry_batch(F.lit(13), F.lit(a))) for a in range(5)] == [13, 7, 4, 2, 1]


def test_chunks(spark):
    df = spark.createDataFrame([("  abcdef  ",), ("",), (None,)], "t string")
    assert values(P.chunks(df, "t", 4), "chunk") == [("abcd",), ("ef",)]


def test_cleaning(spark):
    assert one(spark, X.clean_line(F.lit("a\t\n b  c "))) == "a b c"
    assert one(spark, X.clean_line(F.lit("abc def"), 4)) == "abc ..."
    assert one(spark, X.clean_block(F.lit(" a \t b\n\n\n\nc\0d "))) == "a b\n\nc d"
    assert one(spark, X.clean_blanks(F.lit(" a \t b\n c "))) == "a b\n c"
    assert one(spark, X.drop_end_mark(F.lit("a<|endoftext|>b"))) == "ab"


def test_answers(spark):
    cases = {"\\boxed{1} and \\boxed{\\frac{1}{2}} end": "\\frac{1}{2}", "\\fbox{ x }": "x", "\\boxed{open": None, "none": None}
    assert {t: one(spark, X.last_boxed(F.lit(t))) for t in cases} == cases
    assert [one(spark, X.to_integer(F.lit(t))) for t in ("$1,234.9", "-3.7", "x", "1e40")] == [1234, -3, None, None]
    assert [one(spark, X.choice_letter(F.lit(t))) for t in ("(A) or (C) B", "it is B", "no")] == ["C", "B", None]
    assert one(spark, X.outer_object(F.lit('say {"a": {"b": 1}} now'))) == '{"a": {"b": 1}}'
    assert one(spark, X.outer_object(F.lit("{no}"))) is None
    assert one(spark, X.cut_at_stop(F.lit("ab###c\nd"), ["\n", "###"])) == "ab"
    assert [one(spark, X.duration(F.lit(s))) for s in (3725.0, 184.0, 5.9)] == ["1h02m", "3m04s", "5s"]
    assert [one(spark, X.finite(F.lit(t))) for t in ("1.5", "nan", "inf", "x")] == [1.5, None, None, None]


def test_acceptance(spark):
    rule = R.acceptance(F.col("t"), preambles=("here is",), leak_words=("the", "of"), leak_limit=2, max_chars=F.lit(40), sentences=F.lit(2))
    cases = {"": "empty", "Here is it. Yes.": "preamble", "the end of. It.": "language_leak", "x" * 41: "too_long", "One. Two. Three.": "sentence_count", "En. To.": "accepted"}
    assert {t: one(spark, rule, t=t) for t in cases} == cases
    assert one(spark, R.acceptance(F.lit("1. a\n2) b\n- c"), numbered=F.lit(3))) == "accepted"


def test_hits(spark):
    hits = one(spark, R.unchanged_hits(F.lit("write a.b@c.org or call +45 12 34 56 78, Jane Doe"), F.lit("a.b@c.org Jane Doe")))
    assert sorted(hits) == ["Jane Doe", "a.b@c.org"]


def test_audit_segments(spark):
    h = R.heuristics(F.lit("Order:\n[1] first part\n[2] second part"), F.lit("Second part\nfirst part"))
    assert one(spark, h["num_segments"]) == 2 and one(spark, h["segments_present"]) == 2


def test_globs(spark):
    state = R.glob_state(F.col("p"), ["data/*"], ["*keep*"], ["*.txt"])
    assert {p: one(spark, state, p=p) for p in ("x", "data/a/b.txt", "data/keep/b.txt", "data/a.json")} == {"x": "not_included", "data/a/b.txt": "denied", "data/keep/b.txt": "allowed", "data/a.json": "allowed"}


def test_turns(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", " ask "), (1, 2, "assistant", "one"), (1, 3, "tool", ""), (1, 4, "assistant", "two"), (2, 0, "assistant", "alone")]
    got = values(P.assistant_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn"), "turn", "instruction", "response")
    assert got == [(2, "Assistant:\nhi\n\nUser:\nask", "one"), (4, "Assistant:\nhi\n\nUser:\nask\n\nAssistant:\none", "two")]


def test_messages_and_arrays(spark):
    m = one(spark, P.to_messages(F.lit("cot"), F.lit("q"), F.lit("a")))
    assert [(x.role, x.content) for x in m] == [("system", "Task condition: cot"), ("user", "q"), ("assistant", "a")]
    p = P.prefix_lm(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (4, 5))))
    assert [one(spark, p[k]) for k in ("inputs", "labels", "positions")] == [[1, 2, 3, 4], [-100, -100, 4, 5], [0, 1, 2, 3]]


def test_sections(spark):
    text = "Title\nFirst\nbody one.\nmore.\nWhat?\nbody two.\n1. not a heading\nLast"
    got = values(P.titled_sections(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("section"), "title", "heading", "body")
    assert got == [("Title", "First", "body one.\nmore."), ("Title", "What?", "body two.\n1. not a heading\nLast")]


def test_join_policies(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(values(C.union_base_wins(a, b, "k"), "k", "v")) == [(1, "a"), (2, "b"), (3, "d")]
    assert C.union_or_fail([a, b.filter("k = 3")], "k").count() == 3
    with pytest.raises(Exception, match="key occurs twice"):
        C.union_or_fail([a, b], "k").collect()
    assert sorted(values(C.prefix_rule(a, "v", [("a", 5)], 1), "v", "repeat")) == [("a", 5), ("b", 1)]
    assert C.duplicate_ids(a.unionByName(a), "k").count() == 2


def test_interpolation_and_lanes(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (300.0,), (700.0,)], "x double")
    assert [round(v, 9) for (v,) in values(df.select(M.interpolated(df, "x", [(0, 0), (100, 1), (500, 2)]).alias("y")), "y")] == [0.0, 0.5, 1.5, 2.5]
    assert M.lane_finish([5, 4, 3], [2, 0], 2) == 8


def test_clusters(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (3, 1.0)], "c int, v double")
    got = M.clustered_error(df, "c", "v").first()
    v = sum((s - k * 0.75) ** 2 for s, k in ((2, 2), (0, 1), (1, 1)))
    assert got.mean == 0.75 and got.stderr == pytest.approx(np.sqrt(v * 3 / 2) / 4)


def test_text_tasks():
    text = " ".join(f"word{i}" for i in range(60))
    assert S.corrupt_words(text, 1) == S.corrupt_words(text, 1) != text and S.corrupt_words("a b c", 1) == "a b c"
    masked, hidden = S.mask_spans(text, 2)
    assert hidden and sum(len(h.split()) for h in hidden) <= 9
    for k, h in enumerate(hidden, 1):
        masked = masked.replace(f"<mask_{k}>", h)
    assert masked == text
    assert S.split_at_boundaries("One two. Three four. Five", 12) == ["One two.", "Three", "four. Five"]
    assert S.split_at_boundaries("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and S.split_at_boundaries("  ", 9) == []
    assert S.trim_to_sentence("One two. Three four", 12) == "One two." and S.trim_to_sentence("abcdefgh", 4) == "abcd"
    parts = [f"paragraph {i} " + "y" * 80 for i in range(4)]
    (mixed, plain), = S.reordered_paragraphs("\n\n".join(parts), 3)
    assert plain == "\n\n".join(parts) and sorted(line.split("] ", 1)[1] for line in mixed.split("\n")) == sorted(parts)
    assert "[noise]" in S.noisy_words(text * 20, 1)


def test_goldfish():
    inputs = np.arange(1, 65)
    labels = inputs.copy()
    out = S.goldfish_mask(labels, inputs, np.array([0, 32]), 4, 8, 123)
    assert (out == S.goldfish_mask(labels, inputs, np.array([0, 32]), 4, 8, 123)).all()
    assert (out[:32] == -100).any() and (out[32:] == -100).any() and 4 < (out == -100).sum() < 32
    other = inputs.copy()
    other[31] = 999  # the last of the first sequence changes nothing in the second
    assert (S.goldfish_mask(labels, other, np.array([0, 32]), 4, 8, 123)[32:] == out[32:]).all()


def test_parsers():
    assert S.parse_calls('x {"name": "f", "arguments": "{\\"a\\": 1}"} {"no": 1}') == [("f", '{"a": 1}')]
    assert S.parse_calls("[get.it(a=1, b='x'), g()]") == [("get.it", '{"a": 1, "b": "x"}'), ("g", "{}")]
    assert S.parse_calls("nothing") == [] and S.parse_calls("[broken(") == []
    assert S.unique_names(["a b", "a_b", "9x", "", "a_b"]) == ["a_b", "a_b_2", "tool_9x", "unnamed", "a_b_3"]
    assert S.named_numbers({"a": {"b c": 1, "raw": {"x": 2}}, "d": True, "e": float("nan"), "f": 2.5}) == [("a/b_c", 1.0), ("f", 2.5)]
    assert S.front_matter("---\ntype: note\ntitle: \"T\"\n---\nbody") == ({"type": "note", "title": "T"}, "body") and S.front_matter("x") == ({}, "x")
    fenced = "# Parent\n## First\n```md\n## Not a concept\n```\n## Second\n"
    assert [h for h, _ in S.markdown_sections(fenced)] == ["First", "Second"]
    assert [h for h, _ in S.markdown_sections("## First\n```md\ncontent\n## Recovered\n", fenced=False)] == ["First", "Recovered"]
    assert S.rouge_n("a b c", "a b d") == pytest.approx(2 / 3)


def jobs(spark, *rows):
    return {r.job_id: r.satisfied for r in J.ready(spark.createDataFrame(list(rows), "job_id string, status string, deps array<string>, deps_mode string")).collect()}


def test_dependencies(spark):
    base = [("export", "FAILED", [], "success"), ("failed", "FAILED", ["export"], "success"), ("blocked", "PENDING", ["export"], "success")]
    assert jobs(spark, *base, ("barrier", "PENDING", ["failed", "blocked"], "terminal"))["barrier"]
    assert not jobs(spark, ("export", "DONE", [], "success"), ("retry", "PENDING", ["export"], "success"), ("barrier", "PENDING", ["retry"], "terminal"))["barrier"]
    assert not jobs(spark, ("eval", "FAILED", [], "success"), ("merge", "PENDING", ["eval"], "success"))["merge"]
    assert not jobs(spark, ("a", "PENDING", ["b"], "success"), ("b", "PENDING", ["a"], "success"))["a"]


def test_headroom(spark):
    gpus = spark.createDataFrame([(0, 30000), (1, 32000), (2, 40000)], "gpu int, free int")
    assert values(J.enough_memory(gpus, 34000), "gpu") == [(2,)] and J.enough_memory(gpus, 50000).count() == 0


def test_job_rows(spark):
    row = spark.createDataFrame([("a", "", '{"x": "1"}'), ("b", "p,q", "")], "job_id string, deps string, metadata string")
    got = {r.job_id: (r.deps, r.metadata) for r in J.row_to_job(row).collect()}
    assert got == {"a": ([], {"x": "1"}), "b": (["p", "q"], None)}
    assert sorted(values(J.job_to_row(J.row_to_job(row)), "job_id", "deps")) == [("a", ""), ("b", "p,q")]
    assert [one(spark, J.shard_total(F.lit(10), F.lit(i), F.lit(4))) for i in range(4)] == [3, 3, 2, 2]


def test_registry():
    r = J.Registry()
    r.register("web_*")(lambda: 1)
    r.register("web_x")(lambda: 2)
    assert r["web_x"]() == 2 and r["web_y"]() == 1
    with pytest.raises(KeyError):
        r["other"]
    with pytest.raises(KeyError):
        r.register("web_x")(lambda: 3)


def test_benchmark_settings():
    class Base(J.Benchmark):
        settings = {"shots": 5, "temperature": 0}

        def prompts(self): ...

        def metrics(self, answered): ...

    class Own(Base):
        settings = {"shots": 0}

    assert Own().options(temperature=1) == {"shots": 0, "temperature": 1}


def test_files(spark, tmp_path):
    (tmp_path / "v.npy").write_bytes(b"")
    np.save(tmp_path / "v.npy", np.array([3, 1, 2], np.uint32))
    assert values(files.numpy_vectors(spark, f"file://{tmp_path}/v.npy"), "values") == [([3, 1, 2],)]
    (tmp_path / "o.jsonl").write_text('{"a": 1}\n{"a":\n 2}{"a": 3}\n\0\n{"a": ')
    assert [r.json for r in files.json_objects(spark, f"file://{tmp_path}/o.jsonl").orderBy("idx").collect()] == ['{"a": 1}', '{"a": 2}', '{"a": 3}']
    (tmp_path / "c.md").write_text("---\ntype: note\n---\ntext\n")
    assert values(files.markdown(spark, f"file://{tmp_path}/c.md"), "meta", "body") == [({"type": "note"}, "text\n")]
    now = spark.read.format("binaryFile").load(f"file://{tmp_path}/*").select("path", "length", "modificationTime")
    assert files.changed_files(spark, f"file://{tmp_path}/*", now).count() == 0
    assert files.changed_files(spark, f"file://{tmp_path}/*", now.limit(1)).count() == 2
    assert {r.rows for r in sinks.checksums(spark, f"file://{tmp_path}/c.md").collect()} == {4}


def test_triplets(spark):
    df = spark.createDataFrame([(None, " q ", " a "), ("cot", "", "b"), ("", "q", " ")], "condition string, instruction string, response string")
    assert values(sinks.triplets(df), "condition", "instruction", "response") == [("direct", "q", "a"), ("cot", "", "b")]
    assert sinks.triplets(df, both_sides=True).count() == 1
    assert values(sinks.chat_lines(df), "value") == [('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',)]
    assert "| None |" not in sinks.report(df, "T") and "—" in sinks.report(df, "T")


def test_draws(spark):
    df = spark.range(20_000).select(H.draw(1, F.col("id")).alias("u"), H.pick(7, 1, F.col("id")).alias("k"), H.shard_of(F.col("id").cast("string"), 3).alias("s"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.count_distinct("k"), F.count_distinct("s")).first()
    assert abs(r[0] - 0.5) < 0.01 and r[1] >= 0 and r[2] < 1 and r[3] == 7 and r[4] == 3
    assert C.sample(spark.range(10), 1.0, 1, "id").count() == 10 and C.sample(spark.range(10), 0.0, 1, "id").count() == 0


def test_random_rows(spark):
    rows = sinks.sampled_dataset(S.random_rows(spark, 64, 5, 11, 512, 1), epochs=1, seed=1)
    assert rows.count() == 64 and rows.agg(F.max("start")).first()[0] == 63 * 16


def test_stream_append(spark, tmp_path):
    from loamline.streaming import events as E

    spark.range(10).selectExpr("id as event_id").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("event_id long").parquet(f"{tmp_path}/in")
        E.append_new(stream, "event_id", f"{tmp_path}/out", f"{tmp_path}/p")
        spark.range(5, 15).selectExpr("id as event_id").write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(15))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert pa.__version__


def test_running_sums_of_a_hot_group(spark):
    from loamline.operators.running import running_sum

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") < 2500, "hot").otherwise("cold")).alias("g"), "id", (F.col("id") % 11).alias("n"))
    want, sums = {}, {}
    for g, i, n in sorted(values(df, "g", "id", "n"), key=lambda r: r[1]):
        want[i] = sums[g] = sums.get(g, 0) + n
    assert dict(values(running_sum(df, ["g"], ["id"], F.col("n")), "id", "upto")) == want
    total = 0
    assert [u for _, u in sorted(values(running_sum(df, [], ["id"], F.col("n")), "id", "upto"))] == [total := total + i % 11 for i in range(3000)]
    assert running_sum(df.filter("id < 0"), ["g"], ["id"], F.col("n")).count() == 0


def test_report_leaves_nothing_out(spark):
    assert sinks.report(spark.range(1000), "T").count("\n| ") == 1002
    with pytest.raises(ValueError):
        sinks.report(spark.range(1001), "T")


def test_scores_against_plain_versions(spark):
    import math
    import random

    from loamline.operators import scoring as G

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    draw = random.Random(5)
    for _ in range(300):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(30))] for _ in range(2))
        assert G.common_subsequence(a, b) == longest(a, b)

    pairs = [("the cat sat on the mat.", "the cat lay on a mat!"), ("one two", "two one"), ("", "x"), (None, None), ("Ä b", "ä b")]
    df = spark.createDataFrame([(1, i, c, r) for i, (c, r) in enumerate(pairs)], "g int, i int, c string, r string")
    per = values(G.scored(df, ["i"], "c", "r").orderBy("i"), "rouge1", "rouge2", "rouge_l")
    assert per[0] == (2 * 4 / 12, 2 * 1 / 10, 2 * 4 / 12) and per[1] == (1.0, 0.0, 0.5) and per[2] == per[3] == (0.0, 0.0, 0.0) and per[4] == (1.0, 1.0, 1.0)
    got = G.corpus_scores(G.scored(df, ["g"], "c", "r"), ["g"]).first()

    def plain(beta, orders):
        p, r = [], []
        for n, of in orders:
            made = [[[tuple(of(t or "")[i : i + n]) for i in range(len(of(t or "")) - n + 1)] for t in pair] for pair in pairs]
            shared = sum(min(c.count(g), r.count(g)) for c, r in made for g in set(c))
            sizes = [sum(len(x[side]) for x in made) for side in (0, 1)]
            if all(sizes):
                p.append(shared / sizes[0])
                r.append(shared / sizes[1])
        p, r = sum(p) / len(p), sum(r) / len(r)
        return 100 * (1 + beta**2) * p * r / (beta**2 * p + r)

    chars, tokens = (lambda t: [*"".join(t.split())]), (lambda t: re.findall(r"\w+|[^\w\s]", t))
    assert math.isclose(got.chrf, plain(3, [(n, chars) for n in range(1, 7)]))
    assert math.isclose(got.chrf_pp, plain(3, [(n, chars) for n in range(1, 7)] + [(1, tokens), (2, tokens)]))
    same = G.corpus_scores(G.scored(df.filter("i = 0").withColumn("r", F.col("c")), ["g"], "c", "r"), ["g"]).first()
    assert all(math.isclose(same[k], 100) for k in ("bleu", "chrf", "chrf_pp"))
    none = G.corpus_scores(G.scored(df.filter("i = 2"), ["g"], "c", "r"), ["g"]).first()
    assert (none.bleu, none.chrf, none.rouge_l) == (0.0, 0.0, 0.0)


def test_trees_of_one_tokenizer(spark):
    a, b = (spark.createDataFrame(x, "k int") for x in ([(1,)], [(2,)]))
    assert C.union_alike([(a, {"v": 1}), (b, {"v": 1})], "k").count() == 2
    with pytest.raises(ValueError, match="different tokenizers"):
        C.union_alike([(a, {"v": 1}), (b, {"v": 2})], "k")
    with pytest.raises(ValueError, match="key occurs twice"):
        C.union_alike([(a, {}), (a, {})], "k")


def test_ids_of_a_tokenizer(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "ask\n", "an answer of words"), (2, "ask\n", ""), (3, "ask\n", "a")]
    got = dict(values(J.tokenised(spark.createDataFrame(rows, "id int, instruction string, response string"), J.encoder(path), lambda i, r: (i, i + r)), "id", "resp_tokens"))
    whole = J.encoder(path)("ask\nan answer of words")
    assert got[1] == whole[len(J.encoder(path)("ask\n")) :] and 2 not in got


def test_words_and_windows_by_hand(spark):
    turns = [("c", i, " ".join(["w"] * n)) for i, n in enumerate([3, 0, 2, 4, 0, 1])]
    got = sorted(values(P.turn_windows(spark.createDataFrame(turns, "conv_id string, turn int, text string"), budget=6, least=1, most=9), "turn", "first_turn", "turns", "words"))
    assert got == [(2, 0, 2, 3), (3, 0, 3, 5), (5, 1, 4, 6)]
    assert S.replaced_values({"a": ["a", 1, {"b": "ab"}]}, [("a", "b"), ("b", "c")]) == {"a": ["c", 1, {"b": "cc"}]}
    empty = spark.createDataFrame([], "k int, text string")
    assert C.text_matches(empty, "k", empty.withColumnRenamed("k", "j"), "j", "text", 3).count() == 0


def test_white_space_as_the_pattern_has_it(spark):
    import random

    draw = random.Random(3)
    texts = ["".join(draw.choice("ab \t\n\x0b\x85\xa0  ​ 　\x1c") for _ in range(draw.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    line = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^ +| +$", "")
    blanks = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), r"(?U)^\s+|\s+$", "")
    assert df.filter((X.strip(t) != plain) | (X.clean_line(t) != line) | (X.clean_blanks(t) != blanks)).count() == 0


def test_lanes_of_queues(spark):
    rows = [(b, i, s) for b in "ab" for i, s in enumerate([5.0, 4.0, 3.0, 9.0, 1.0][: 5 if b == "a" else 3])] + [("c", 0, None)]
    got = {r["b"]: (r["n"], r["finish"]) for r in M.lane_finishes(spark.createDataFrame(rows, "b string, i int, s double"), ["b"], "i", "s", [2, 0], 2).collect()}
    assert got == {"a": (5, M.lane_finish([5, 4, 3, 9, 1], [2, 0], 2)), "b": (3, M.lane_finish([5, 4, 3], [2, 0], 2)), "c": (1, 2.0)}
