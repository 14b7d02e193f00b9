"""Row shapes of common sources as triplets: each adapter is a function from a DataFrame to ``condition, instruction, response``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.functions import hashing as H
from loamline.functions import text as X
from loamline.plans.jobs import Registry
from loamline.sources.files import ANSWERS, PROMPTS

ADAPTERS = Registry()


def _triplet(df: DataFrame, instruction: Column, response: Column, condition: Column | str = "direct", *keep: str) -> DataFrame:
    cond = condition if isinstance(condition, Column) else F.lit(condition)
    return df.select(*keep, cond.alias("condition"), X.strip(instruction).alias("instruction"), X.strip(response).alias("response")).filter("response <> ''")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@ADAPTERS.register("prompt_target")
def prompt_target(df: DataFrame, *keep: str) -> DataFrame:
    """Prompt and target; a ``reasoning`` column makes the condition ``cot`` and goes in front of the target where it has text."""
    if "reasoning" not in df.columns:
        return _triplet(df, _text("prompt"), _text("target"), "direct", *keep)
    why = X.strip(_text("reasoning"))
    return _triplet(df, _text("prompt"), F.when(why != "", F.concat(why, F.lit("\n\n"), _text("target"))).otherwise(_text("target")), "cot", *keep)


@ADAPTERS.register("extractive_qa")
def extractive_qa(df: DataFrame, *keep: str) -> DataFrame:
    """Context, question, and the first answer that isn't blank; rows without one go."""
    answer = F.get(F.filter("answers", lambda a: X.strip(a) != ""), 0)
    return _triplet(df.filter(answer.isNotNull()), F.concat(_text("context"), F.lit("\n\n"), _text("question")), answer, "direct", *keep)


@ADAPTERS.register("instruction_output")
def instruction_output(df: DataFrame, *keep: str) -> DataFrame:
    """``output`` is preferred to ``response``."""
    return _triplet(df, _text("instruction"), _text("output" if "output" in df.columns else "response"), "direct", *keep)


@ADAPTERS.register("generic")
def generic(df: DataFrame, *keep: str) -> DataFrame:
    """The first known prompt and answer column with text."""
    first = lambda names: F.coalesce(*[F.nullif(X.strip(_text(n)), F.lit("")) for n in names if n in df.columns], F.lit(""))
    return _triplet(df, first(PROMPTS), first(ANSWERS), "direct", *keep).filter("instruction <> ''")


@ADAPTERS.register("edit_pair")
def edit_pair(df: DataFrame, prompts: dict[str, str], *keep: str, default: str = "Rewrite the text.") -> DataFrame:
    """Edits by task; rows whose text doesn't change go."""
    prompt = F.lit(default)
    for task, text in reversed(prompts.items()):
        prompt = F.when(F.lower("task") == task, text).otherwise(prompt)
    return _triplet(df.filter(X.strip(_text("src")) != X.strip(_text("tgt"))), F.concat(prompt, F.lit("\n\n"), _text("src")), _text("tgt"), "direct", *keep)


@ADAPTERS.register("instruction_task")
def instruction_task(df: DataFrame, *keep: str, first: bool = True) -> DataFrame:
    """A definition and inputs; of several targets the first, or all as a list in text."""
    target = F.get("targets", 0) if first else F.concat(F.lit("['"), F.array_join("targets", "', '"), F.lit("']"))
    return _triplet(df, F.concat(_text("definition"), F.lit("\n\n"), _text("inputs")), F.coalesce(target, F.lit("")), "direct", *keep)


@ADAPTERS.register("valid_math")
def valid_math(df: DataFrame, *keep: str) -> DataFrame:
    """Problems and solutions both marked valid."""
    return _triplet(df.filter("problem_is_valid = 'Yes' and solution_is_valid = 'Yes'"), _text("problem"), _text("solution"), "cot", *keep)


@ADAPTERS.register("abstract")
def abstract(df: DataFrame, text: str, *keep: str, least: int = 120, body: int = 500) -> DataFrame:
    """A text under a heading ``abstract`` up to the next blank line as response, and what follows as instruction."""
    found = F.regexp_extract(text, r"(?is)\babstract\b[.:\s]*(.*?)(?:\n\s*\n|\z)", 1)
    rest = F.regexp_extract(text, r"(?is)\babstract\b.*?\n\s*\n(.*)\z", 1)
    rows = df.filter((F.length(X.strip(found)) >= least) & (F.length(X.strip(rest)) >= body))
    return _triplet(rows, F.concat(F.lit("Summarise:\n\n"), rest), found, "direct", *keep)


@ADAPTERS.register("summary_cascade")
def summary_cascade(df: DataFrame, text: str, summaries: list[str], budget: int, *keep: str) -> DataFrame:
    """The first summary that leaves the text room in the budget."""
    fits = [F.when((F.length(X.strip(_text(s))) > 0) & (F.length(_text(s)) + F.length(_text(text)) <= budget), _text(s)) for s in summaries]
    return _triplet(df, F.concat(F.lit("Summarise:\n\n"), _text(text)), F.coalesce(*fits, F.lit("")), "direct", *keep)


@ADAPTERS.register("last_question")
def last_question(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """What stands behind the last ``Question:`` up to ``Answer:``, and what follows that."""
    tail = F.substring_index(text, "Question:", -1)
    return _triplet(df, F.substring_index(tail, "Answer:", 1), F.when(F.contains(tail, F.lit("Answer:")), F.substring_index(tail, "Answer:", -1)).otherwise(""), "math,mcq", *keep)


def choice_text(options: Column, answer: Column) -> Column:
    """An option named by letter, number from 0, or its own text without regard to case and blanks."""
    by_letter = F.get(options, F.ascii(F.upper(answer)) - 65)
    by_number = F.get(options, answer.try_cast("int"))
    same = F.get(F.filter(options, lambda o: F.lower(X.strip(o)) == F.lower(X.strip(answer))), 0)
    return F.coalesce(F.when(answer.rlike("^[A-Za-z]$"), by_letter), F.when(answer.rlike(r"^\d+$"), by_number), same)


def templated(df: DataFrame, templates: list[str], seed: int, key: str, text: str) -> DataFrame:
    """One of several templates for each row, drawn by hash, with ``{text}`` filled in."""
    chosen = F.element_at(F.array(*map(F.lit, templates)), (H.pick(len(templates), seed, F.col(key)) + 1).cast("int"))
    return df.select(key, F.replace(chosen, F.lit("{text}"), F.col(text)).alias("instruction"))


def document_issues(docs: DataFrame, links: DataFrame, *, kinds: tuple[str, ...], most_bytes: int = 50_000) -> DataFrame:
    """Rules of a document bundle (``path, kind, size``; ``source, target`` links): ``path, issue``.

    A type that isn't known, too many bytes, a folder without index, a document that its index doesn't list, a link to nothing.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    rows = docs.select("path", "kind", "size", name.alias("name"), folder.alias("folder"))
    leaves = rows.filter("name <> 'index.md'")
    index = rows.filter("name = 'index.md'").select("folder", F.col("path").alias("index"))
    own = rows.select("path", F.explode(F.array_compact(F.array(F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)) & (F.col("name") != "index.md"), F.lit("unknown type")), F.when(F.col("size") >= most_bytes, F.lit("too large"))))).alias("issue"))
    bare = leaves.join(index, "folder", "left_anti").select(F.col("folder").alias("path"), F.lit("no index").alias("issue")).distinct()
    listed = links.select(F.col("source").alias("index"), F.col("target").alias("path"))
    unlisted = leaves.join(index, "folder").join(listed, ["index", "path"], "left_anti").select("path", F.lit("not listed").alias("issue"))
    dead = links.join(docs.select(F.col("path").alias("target")), "target", "left_anti").select(F.col("source").alias("path"), F.lit("dead link").alias("issue")).distinct()
    return own.unionByName(bare).unionByName(unlisted).unionByName(dead)


def archive_choice(archives: DataFrame) -> DataFrame:
    """Of the archives of a family, epoch and task with samples and all members, the one with most samples, then the latest, then by path."""
    fit = archives.filter("n > 0 and complete")
    return fit.groupBy("family", "epoch", "task").agg(F.max_by("path", F.struct("n", "mtime", "path")).alias("path"))
