"""One row to one or many: conversations, chunks, sections, tasks, training arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import hashing as H
from loamline.functions import text as X
from loamline.operators.running import running_sum


def role_label(role: Column) -> Column:
    """Known roles capitalised; others by their first letter."""
    return F.when(F.length(role) == 0, "Message").otherwise(F.initcap(role))


def assistant_turns(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each assistant turn with text: the labelled turns before it as instruction, skipped if there are none."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    body = X.strip(F.coalesce(F.col(text), F.lit("")))
    said = F.when(F.length(body) > 0, F.concat(role_label(F.lower(F.col(role))), F.lit(":\n"), body))
    out = turns.select(conv, turn, F.lower(F.col(role)).alias("_role"), body.alias("response"), F.array_join(F.collect_list(said).over(w), "\n\n").alias("instruction"))
    return out.filter("_role = 'assistant' and response <> '' and instruction <> ''").select(conv, turn, F.lit("direct").alias("condition"), "instruction", "response")


def to_messages(condition: Column, instruction: Column, response: Column) -> Column:
    """A triplet as messages; a condition other than ``direct`` becomes a system message."""
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    plain = F.array(m("user", instruction), m("assistant", response))
    return F.when(condition.isin("", "direct"), plain).otherwise(F.concat(F.array(m("system", F.concat(F.lit("Task condition: "), condition))), plain))


def first_text(df: DataFrame, names: list[str]) -> Column:
    """The first of the present columns with text that isn't blank, stripped."""
    present = [F.nullif(X.strip(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def both_ways(df: DataFrame, a: str, b: str, a_name: str, b_name: str) -> DataFrame:
    """Two translation rows for each pair with text on both sides."""
    pair = lambda x, y, to: F.struct(F.concat(F.lit(f"Translate to {to}:\n\n"), F.col(x)).alias("instruction"), F.col(y).alias("response"))
    full = df.filter((F.length(X.strip(F.col(a))) > 0) & (F.length(X.strip(F.col(b))) > 0))
    return full.select("*", F.inline(F.array(pair(a, b, b_name), pair(b, a, a_name))))


def chunks(df: DataFrame, text: str, width: int) -> DataFrame:
    """Slices of ``width`` characters of the stripped text, each stripped, empty ones left out; ``chunk_idx, chunk``."""
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(width)), lambda i: X.strip(F.substring(t, i + 1, F.lit(width))))
    parts = X.let(X.strip(F.coalesce(F.col(text), F.lit(""))), cut)
    return df.select("*", F.posexplode(parts).alias("chunk_idx", "chunk")).filter("chunk <> ''")


def is_heading(line: Column, following: Column) -> Column:
    """Whether a stripped line reads as a section heading."""
    numbered = line.rlike(r"^\d") & (line.endswith(")") | F.contains(F.substring(line, 1, 4), F.lit(".")))
    no = (F.length(line) == 0) | following.isNull() | (F.length(line) > 140) | F.substring(line, 1, 1).isin("·", "-", "*", "•") | numbered | line.rlike(r"^\d+$")
    return F.when(no, False).when(line.endswith("?"), True).otherwise(~F.substring(line, -1, 1).isin(".", "!", ":", ";", ","))


def titled_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, title, section, heading, body`` of each headed part after the first line."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), X.strip), lambda s: F.length(s) > 0)
    rows = df.select(key, F.posexplode(lines).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("next", F.lead("line").over(w)).withColumn("title", F.first("line").over(w))
    rows = rows.filter("pos > 0").withColumn("head", is_heading(F.col("line"), F.col("next")))
    rows = rows.withColumn("section", F.sum(F.col("head").cast("int")).over(w)).filter("section > 0")
    grouped = rows.groupBy(key, "title", "section").agg(F.min_by("line", "pos").alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("body"))
    body = F.array_join(F.transform("body", lambda r: r["line"]), "\n")
    return grouped.select(key, "title", "section", "heading", body.alias("body")).filter("body <> ''")


def prefix_task(df: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    """A text cut at a drawn place between a quarter and three quarters, moved on to white space: ``prefix, suffix``."""
    n, t = F.length(text), F.col(text)
    at = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * (0.25 + 0.5 * H.draw(seed, F.col(key)))).cast("int")))
    rest = F.substring(t, at + 1, n)
    more = F.length(F.regexp_extract(rest, r"^\S*", 0))
    cut = F.least(at + more, F.greatest(at, n - 1))
    parts = df.filter(n > 1).select(key, X.strip(F.substring(t, F.lit(1), cut)).alias("prefix"), X.strip(F.substring(t, cut + 1, n)).alias("suffix"))
    return parts.filter("prefix <> '' and suffix <> ''")


def turn_windows(turns: DataFrame, *, budget: int, least: int, most: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """For each turn of ``least`` to ``most`` words, the longest run of turns that ends before it within ``budget`` words."""
    w = Window.partitionBy(conv).orderBy(turn)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = turns.select(conv, turn, F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("n"))
    placed = sized.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("_i", F.row_number().over(w))
    within = Window.partitionBy(conv).orderBy("before").rangeBetween(-budget, Window.currentRow)
    found = placed.withColumn("first", F.min(F.struct("_i", turn, "before")).over(within))
    out = found.filter(F.col("n").between(least, most) & (F.col("first._i") < F.col("_i")))
    return out.select(conv, turn, F.col(f"first.{turn}").alias("first_turn"), (F.col("_i") - F.col("first._i")).cast("long").alias("turns"), (F.col("before") - F.col("first.before")).alias("words"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """First user turn as prompt, first and last assistant turns as rejected and chosen, where these differ."""
    by = lambda role, f: f(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    out = turns.groupBy("conv_id").agg(by("user", F.min_by).alias("prompt"), by("assistant", F.max_by).alias("chosen"), by("assistant", F.min_by).alias("rejected"))
    return out.filter("prompt is not null and chosen is not null and chosen <> rejected")


def prefix_lm(instruction: Column, response: Column) -> dict[str, Column]:
    """Inputs, labels and positions of a PrefixLM row: only the response is a target."""
    inputs = F.concat(instruction, F.slice(response, F.lit(1), F.greatest(F.size(response) - 1, F.lit(0))))
    labels = F.concat(F.array_repeat(F.lit(-100), F.greatest(F.size(instruction) - 1, F.lit(0))), response)
    return {"inputs": inputs, "labels": labels, "positions": F.transform(inputs, lambda x, i: i)}


def offsets(df: DataFrame, by: list[str], order: list[str], length: str) -> DataFrame:
    """``start``: the summed lengths of the rows before, within ``by``."""
    return running_sum(df, by, order, F.col(length), "start").withColumn("start", F.col("start") - F.col(length))
