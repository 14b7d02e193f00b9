"""Predicates and quality rules as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions import text as X

# fixed values
EMAIL = r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+\b"
PHONE = r"\b(\+?\d[\d .()/-]{7,}\d)\b"
NAME = r"\b(\d{1,5}\s+)?[A-Z][a-z]+(\s+[A-Z][a-z]+){1,3}\b"
ARTIFACTS = ("�", "[MISSING]", "\0")


def pii_hits(c: Column) -> Column:
    """Email-, phone- and name-like strings."""
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), 0) for p in (EMAIL, PHONE, NAME)])


def unchanged_hits(original: Column, candidate: Column) -> Column:
    """Hits of the original that the candidate still holds."""
    return F.filter(pii_hits(original), lambda h: (F.length(h) > 0) & F.contains(candidate, h))


def gram_overlap(candidate: Column, original: Column, n: int = 5) -> Column:
    """Shared distinct n-grams over those of the candidate."""
    c, o = X.ngrams(X.words(candidate), n), X.ngrams(X.words(original), n)
    return F.size(F.array_intersect(c, o)) / F.greatest(F.size(c), F.lit(1))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the smaller set, 0 if one is empty."""
    x, y = F.array_distinct(X.words(a)), F.array_distinct(X.words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def acceptance(response: Column, *, preambles: tuple[str, ...] = (), leak_words: tuple[str, ...] = (), leak_limit: int = 8, max_chars: Column | None = None, sentences: Column | None = None, numbered: Column | None = None) -> Column:
    """The first rule that a generated text fails, or ``accepted``."""
    return X.let(X.clean_block(response), lambda t: _first_failed(t, preambles, leak_words, leak_limit, max_chars, sentences, numbered))


def _first_failed(t: Column, preambles: tuple[str, ...], leak_words: tuple[str, ...], leak_limit: int, max_chars: Column | None, sentences: Column | None, numbered: Column | None) -> Column:
    rule = F.when(F.length(t) == 0, "empty")
    if preambles:
        rule = rule.when(reduce(lambda a, b: a | b, [F.lower(t).startswith(p) for p in preambles]), "preamble")
    if leak_words:
        rule = rule.when(F.size(F.filter(X.words(t), lambda w: w.isin(*leak_words))) >= leak_limit, "language_leak")
    if max_chars is not None:
        rule = rule.when(F.length(t) > max_chars, "too_long")
    if sentences is not None:
        rule = rule.when(F.size(X.sentences(t)) != sentences, "sentence_count")
    if numbered is not None:
        rule = rule.when(F.regexp_count(t, F.lit(r"(?m)^\s*(\d+[).]|[-*])\s+")) != numbered, "numbered_count")
    return rule.otherwise("accepted")


def heuristics(instruction: Column, response: Column) -> dict[str, Column]:
    """The flags of an audit of a prompt and its answer."""
    both = F.concat(instruction, response)
    segments = F.filter(F.transform(F.regexp_extract_all(instruction, F.lit(r"(?s)(?:^|\n)\[\d+\]\s*(.*?)(?=\n\[\d+\]\s*|\z)"), 1), lambda s: X.clean_line(s, 700)), lambda s: s != "")
    present = lambda flat: F.size(F.filter(segments, lambda s: F.contains(flat, F.lower(F.substring(s, 1, 80)))))
    return {
        "instruction_chars": F.length(instruction),
        "response_chars": F.length(response),
        "response_nonempty": F.length(response) > 0,
        "num_segments": F.size(segments),
        "segments_present": X.let(F.lower(X.clean_line(response)), present),
        "word_overlap": F.round(word_overlap(instruction, response), 4),
        "contains_mask": F.contains(instruction, F.lit("<mask_")),
        "has_artifacts": reduce(lambda a, b: a | b, [F.contains(both, F.lit(m)) for m in ARTIFACTS]),
        "url_count": F.regexp_count(both, F.lit("https?://")),
    }


def name_class(name: Column, rules: list[tuple[str, str, str]], default: str) -> Column:
    """The first of ``(prefix|suffix|contains, text, class)`` rules that a name meets."""
    tests = {"prefix": lambda t: name.startswith(t), "suffix": lambda t: name.endswith(t), "contains": lambda t: F.contains(name, F.lit(t))}
    if not rules:
        return F.lit(default)
    out = None
    for kind, t, label in rules:
        out = F.when(tests[kind](t), label) if out is None else out.when(tests[kind](t), label)
    return out.otherwise(default)


def denied(name: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased name holds any of the words."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w)) for w in words], F.lit(False))


def all_true(*flags: Column) -> Column:
    """Every flag true; a missing one counts as false."""
    return F.forall(F.array(*[F.coalesce(f, F.lit(False)) for f in flags]), lambda x: x)


def glob_state(path: Column, include: list[str], override: list[str], deny: list[str]) -> Column:
    """not_included, allowed or denied; ``*`` also crosses slashes; an override outweighs a denial."""
    import fnmatch

    def meets(globs: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [path.rlike(fnmatch.translate(g).replace(r"\Z", r"\z")) for g in globs], F.lit(False))

    return F.when(~meets(include), "not_included").when(meets(override), "allowed").when(meets(deny), "denied").otherwise("allowed")


def fit_context(df: DataFrame, instruction: str, response: str, context: int, least: int = 1) -> DataFrame:
    """Rows whose answer has room: ``allowed`` is what the prompt leaves, ``kept`` what of the answer fits."""
    room = F.lit(context) - F.least(F.col(instruction), F.lit(context))
    return df.filter(F.col(response) >= least).withColumn("allowed", room).filter("allowed >= 1").withColumn("kept", F.least(F.col(response), F.col("allowed")))


def issues(df: DataFrame, by: list[str], tests: dict[str, Column], examples: int = 20, order: str = "doc_id") -> DataFrame:
    """Named row-level issues: a count for each and the first ``examples`` rows."""
    flagged = df.select(*by, order, F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))).alias("issue"))
    named = [F.coalesce(F.to_json(F.struct(*by)), F.lit("")).alias("_of"), "issue"]
    first = flagged.select(*named, order).withColumn("_k", F.dense_rank().over(Window.partitionBy("_of", "issue").orderBy(order))).filter(F.col("_k") <= examples)
    shown = first.groupBy("_of", "issue").agg(F.array_sort(F.collect_set(order)).alias("examples"))
    return flagged.groupBy(*by, "issue").agg(F.count("*").alias("n")).select("*", named[0]).join(shown, ["_of", "issue"]).select(*by, "issue", "n", "examples")
