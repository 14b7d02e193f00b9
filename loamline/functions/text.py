"""Text functions on columns: cleaning, parsing of answers, formatting.

``\\s`` and ``\\w`` are spelled so that they mean the Unicode classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's white space.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: What becomes one space; a space that stands alone is left, for replacing each one is slow.
SPACES = r"(?U)\s{2,}|[^\S ]"
BLANKS = r"[ \t]{2,}|\t"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row, also where inner functions use it for each element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def clean_line(c: Column, max_chars: int | None = None) -> Column:
    """One line: runs of white space become a space; text over ``max_chars`` is cut and marked."""
    line = strip(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))
    if max_chars is None:
        return line
    return F.when(F.length(line) > max_chars, F.concat(F.rtrim(F.substring(line, 1, max_chars)), F.lit(" ..."))).otherwise(line)


def clean_block(c: Column) -> Column:
    """Lines kept: NUL and blanks become single spaces, three or more line ends two."""
    blanks = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\0", " "), BLANKS, " ")
    return strip(F.regexp_replace(blanks, "\n{3,}", "\n\n"))


def clean_blanks(c: Column) -> Column:
    """Runs of blanks become a space; line ends stay."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, " "))


def drop_end_mark(c: Column, mark: str = "<|endoftext|>") -> Column:
    return F.replace(c, F.lit(mark), F.lit(""))


def slug(c: Column, sep: str = "_", most: int = 96) -> Column:
    """Letters, digits, dot and dash kept; other runs become ``sep``."""
    plain = F.regexp_replace(c, "[^A-Za-z0-9.-]+", sep)
    return F.substring(F.regexp_replace(plain, f"^[{sep}]+|[{sep}]+$", ""), 1, most)


def words(c: Column) -> Column:
    """Lower-cased words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def ngrams(w: Column, n: int) -> Column:
    """Distinct n-grams of a word array, space-joined; none of a shorter array."""
    grams = lambda a: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.array_join(F.slice(a, i, n), " ")))
    return let(w, lambda a: F.when(F.size(a) >= n, grams(a)).otherwise(F.array().cast("array<string>")))


def gram_hashes(w: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of a word array, one for each place; different grams may share one."""
    hashes = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.xxhash64(*[a[i + k] for k in range(n)]))
    return let(w, lambda a: F.when(F.size(a) >= n, hashes(a)).otherwise(F.array().cast("array<bigint>")))


def sentences(c: Column) -> Column:
    """Parts between sentence ends followed by white space; blank parts left out."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.length(strip(s)) > 0)


def last_boxed(c: Column) -> Column:
    """What the last ``\\boxed{...}`` (else ``\\fbox{...}``) holds, null without one or with braces unbalanced."""
    mark = F.when(F.contains(c, F.lit("\\boxed{")), F.lit("\\boxed{")).when(F.contains(c, F.lit("\\fbox{")), F.lit("\\fbox{"))
    tail = F.call_function("substring_index", c, mark, F.lit(-1))
    step = lambda acc, ch: F.when(acc["end"] >= 0, acc).otherwise(
        F.struct(
            (acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("depth"),
            (acc["n"] + 1).alias("n"),
            F.when((ch == "}") & (acc["depth"] == 1), acc["n"]).otherwise(F.lit(-1)).alias("end"),
        )
    )
    end = F.aggregate(F.split(tail, ""), F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"), F.lit(-1).alias("end")), step, lambda acc: acc["end"])
    return F.when(mark.isNotNull() & (end >= 0), strip(F.substring(tail, F.lit(1), end)))


def to_integer(c: Column) -> Column:
    """A number without commas and dollar signs, cut to an integer; null where it is none."""
    value = F.regexp_replace(strip(c), "[,$]", "").try_cast("double")
    return F.when(F.abs(value) < 9.0e18, value.cast("bigint"))


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(-1))


def choice_letter(c: Column, letters: str = "A-J") -> Column:
    """The last bracketed letter, else the last that stands alone."""
    return F.coalesce(last_match(c, rf"\(([{letters}])\)"), last_match(c, rf"\b([{letters}])\b"))


def cut_at_stop(c: Column, stops: list[str]) -> Column:
    """Up to the earliest of the stop marks."""
    at = [F.nullif(F.locate(s, c), F.lit(0)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), c).otherwise(F.substring(c, F.lit(1), first - 1))


def outer_object(c: Column) -> Column:
    """From the first opening to the last closing brace, if that is JSON, else null."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def format_choices(question: Column, options: Column) -> Column:
    """A question and its lettered options, a line each."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"))


def duration(seconds: Column) -> Column:
    """1h02m, 3m04s, 5s; unknown without a value."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    long_, middle = F.format_string("%dh%02dm", h, m), F.format_string("%dm%02ds", m, s % 60)
    return F.when(seconds.isNull(), "unknown").when(s >= 3600, long_).when(s >= 60, middle).otherwise(F.format_string("%ds", s))


def byte_size(c: Column) -> Column:
    """12.0 B, 1.5 KB ... up to TB; unknown without a value."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.when(c.isNull(), "unknown")
    for i, u in enumerate(units):
        text = F.format_string(f"%.1f {u}", F.bround(c / float(1024**i), 1))
        out = out.when(c < 1024 ** (i + 1), text) if u != units[-1] else out.otherwise(text)
    return out


def percent(c: Column, missing: str = "—") -> Column:
    """A share as 12.5%; a mark without a value."""
    return F.when(c.isNull(), missing).otherwise(F.format_string("%.1f%%", F.bround(c * 100, 1)))


def atom(c: Column) -> Column:
    """``name(a,b=-1)``: runs of white space become one, none is left around brackets, commas and equals signs nor behind ``=-``."""
    line = F.regexp_replace(F.trim(c), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(line, r"\s*([(),=])\s*", "$1"), r"=\s*-\s*", "=-")


def status_atoms(c: Column, states: tuple[str, ...]) -> Column:
    """``state: atom, atom ... state: ...`` as an array of ``(state, atom)``; text in front of the first state is left out."""
    head = rf"\b({'|'.join(states)})\s*:"
    parts = F.regexp_extract_all(c, F.lit(rf"(?s){head}.*?(?=\b(?:{'|'.join(states)})\s*:|\z)"), 0)
    of = lambda p: F.regexp_extract_all(F.regexp_replace(p, rf"^{head}", ""), F.lit(r"[A-Za-z][A-Za-z0-9-]*(?:\s*\([^)]*\))?"), 0)
    return F.flatten(F.transform(parts, lambda p: F.transform(of(p), lambda a: F.struct(F.regexp_extract(p, rf"^{head}", 1).alias("state"), atom(a).alias("atom")))))


def retry_batch(batch: Column, attempt: Column) -> Column:
    """A batch size halved (rounded up) for each attempt, one at least."""
    return F.greatest(F.lit(1), F.ceil(batch / F.pow(F.lit(2.0), attempt))).cast("long")


def cosine_rate(step: Column, *, peak: float, warm: int, total: int, least: float) -> Column:
    """Linear warm-up, then a cosine from ``peak`` to ``least * peak``."""
    done = F.least(F.greatest((step - warm) / float(max(1, total - warm)), F.lit(0.0)), F.lit(1.0))
    decayed = least + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * done))
    return peak * F.when(step < warm, step / float(max(1, warm))).otherwise(decayed)


def rewrite_prefix(key: Column, old: str, new: str) -> Column:
    return F.when(key.startswith(old), F.concat(F.lit(new), F.substring(key, F.lit(len(old) + 1), F.length(key)))).otherwise(key)


def finite(c: Column) -> Column:
    """A number as double; null for text, NaN and infinities."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
