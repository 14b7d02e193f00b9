"""Operators whose rows are made one after another: within a document or a shard, in Arrow batches.

Draws are keyed by hashes (seed, row, step), so results do not depend on partitions.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.shared import map_batches

#: Where a sentence or paragraph ends; what overlaps counts too.
_SENTENCE_END = re.compile(r"(?=\n\n|[.!?] )")
_GOLDEN = 0x9E3779B97F4A7C15


def unit(*parts: object) -> float:
    """A draw in [0, 1) from the parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


def draws(n: int, kinds: int, *key: object) -> np.ndarray:
    """``n`` rows of ``kinds`` draws in [0, 1), by a mixing function of 64 bits over a counter that starts at a hash of the key."""
    start = np.uint64(int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:16], 16))
    x = start + np.arange(1, n * kinds + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).reshape(n, kinds) / 2.0**53


def split_at_boundaries(text: str, most: int) -> list[str]:
    """Chunks of ``most`` characters at most, cut behind a sentence or paragraph, else at a space, in the back half; else hard.

    Cuts come from two sorted lists of positions, made in one pass each.
    """
    text = re.sub("\n\n\n+", "\n\n", text).strip()
    sentences, spaces = [m.start() + 1 for m in _SENTENCE_END.finditer(text)], [m.start() for m in re.finditer(" ", text)]
    edges = [0]

    def last(cuts: list[int], least: int, under: int) -> int | None:
        k = bisect.bisect_left(cuts, under)
        return cuts[k - 1] if k and cuts[k - 1] >= least else None

    while len(text) > edges[-1] + most:
        middle, limit = edges[-1] + max(1, most // 2), edges[-1] + most
        edges.append(last(sentences, middle + 1, limit) or last(spaces, middle, limit) or limit)
    stripped = (text[a:b].strip() for a, b in itertools.pairwise([*edges, len(text)]))
    return [piece for piece in stripped if piece]


def trim_to_sentence(text: str, most: int) -> str:
    """Cut behind the last sentence end under ``most``, else at a space, each in the back half; else hard."""
    if len(text) <= most:
        return text
    head = text[:most]
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", head)]
    if ends and ends[-1] >= most // 2:
        return head[: ends[-1]].rstrip()
    gap = head.rfind(" ")
    return head[:gap].rstrip() if gap >= most // 2 else head.rstrip()


def corrupt_words(text: str, key: object, rate: float = 0.1) -> str:
    """Words are, at ``rate``, swapped with the next, deleted, replaced by or followed by another word of the text (of three characters or more); under four words unchanged.

    All draws are made at once; only the words that are hit are visited.
    """
    words = text.split()
    if len(words) < 4:
        return text
    u = draws(len(words), 3, key)
    others, parts, free = [w for w in words if len(w) > 2] or words, [[w] for w in words], 0
    for i in np.flatnonzero(u[:, 0] < rate).tolist():
        if i < free:  # swapped already
            continue
        change, other = ("swap", "delete", "replace", "add")[int(4 * u[i, 1])], others[int(u[i, 2] * len(others))]
        if change == "swap" and i + 1 < len(words):
            parts[i], parts[i + 1], free = parts[i + 1], parts[i], i + 2
        else:
            parts[i] = {"delete": [], "replace": [other]}.get(change, [words[i], other])
    return " ".join(w for p in parts for w in p)


def mask_spans(text: str, key: object, rate: float = 0.15, longest: int = 8) -> tuple[str, list[str]]:
    """Runs of words replaced by ``<mask_k>``, numbered as drawn, up to ``rate`` of all words; under eight words unchanged."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if len(spans) < 8:
        return text, []
    budget, taken, drawn = max(1, round(len(spans) * rate)), np.zeros(len(spans) + 2, bool), []
    for size, place in draws(4 * len(spans), 2, key).tolist():
        if budget <= 0:
            break
        n = min(budget, 1 + int(size * longest))
        at = int(place * (len(spans) - n + 1))
        if not taken[at : at + n + 2].any():  # nor next to another
            taken[at + 1 : at + n + 1] = True
            drawn.append((at, n))
            budget -= n
    hidden = [text[spans[at][0] : spans[at + n - 1][1]] for at, n in drawn]
    for k in sorted(range(len(drawn)), key=lambda k: -drawn[k][0]):
        at, n = drawn[k]
        text = f"{text[: spans[at][0]]}<mask_{k + 1}>{text[spans[at + n - 1][1] :]}"
    return text, hidden


def reordered_paragraphs(text: str, key: object, *, least_chars: int = 80, least: int = 3, most: int = 8, tries: int = 8, sep: str = "\n\n") -> list[tuple[str, str]]:
    """Windows of paragraphs that don't overlap, largest first: numbered in a drawn order, and as they were."""
    parts, out, at = [p.strip() for p in text.split(sep) if len(p.strip()) >= least_chars], [], 0
    while len(parts) - at >= least:
        n = min(most, len(parts) - at)
        window = parts[at : at + n]
        for t in range(tries):
            order = sorted(range(n), key=lambda i: unit(key, at, t, i))
            if order != list(range(n)):
                out.append(("\n".join(f"[{i + 1}] {window[j]}" for i, j in enumerate(order)), "\n\n".join(window)))
                break
        at += n
    return out


def noisy_words(text: str, key: object, delete: float = 0.025, mark: float = 0.025) -> str:
    """Words deleted, replaced by ``[noise]`` or followed by ``[extra]``."""
    out = []
    for i, w in enumerate(text.split()):
        u = unit(key, i)
        out += [] if u < delete else ["[noise]"] if u < delete + mark else [w, "[extra]"] if u < delete + 2 * mark else [w]
    return " ".join(out)


def each_text(df: DataFrame, key: str, text: str, make: Callable[[object, str], Sequence[tuple]], fields: str) -> DataFrame:
    """Rows ``key, idx`` and ``fields`` from what ``make(key, text)`` returns; null texts are empty."""
    kind = df.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, r in enumerate(make(k, t or ""))]
            if rows:
                keys, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *map(pa.array, rest)], [key, "idx", *names])

    return map_batches(df.select(key, text), run, f"{key} {kind}, idx long, {fields}")


def goldfish_mask(labels: np.ndarray, inputs: np.ndarray, starts: np.ndarray, k: int, width: int, seed: int) -> np.ndarray:
    """Labels with about one in ``k`` dropped (-100), by a hash of the ``width`` inputs before; sequences don't see each other."""
    out = labels.copy()
    value = (inputs.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    sequence = np.searchsorted(starts, np.arange(len(inputs)), side="right")
    mixed = np.zeros(len(inputs), np.uint64)
    for back in range(min(width, len(inputs))):
        moved = np.concatenate([np.zeros(back, np.uint64), value[: len(value) - back]]) if back else value
        same = np.concatenate([np.full(back, -1), sequence[: len(sequence) - back]]) == sequence if back else np.ones(len(inputs), bool)
        mixed ^= np.where(same, moved * np.uint64(2 * back + 1), np.uint64(0))
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    out[(mixed >> np.uint64(33)) % np.uint64(k) == 0] = -100
    return out


def lane_pack(lengths: Sequence[int], lanes: int, capacity: int) -> list[list[int]]:
    """Batches of consecutive rows: each takes the longest prefix that longest-first scheduling fits into ``lanes`` of ``capacity``.

    Returns for each batch the lane of each of its rows; a batch of fewer rows than lanes ends the run and isn't returned.
    """
    import heapq

    def lanes_of(part: Sequence[int]) -> list[int] | None:
        loads, out = [(0, i) for i in range(lanes)], [0] * len(part)
        for i in sorted(range(len(part)), key=lambda i: (-part[i], -i)):
            load, lane = loads[0]
            if load + part[i] > capacity:
                return None
            out[i] = lane
            heapq.heapreplace(loads, (load + part[i], lane))
        return out

    batches, start, total = [], 0, np.cumsum(np.asarray(lengths, np.int64))
    while start < len(lengths):
        before = int(total[start - 1]) if start else 0
        stop = min(len(lengths), int(np.searchsorted(total, before + capacity * lanes)) + 1)
        fits, fails = 0, stop - start + 1
        while fails - fits > 1:
            mid = (fits + fails) // 2
            fits, fails = (mid, fails) if lanes_of(lengths[start : start + mid]) is not None else (fits, mid)
        if fits < lanes:
            break
        batches.append(lanes_of(lengths[start : start + fits]) or [])
        start += fits
    return batches


def multipack(df: DataFrame, shard: str, order: str, length: str, *, lanes: int, capacity: int) -> DataFrame:
    """Rows of each shard of an epoch packed in their order: ``batch, lane``; each shard is packed by itself."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        found = lane_pack(t.column(length).to_pylist(), lanes, capacity)
        n = sum(map(len, found))
        batch = [i for i, b in enumerate(found) for _ in b]
        return pa.table({shard: t.column(shard).slice(0, n), order: t.column(order).slice(0, n), length: t.column(length).slice(0, n), "batch": pa.array(batch, pa.int64()), "lane": pa.array([x for b in found for x in b], pa.int64())})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (shard, order, length))
    return df.select(shard, order, length).groupBy(shard).applyInArrow(run, f"{kinds}, batch long, lane long")


def rouge_n(candidate: str, reference: str, n: int = 1) -> float:
    """F1 of n-gram counts of lower-cased words."""
    from collections import Counter

    grams = lambda t: Counter(zip(*[re.findall(r"\w+", t.lower())[i:] for i in range(n)]))
    a, b = grams(candidate), grams(reference)
    shared = sum((a & b).values())
    return 0.0 if not shared else 2 * shared / (sum(a.values()) + sum(b.values()))


def best_reference(df: DataFrame, key: str, candidate: str, references: str, score: Callable[[str, str], float] = rouge_n) -> DataFrame:
    """The best score among the references of each row, the first of equals: ``score, reference_idx``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [max(((score(c or "", r or ""), -i) for i, r in enumerate(rs or [])), default=(0.0, 1)) for c, rs in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([-i for _, i in got], pa.int64())], [key, "score", "reference_idx"])

    return df.select(key, candidate, references).mapInArrow(run, f"{key} {kind}, score double, reference_idx long")


def named_numbers(tree: object, without: str = "raw") -> list[tuple[str, float]]:
    """The finite numbers of nested objects in the order they stand there, each under its path of cleaned names; parts named ``without`` are left out."""
    found, open_ = [], [("", tree)]
    while open_:
        path, value = open_.pop()
        match value:
            case dict():
                inner = [(f"{path}/{re.sub(r'[^A-Za-z0-9_.-]+', '_', str(name))}", value[name]) for name in value if name != without]
                open_ += reversed(inner)
            case bool():
                pass
            case int() | float() if math.isfinite(value):
                found.append((path[1:], float(value)))
    return found


def replaced_values(tree: object, pairs: Sequence[tuple[str, str]]) -> object:
    """The same tree with the replacements made in order in every text in it; names of fields stay."""
    match tree:
        case str():
            for old, new in pairs:
                tree = tree.replace(old, new)
            return tree
        case dict():
            return dict(zip(tree, replaced_values([*tree.values()], pairs)))
        case list():
            return [replaced_values(x, pairs) for x in tree]
    return tree


def unique_names(names: Sequence[str], prefix: str = "tool_") -> list[str]:
    """Names of letters, digits, dot and dash; repeats get numbers that aren't taken."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[^A-Za-z0-9_.-]+", "_", name).strip("_") or "unnamed"
        base = base if re.match(r"[A-Za-z_]", base) else prefix + base
        pick, k = base, 2
        while pick in out:
            pick, k = f"{base}_{k}", k + 1
        out.append(pick)
    return out


def parse_calls(text: str) -> list[tuple[str, str]]:
    """Tool calls in a text as (name, arguments as JSON): JSON objects with a name, or ``[name(key=value, ...)]``."""
    import ast
    import json

    decoder, found, at = json.JSONDecoder(strict=False), [], 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, dict) and "name" in value:
            args = value.get("arguments", value.get("parameters", {}))
            if isinstance(args, str):
                try:
                    args = json.loads(args)
                except ValueError:
                    args = {"value": args}
            found.append((str(value["name"]), json.dumps(args, sort_keys=True)))
        at = end
    if found:
        return found
    if m := re.fullmatch(r"(?s)\s*\[(.*)\]\s*", text):
        try:
            calls = ast.parse(f"[{m[1]}]", mode="eval").body.elts
        except SyntaxError:
            return []
        for c in calls:
            if isinstance(c, ast.Call):
                args = {}
                for k in c.keywords:
                    try:
                        args[k.arg] = ast.literal_eval(k.value)
                    except ValueError:
                        args[k.arg] = ast.unparse(k.value)
                found.append((ast.unparse(c.func), json.dumps(args, sort_keys=True, default=str)))
    return found


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """``key: value`` lines between leading ``---`` lines, and the rest."""
    if not (m := re.match(r"(?s)---\n(.*?)\n---\n?", text)):
        return {}, text
    pairs = (line.partition(":") for line in m[1].splitlines() if ":" in line and not line.startswith((" ", "#", "-")))
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}, text[m.end() :]


def markdown_sections(text: str, fenced: bool = True) -> list[tuple[str, str]]:
    """Second-level headings outside code fences with their text; with ``fenced`` false, fences count for nothing."""
    out: list[tuple[str, list[str]]] = []
    fence = ""
    for line in text.splitlines():
        if fenced and (m := re.match(r"\s*(```+|~~~+)", line)):
            fence = "" if fence and line.strip().startswith(fence) else fence or m[1]
        if not fence and line.startswith("## "):
            out.append((line[3:].strip(), []))
        elif out:
            out[-1][1].append(line)
    return [(h, "\n".join(b).strip()) for h, b in out]


def tasks_of(key: object, text: str, chunk: int = 3000) -> list[tuple[str, str, str]]:
    """Denoising and span filling for each chunk of a text: ``category, instruction, response``."""
    out = []
    for i, piece in enumerate(split_at_boundaries(text, chunk)):
        noisy, (masked, _) = corrupt_words(piece, (key, i, "noise")), mask_spans(piece, (key, i, "span"))
        out += [("denoising", noisy, piece)] * (noisy != piece) + [("span_fill", masked, piece)] * (masked != piece)
    return out


def text_tasks(df: DataFrame, key: str, text: str, chunk: int = 3000) -> DataFrame:
    return each_text(df, key, text, lambda k, t: tasks_of(k, t, chunk), "category string, instruction string, response string")


def boundary_chunks(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    return each_text(df, key, text, lambda _, t: [(c,) for c in split_at_boundaries(t, most)], "chunk string")


def reorder_tasks(df: DataFrame, key: str, text: str, sep: str = "\n\n", least_chars: int = 80) -> DataFrame:
    return each_text(df, key, text, lambda k, t: reordered_paragraphs(t, k, sep=sep, least_chars=least_chars), "instruction string, response string")


def random_rows(spark, rows: int, inst: int, resp: int, vocab: int, seed: int) -> DataFrame:
    """A synthetic tokenised table: arrays of drawn ids."""
    ids = lambda n, part: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(part), F.col("id"), i), F.lit(vocab)).cast("int"))
    return spark.range(rows).select(F.col("id").alias("row"), ids(inst, "i").alias("inst_tokens"), ids(resp, "r").alias("resp_tokens"))
