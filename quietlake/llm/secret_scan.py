"""Secret scans with character Markov models, in DataFrame functions only.

Three fixed patterns find secrets by their form. Beside them every long run of token
characters is scored by two first-order Markov models of its characters, one of random
strings and one of ordinary tokens; a mean log-likelihood ratio of ``least`` or more a step
makes it a span. The models are counts of adjacent characters in samples that are labelled
by how they are made: hex, base64 and base62 keys, keys of letters of one case and UUIDs are
random; identifiers, paths and host names joined from the words of at most ``sample_docs``
distinct texts (the documented bound of the fit, the patterns' matches taken out first),
numbers, dates, versions, rules of one repeated character, walks over a keyboard or the
alphabet, and names that mix letters and digits are ordinary.

Scale: one narrow pass without any shuffle of texts; the only exchanges are the sample and
the models' counts, one row per pair of 68 characters at most. Places are running sums by
runs of matches, so a text with n matches takes a little more than n steps. Spans are code
points, end exclusive.

Edge cases: null text counts as empty and has no spans; a null doc_id is kept; repeated
rows are scanned each; an empty table gives an empty result (its model knows made samples
only); texts are read whole; columns other than the two named are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, the group whose length counts, and its least length; in the order in which kinds rank.
PATTERNS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-."
_TOKEN = r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/=_.-]{%d,}+"
_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
_RUN = 64
#: Characters are numbered from the first one of ALPHABET in ASCII; _WIDE of them cover it.
_FIRST, _WIDE = ord("+"), ord("z") - ord("+") + 1
#: How many counts the usual steps between groups of characters stand for where few adjacent pairs are known.
_PRIOR = 50.0
#: One row of so many makes a name of letters and digits in turn.
_RARE = 4


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_runs(items: Column, body: Callable[[Column], Column]) -> Column:
    """An array of ``body`` of each run of up to 64 items."""
    runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / _RUN).cast("int") - 1, F.lit(0)))
    return F.transform(runs, lambda c: body(F.slice(items, c * _RUN + 1, F.lit(_RUN))))


def _folded(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """(at, out): all values combined, and for each value those before it, from 0 on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each whole number, the combination of those before it; ``combine`` is associative and 0 changes nothing.

    Runs of values are folded first, then the runs' totals, so no long array grows by one value a step.
    """
    spread = lambda runs: F.zip_with(runs, _folded(F.transform(runs, lambda r: r["at"]), combine)["out"], lambda r, head: F.transform(r["out"], lambda x: combine(head, x)))
    return _bound(values, lambda v: _bound(_by_runs(v, lambda run: _folded(run, combine)), lambda runs: F.flatten(spread(runs))))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _located(text: Column, pattern: str, found: Column) -> Column:
    """(m, start, end) of each of the pattern's matches ``found``; the text before one is the gaps and matches so far."""

    def placed(gaps: Column) -> Column:
        before = _running(F.transform(found, lambda m, i: F.get(gaps, i) + F.length(m)), _plus)
        starts = F.zip_with(before, F.slice(gaps, F.lit(1), F.size(found)), _plus)
        return F.zip_with(found, starts, lambda m, s: F.struct(m.alias("m"), s.alias("start"), (s + F.length(m)).alias("end")))

    return _bound(F.transform(F.split(text, pattern, -1), F.length), placed)


def _spans(matches: Column, kind: str, rank: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(_SPANS)


def _matches(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches whose group is long enough, as spans."""
    size = lambda m: F.length(F.regexp_extract(m, pattern, group)) if group else F.length(m)
    located = _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _located(text, pattern, found))
    return _spans(F.filter(located, lambda x: size(x["m"]) >= least), kind, rank)


def _runs(pattern: str, group: int, least: int) -> str:
    """A cheaper pattern with the same long matches; one that counts its whole match is a maximal run, so its least length can stand in it."""
    fixed = len("AKIA") if pattern.startswith("AKIA") else 0
    return pattern if group else f"{pattern[:-1]}{{{least - fixed},}}"


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind."""
    none = F.array().cast(_SPANS)
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        quick = _runs(pattern, group, least)
        parts.append(F.when(F.rlike(text, F.lit(quick)), _matches(text, kind, rank, quick, group, least)).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _steps(token: Column) -> Column:
    """Numbers of the adjacent pairs of characters of a token."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - _FIRST)
    return _bound(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * _WIDE + b))


def _made(spark, rows: int) -> DataFrame:
    """(token, random): tokens that need no words, labelled by how they are made."""
    id_ = F.col("id")
    digest = F.sha2(F.concat(F.lit("random "), id_.cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    base62 = F.translate(base64, "+/=", "")
    number = F.pmod(F.xxhash64("id"), F.lit(10**16))
    digits, day = number.cast("string"), F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(number, F.lit(16_000)).cast("int"))
    time = F.timestamp_seconds(F.pmod(number, F.lit(2 * 10**9)))
    mark = F.element_at(F.split(F.lit("- = _ . + /"), " "), F.pmod(id_, F.lit(6)).cast("int") + 1)
    uuid = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    letters = F.regexp_replace(F.lower(base62), "[0-9]", "")
    random = [digest, F.upper(digest), base64, F.substring(base62, 1, 20), F.substring(F.upper(base62), 1, 20), F.translate(base64, "+/", "-_"), letters, F.upper(letters), uuid]
    walk = lambda row: F.substring(F.repeat(F.lit(row), 2), F.pmod(id_, F.lit(len(row))).cast("int") + 1, 20)
    letter = lambda bits: F.char(F.pmod(F.shiftright(number, bits), F.lit(26)) + 97)
    short = lambda bits: F.concat(letter(bits), F.pmod(F.shiftright(number, bits + 5), F.lit(20)).cast("string"), letter(bits + 10))
    model = F.concat(F.upper(letter(0)), F.upper(letter(5)), F.upper(letter(10)), F.substring(digits, 1, 4))
    ordinary = [
        digits, F.repeat(F.substring(digits, 1, 1), 16), F.lpad(id_.cast("string"), 16, "0"), F.concat(id_.cast("string"), F.lit("."), digits), F.concat(F.lit("0."), digits), F.array_join(F.sequence(F.lit(0), F.lit(9)), ""),
        day.cast("string"), F.date_format(time, "yyyy-MM-dd'T'HH.mm.ss"), F.date_format(time, "yyyyMMdd_HHmmss"), F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "yyyy/MM/dd"),
        F.concat_ws(".", F.pmod(number, F.lit(30)), F.pmod(F.shiftright(number, 8), F.lit(30)), F.pmod(F.shiftright(number, 16), F.lit(300))), F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 4), F.substring(digits, 8, 4)),
        F.repeat(mark, 40), walk("qwertyuiopasdfghjklzxcvbnm"), F.upper(walk("qwertyuiopasdfghjklzxcvbnm")), walk("qwertzuiopasdfghjklyxcvbnm"), walk("abcdefghijklmnopqrstuvwxyz"), F.upper(walk("abcdefghijklmnopqrstuvwxyz")), F.concat(walk("1234567890qwertyuiop"), walk("1234567890qwertyuiop")),
    ]
    # rare beside words, but common enough not to look random
    rare = [F.concat_ws("_", short(0), short(8), short(16)), F.concat_ws("-", short(4), short(12)), F.concat_ws("_", model, F.concat(F.pmod(number, F.lit(512)).cast("string"), F.lit("GB"))), F.concat_ws("-", model, F.upper(short(20)))]
    ordinary.append(F.when(id_ % _RARE == 0, F.element_at(F.array(*rare), F.pmod(F.shiftright(id_, 4), F.lit(4)).cast("int") + 1)))
    label = lambda tokens, is_random: F.transform(F.array(*tokens), lambda t: F.struct(t.alias("token"), F.lit(is_random).alias("random")))
    return spark.range(rows).select(F.inline(F.concat(label(random, 1), label(ordinary, 0)))).filter("token is not null")


def _names(spark, times: int = 8) -> DataFrame:
    """(token, random): names as programmers write them, in three spellings: those of Spark's own functions, so that a small corpus has some too."""
    names = sorted(n for n in dir(F) if re.fullmatch("[a-z][a-z_]+", n))
    camel = ["".join(x.title() if i else x for i, x in enumerate([*a.split("_"), *b.split("_")])) for a, b in zip(names, names[7:], strict=False)]
    tokens = F.array(*map(F.lit, [*names, *(n.upper() for n in names), *camel]))
    return spark.range(times).select(F.explode(tokens).alias("token"), F.lit(0).alias("random"))


def _ordinary(docs: DataFrame, text_col: str, sample_docs: int) -> DataFrame:
    """(token, random): identifiers, paths and names joined from words of at most ``sample_docs`` distinct texts."""
    texts = docs.select(F.col(text_col).cast("string").alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
    chosen = texts.select("h").distinct().orderBy("h").limit(sample_docs)
    # at most sample_docs hashes, so the broadcast has a fixed bound; of equal hashes each task passes on one text
    sample = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("t").alias("t"))
    plain = reduce(lambda t, p: F.regexp_replace(t, p[1] if p[2] else _runs(*p[1:]), " "), PATTERNS, F.col("t"))
    words = sample.select(F.regexp_extract_all(plain, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    pairs = words.select(F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("b")))).filter("b is not null").distinct()
    a, b, n = F.lower("a"), F.lower("b"), F.pmod(F.xxhash64("a", "b"), F.lit(1000)).cast("string")
    forms = [
        F.col("a"), F.concat(a, F.lit("_"), b), F.concat(a, F.lit("-"), b), F.concat(F.upper("a"), F.lit("_"), F.upper("b")), F.concat(a, F.initcap("b")), F.concat(F.initcap("a"), F.initcap("b")),
        F.concat(F.lit("/"), a, F.lit("/"), b, F.lit("."), F.substring(a, 1, 3)), F.concat(a, n, F.lit("."), b, F.lit(".com")), F.concat(b, F.lit("-"), n, F.lit(".tar.gz")), F.concat(F.lit("v"), F.substring(n, 1, 1), F.lit("/"), a, F.lit("="), b),
    ]
    return pairs.select(F.explode(F.array(*forms)).alias("token"), F.lit(0).alias("random"))


def _step(a: str, b: str) -> int:
    return (ord(a) - _FIRST) * _WIDE + ord(b) - _FIRST


def _group(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def train(docs: DataFrame, sample_docs: int = 500, made: int = 4000, text_col: str = "text") -> list[int]:
    """Thousandths of the log-likelihood ratio of each pair of characters of ALPHABET, random over ordinary."""
    tokens = _ordinary(docs, text_col, sample_docs).unionByName(_made(docs.sparkSession, made)).unionByName(_names(docs.sparkSession))
    steps = tokens.filter(F.length("token") > 1).select("random", F.explode(_steps(F.col("token"))).alias("step"))
    got = {(r["random"], r["step"]): r["count"] for r in steps.groupBy("random", "step").count().collect()}  # 2 * 68 * 68 rows at most
    count = lambda k, a, b: got.get((k, _step(a, b)), 0)
    groups = [[c for c in ALPHABET if _group(c) == g] for g in range(4)]
    between = {(k, g, h): sum(count(k, a, b) for a in groups[g] for b in groups[h]) + 1 for k in (0, 1) for g in range(4) for h in range(4)}
    leaving = {(k, g): sum(between[k, g, h] for h in range(4)) for k in (0, 1) for g in range(4)}
    total = {(k, a): sum(count(k, a, b) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}

    def chance(k: int, a: str, b: str) -> float:
        g, h = _group(a), _group(b)
        usual = between[k, g, h] / leaving[k, g] / len(groups[h])
        return (count(k, a, b) + _PRIOR * usual) / (total[k, a] + _PRIOR)

    return [round(1000 * math.log(chance(1, a, b) / chance(0, a, b))) for a in ALPHABET for b in ALPHABET]


def markov_spans(text: Column, weights: list[int], shortest: int = 16, least: int = 1750, rank: int = 3) -> Column:
    """Spans of maximal runs of token characters that look random: a mean of ``least`` thousandths or more a step."""
    pattern = _TOKEN % shortest
    by_step = dict(zip((_step(a, b) for a in ALPHABET for b in ALPHABET), weights, strict=True))
    table = F.split(F.lit(",".join(str(by_step.get(s, 0)) for s in range(_WIDE**2))), ",").cast("array<int>")  # a constant, folded before it runs
    total = lambda token: F.aggregate(_steps(token), F.lit(0).cast("long"), lambda a, s: a + F.get(table, s))
    random = lambda token: total(token) >= least * (F.length(token) - 1)

    def chosen(found: Column) -> Column:
        marks = F.transform(found, random)
        kept = lambda m: F.filter(F.zip_with(_located(text, pattern, found), m, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), lambda z: z["r"])
        return _bound(marks, lambda m: F.when(F.exists(m, lambda r: r), F.transform(kept(m), lambda z: z["x"])))

    located = _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), chosen)
    return F.coalesce(_spans(located, "markov", rank), F.array().cast(_SPANS))


def _beyond(random: Column, base: Column) -> Column:
    """Spans of ``random``, which come by place, that ``base`` doesn't cover completely."""

    def rest(run: Column) -> Column:
        low, high = F.element_at(run, 1)["start"], F.element_at(run, -1)["end"]
        near = F.filter(base, lambda b: (b["start"] < high) & (b["end"] > low))
        # base spans come by start, so this is how far they cover a span from its start without a gap
        covered = lambda near, m: F.aggregate(near, m["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
        return _bound(near, lambda near: F.filter(run, lambda m: covered(near, m) < m["end"]))

    return F.when((F.size(random) == 0) | (F.size(base) == 0), random).otherwise(F.flatten(_by_runs(random, rest)))


def _scanned(docs: DataFrame, text_col: str, weights: list[int] | None, **markov) -> DataFrame:
    """The input's columns as a struct ``row``, with ``text`` (never null), ``base`` and ``spans``."""
    weights = weights or train(docs, text_col=text_col)
    out = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pattern, none = _TOKEN % markov.get("shortest", 16), F.array().cast(_SPANS)
    random = F.when(F.rlike("text", F.lit(pattern)), markov_spans(F.col("text"), weights, **markov)).otherwise(none)
    both = _bound(F.struct(base_spans(F.col("text")).alias("base"), random.alias("random")), lambda x: F.struct(x["base"].alias("base"), F.array_sort(F.concat(x["base"], _beyond(x["random"], x["base"]))).alias("spans")))
    return out.withColumn("found", both).select("row", "text", "found.base", "found.spans")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[int] | None = None, **markov) -> DataFrame:
    """doc_id, base (spans of the patterns), spans (those and the Markov models').

    A Markov span that the patterns' spans cover completely isn't listed again.
    """
    found = _scanned(docs.select(id_col, text_col), text_col, weights, **markov)
    return found.select(F.col("row")[id_col].cast("long").alias("doc_id"), "base", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or chain of overlapping spans, replaced by ``mark``; spans come by start."""

    def pieces(run: Column) -> Column:
        low, high = F.element_at(run, 1)["at"], F.element_at(run, -1)["start"]
        cut = lambda part: F.transform(run, lambda s: F.when(s["start"] >= s["at"], F.concat(F.substring(part, s["at"] - low + 1, s["start"] - s["at"]), F.lit(mark))).otherwise(""))
        return F.array_join(_bound(F.substring(text, low + 1, F.greatest(high - low, F.lit(0))), cut), "")

    ends = F.transform(spans, lambda s: s["end"])
    placed = F.zip_with(spans, _running(ends, F.greatest), lambda s, at: F.struct(s["start"].alias("start"), at.alias("at")))
    whole = _bound(placed, lambda p: F.array_join(_by_runs(p, pieces), ""))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(whole, F.substring(text, F.array_max(ends) + 1, F.length(text))))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", weights: list[int] | None = None, **markov) -> DataFrame:
    """``docs`` with every span replaced; a column n_chars follows the new text."""
    found = _scanned(docs, text_col, weights, **markov)
    found = found.withColumn("clean", F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"), mark)))
    new = {text_col: F.coalesce("clean", F.col("row")[text_col])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("clean"), F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each pattern, the digest of those spans, and all spans as text."""
    counts = [_number(kind).alias(f"n_{kind}") for kind, *_ in PATTERNS]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
