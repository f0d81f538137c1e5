"""Masking of free text by stable tokens, as a batch over tables, and the vault that maps tokens back.

A batch has two passes, because numbers of tokens are global: texts are normalised, known
persons' values are replaced, rule spans are found and resolved; then distinct new values
get tokens in order of first appearance, and texts take them by a join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pii_rules import find_spans, replace, resolve
from ..functions.pseudonyms import hmac_sha256
from ..functions.text import light, strip, value_forms
from ..sources.vault import VAULT_SCHEMA
from ..storage import cut, lookup, written
from .numbering import numbered
from .occurrence import occurring

# Kinds by the dictionary's fields, sites by how they are masked, callers that may unmask, tokens.
KINDS = {"names": "NAME", "emails": "EMAIL", "phones": "PHONE", "ids": "ID"}
SKIPPED_SITES = ("safe", "engine")
CODE_KINDS = ("PATIENT_ID", "EMAIL")
UNMASK_CALLERS = ("ui.render", "support-intake", "slack-safe", "cli")
TOKEN = r"\[(?:P\d+_[A-Z_]+|[A-Z_]+_\d+)\]"
#: After a token: not in a key of a JSON object, whose closing quote a colon follows.
_NO_KEY = r"(?!(?:[^\"\\]++|\\.)*+\"\s*:)"
DICTIONARY_SCHEMA = "generated string, persons array<struct<id:string,names:array<string>,emails:array<string>,phones:array<string>,ids:array<string>>>"
#: How many forms a broadcast holds; larger dictionaries are joined.
SLICE = 200_000


def build_dictionary(rows: DataFrame, order_by: str, id_col: str, names=(), emails=(), phones=(), ids=()) -> DataFrame:
    """(id, names, emails, phones, ids): persons P1, P2, ... by position; a row without any value uses up its number."""

    def values(columns) -> Column:
        texts = [strip(F.col(c).cast("string")) for c in columns if c in rows.columns]
        return F.filter(F.array(*texts), lambda v: v.isNotNull() & (v != "")) if texts else F.array().cast("array<string>")

    placed = numbered(rows, [order_by], name="__nth")
    persons = placed.select(
        F.concat(F.lit("P"), F.col("__nth").cast("string")).alias("id"), values(names).alias("names"), values(emails).alias("emails"), values(phones).alias("phones"), values([id_col, *ids]).alias("ids"), F.col("__nth").alias("position")
    )
    return persons.filter(F.size("names") + F.size("emails") + F.size("phones") + F.size("ids") > 0)


def dictionary_entries(persons: DataFrame) -> DataFrame:
    """(form, person, kind): what stands for a person in light text; a form of several persons is the first one's."""
    position = F.col("position") if "position" in persons.columns else F.monotonically_increasing_id()
    named = persons.filter(strip(F.coalesce("id", F.lit(""))) != "").withColumn("position", position)
    fields = F.array(*(F.struct(F.lit(i).alias("field"), F.lit(kind).alias("kind"), F.coalesce(F.col(name), F.array().cast("array<string>")).alias("values")) for i, (name, kind) in enumerate(KINDS.items())))
    values = named.select("position", strip("id").alias("person"), F.inline(fields)).select("position", "person", "field", "kind", F.posexplode("values").alias("nth", "value"))
    forms = values.select("position", "field", "nth", "person", "kind", F.explode(value_forms(F.col("value"))).alias("form"))
    romaji = (F.col("kind") == "NAME") & F.rlike("form", F.lit(r"^[A-Za-z][A-Za-z .'-]+$"))
    number = F.col("kind").isin("PHONE", "ID") & F.rlike("form", F.lit(r"(?U)^\d+$"))
    length = F.when(romaji, F.length(F.replace("form", F.lit(" "), F.lit("")))).otherwise(F.length("form"))
    least = F.when(romaji, 5).when(number, 7).otherwise(3)
    first = F.min_by(F.struct("person", "kind"), F.struct("position", "field", "nth")).alias("owner")
    return forms.filter(length >= least).groupBy("form").agg(first).select("form", "owner.person", "owner.kind")


def _mac(value: Column, key: bytes) -> Column:
    return hmac_sha256(value, b"lookup:" + key)


def _dictionary_replace(entries):
    """One pass over (text, hits): entries come longest first; each replaces all of its spellings before the next one looks."""
    order = list(entries)
    by_low = {}
    for at, (form, *_rest) in enumerate(order):
        by_low.setdefault(form.lower(), []).append(at)
    automaton = None

    def candidates(text: str) -> list[int]:
        nonlocal automaton
        if automaton is None:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for low, ats in by_low.items():
                automaton.add_word(low, ats)
            automaton.make_automaton()
        return sorted({at for _, ats in automaton.iter(text.lower()) for at in ats}) if by_low else []

    def run(text: str) -> tuple[str, list[str]]:
        hits: list[str] = []
        due = candidates(text)
        while due:
            at = due.pop(0)
            form, kind, token = order[at]
            text, n = re.subn(re.escape(form), lambda _m, t=token: t, text, flags=re.IGNORECASE)
            hits += [f"DICT_{kind}"] * n
            if n:  # a token may hold a later form
                due = [x for x in candidates(text) if x > at]
        return text, hits

    return run


def apply_dictionary(texts: DataFrame, entries: DataFrame, vault: DataFrame | None = None, key: bytes = b"", limit: int = SLICE) -> DataFrame:
    """``texts`` (key, text) with known values replaced, and ``hits`` by kind.

    Tokens are the persons', or those under which the vault already has a value. Forms are
    applied longest first, equal lengths by spelling, each to what those before it have left.
    A dictionary of at most ``limit`` forms is broadcast. A larger one stays a table: each
    text gets the forms that may count in it by joins, and applies these only.
    """
    known = entries.withColumn("token", F.format_string("[%s_%s]", "person", "kind"))
    if vault is not None:
        known = known.withColumn("mac", _mac(F.col("form"), key)).join(vault.select("mac", F.col("token").alias("old")), "mac", "left").withColumn("token", F.coalesce("old", "token"))
    known = written(known.select("form", "kind", "token", F.length("form").alias("size")), "known")
    if known.limit(limit + 1).count() <= limit:
        rows = [(r["form"], r["kind"], r["token"]) for r in known.orderBy(F.desc("size"), "form").collect()]
        shared = texts.sparkSession.sparkContext.broadcast(rows)
        done = texts.withColumn("done", _replacer(shared)(F.col("text")))
    else:
        own = _own_forms(texts, known)
        done = texts.join(own, texts["key"].cast("string").eqNullSafe(own["of"]), "left").withColumn("done", _own_replacer(F.col("text"), F.col("own")))
    return done.select("key", F.col("done.text").alias("text"), F.col("done.hits").alias("hits"))


def _replacer(shared) -> Callable[[Column], Column]:
    @F.arrow_udf("text string, hits array<string>")
    def replaced(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = _dictionary_replace(shared.value)  # once a task
        for part in cut(texts):
            done = [run(t) if t else (t, []) for t in part.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([h for _, h in done], pa.list_(pa.string()))], names=["text", "hits"])

    return replaced


@F.pandas_udf(T.StringType())
def _low(texts: pd.Series) -> pd.Series:
    """Lower case as the replacing step sees it."""
    return texts.str.lower()


@F.pandas_udf(T.StringType())
def _needle(forms: pd.Series) -> pd.Series:
    """What stands in a text, or in a token that is put into it, wherever the form does: a form with brackets may reach across a token's edge."""
    return forms.map(lambda f: max(re.split(r"[\[\]]", f), key=len).lower() or f[0])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("hits", T.ArrayType(T.StringType()))]))
def _own_replacer(texts: pd.Series, forms: pd.Series) -> pd.DataFrame:
    def run(text, own):
        hits: list[str] = []
        for e in own if text and own is not None else ():
            if e["form"].lower() in text.lower():
                text, n = re.subn(re.escape(e["form"]), lambda _m, t=e["token"]: t, text, flags=re.IGNORECASE)
                hits += [f"DICT_{e['kind']}"] * n
        return text, hits

    return pd.DataFrame([run(t, own) for t, own in zip(texts, forms, strict=True)], columns=["text", "hits"])


def _own_forms(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(of, own): by each text's key, the forms that can count in it, in order: those that it holds, and those that tokens put into it may hold."""
    needles = written(known.withColumn("needle", _needle(F.col("form"))), "needles")
    forms = needles.groupBy("needle").agg(F.collect_list(F.struct((-F.col("size")).alias("less"), "form", "kind", "token")).alias("entries"))  # spellings of one needle
    forms = written(forms.withColumnRenamed("needle", "form"), "forms")
    views = lambda key, text: [F.col(key).cast("string").alias("key"), F.array(F.coalesce(_low(F.col(text)), F.lit(""))).alias("views")]

    def held(rows: DataFrame) -> DataFrame:
        return lookup(occurring(rows, forms), forms, "form").select("key", F.explode("entries").alias("entry"))

    every = fresh = written(held(texts.select(*views("key", "text"))), "own")
    seen = inside = None
    while True:
        tokens = fresh.select(F.col("entry.token").alias("token")).distinct()
        tokens = written(tokens if seen is None else tokens.join(seen, "token", "left_anti"), "tokens")
        into = written(held(tokens.select(*views("token", "token"))).select(F.col("key").alias("token"), F.col("entry").alias("more")), "inside")
        seen, inside = (tokens, into) if seen is None else (seen.unionAll(tokens), inside.unionAll(into))
        more = fresh.select("key", F.col("entry.token").alias("token")).distinct().join(inside, "token").select("key", F.col("more").alias("entry")).distinct()
        fresh = written(more.join(every, [more["key"].eqNullSafe(every["key"]), more["entry.form"] == every["entry.form"]], "left_anti"), "own")
        if fresh.isEmpty():
            break
        every = every.unionAll(fresh)
    return every.distinct().groupBy(F.col("key").alias("of")).agg(F.array_sort(F.collect_list("entry")).alias("own"))  # a text's own forms


def number_tokens(values: DataFrame, vault: DataFrame | None) -> DataFrame:
    """Tokens [KIND_n] for new (value, kind, ord), n by kind in order of ``ord``, from the vault's highest number on.

    A kind may hold most values, so no task sorts a whole kind.
    """
    placed = numbered(values, ["ord"], ["kind"])
    if vault is None:
        top = F.lit(0)
    else:
        last = vault.filter(F.rlike("token", F.lit(r"^\[[A-Z_]+_\d+\]$")) & ~F.rlike("token", F.lit(r"^\[P\d+_"))).groupBy("kind").agg(F.max(F.regexp_extract("token", r"_(\d+)\]$", 1).cast("bigint")).alias("top"))
        placed, top = placed.join(last, "kind", "left"), F.coalesce("top", F.lit(0))
    return placed.select("value", "kind", "ord", F.format_string("[%s_%d]", F.col("kind"), top + F.col("nth")).alias("token"))


def mask(texts: DataFrame, key_col: str, text_col: str, entries: DataFrame | None = None, site: str = "data", vault: DataFrame | None = None, key: bytes = b"", patient_id: str | None = None, allow_emails=()) -> tuple[DataFrame, DataFrame]:
    """((key, text, hits, tainted), new vault rows (mac, token, kind, value_enc, ord)); ``key_col`` gives the order, and may be null or the same in several rows."""
    rows = texts.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    if site in SKIPPED_SITES:
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
        return rows.select("key", "text", none.alias("hits"), F.lit(False).alias("tainted")), rows.sparkSession.createDataFrame([], VAULT_SCHEMA)
    work = rows if site == "code" else rows.withColumn("text", light(F.col("text")))
    work = apply_dictionary(work, entries, vault, key) if entries is not None else work.withColumn("hits", F.array().cast("array<string>"))
    found = find_spans(F.col("text"), patient_id, allow_emails, CODE_KINDS if site == "code" else None)
    # texts, tokens and the vault are three uses of the same work, so it is done once; spans come back to their row by its number, as keys may repeat
    work = written(work.withColumn("spans", resolve(F.col("text"), found)).withColumn("row", F.monotonically_increasing_id()), "spans")
    one = work.select("key", "row", F.posexplode("spans").alias("nth", "span")).select("key", "row", "nth", F.col("span.value").alias("value"), F.col("span.kind").alias("kind"), F.col("span.start").alias("start"), F.col("span.end").alias("end"))
    place = F.struct("key", "row", "start")
    firsts = one.groupBy("value").agg(F.min_by("kind", place).alias("kind"), F.min(place).alias("ord"))
    if vault is not None:
        macs = firsts.withColumn("mac", _mac(F.col("value"), key))
        stored = macs.join(vault.select("mac", "token"), "mac").select("value", "token")
        fresh = macs.join(vault.select("mac"), "mac", "left_anti").drop("mac")
    else:
        stored, fresh = None, firsts
    new = written(number_tokens(fresh, vault), "tokens")
    tokens = new.select("value", "token") if stored is None else new.select("value", "token").union(stored)
    placed = lookup(one, tokens, "value").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "token", "kind"))).alias("placed"))  # a text's own spans
    plain = work.filter("size(spans) = 0").withColumn("placed", F.lit(None).cast(placed.schema["placed"].dataType))
    out = work.filter("size(spans) > 0").join(placed, "row", "left").unionByName(plain)
    kinds = F.concat("hits", F.coalesce(F.transform("placed", lambda s: s["kind"]), F.array().cast("array<string>")))
    counted = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)).cast("bigint"))))
    done = out.select("key", F.when(F.col("placed").isNull(), F.col("text")).otherwise(replace(F.col("text"), F.col("placed"))).alias("text"), counted.alias("hits"), F.lit(False).alias("tainted"))
    top = vault.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] if vault is not None else -1
    return done, vault_rows(new, key, top + 1)


def _secret(key: bytes) -> Column:
    return F.substring(F.sha2(F.lit(b"vault:" + key), 256), 1, 32).cast("binary")


def encrypted(value: Column, key: bytes) -> Column:
    """A value as it lies in the vault."""
    return F.aes_encrypt(value.cast("binary"), _secret(key))


def vault_rows(new: DataFrame, key: bytes, first: int = 0) -> DataFrame:
    """New tokens as rows of the vault: the value's keyed hash, and the value itself encrypted; ``ord`` goes on from ``first``."""
    return new.select(_mac(F.col("value"), key).alias("mac"), "token", "kind", encrypted(F.col("value"), key).alias("value_enc"), (F.monotonically_increasing_id() + first).alias("ord"))


def person_rows(entries: DataFrame, key: bytes) -> DataFrame:
    """Vault rows of a dictionary, so that persons' tokens can be mapped back."""
    return vault_rows(entries.select(F.col("form").alias("value"), "kind", F.format_string("[%s_%s]", "person", "kind").alias("token")), key)


def token_values(vault: DataFrame, key: bytes) -> DataFrame:
    """(token, value): the first spelling that was recorded for each token."""
    return vault.groupBy("token").agg(F.min_by("value_enc", "ord").alias("enc")).select("token", F.aes_decrypt("enc", _secret(key)).cast("string").alias("value"))


def unmask(texts: DataFrame, key_col: str, text_col: str, vault: DataFrame, key: bytes, caller: str = "cli", json: bool = False) -> DataFrame:
    """(key, text) with tokens replaced by their values; unknown tokens stay. Other callers than UNMASK_CALLERS are refused.

    With ``json``, texts are JSON: tokens in string values at any depth are replaced, with the
    escapes that the values need there, and keys stay as they are.
    """
    if caller not in UNMASK_CALLERS:
        raise PermissionError("unmask is for display and local services only")
    token, values = TOKEN + _NO_KEY if json else TOKEN, token_values(vault, key)
    if json:
        escaped = F.to_json(F.array("value"))
        values = values.withColumn("value", F.substring(escaped, F.lit(3), F.length(escaped) - 4))  # within ["..."]
    rows = texts.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).withColumn("__tokens", F.regexp_extract_all("text", F.lit(token), F.lit(0)))
    # only the texts that hold a token take part: their distinct tokens are looked up, and then come back as one map a text
    held = rows.filter("size(__tokens) > 0")
    asked = written(held.select("key", F.explode(F.array_distinct("__tokens")).alias("token")), "asked")  # looked at more than once
    known = lookup(asked, values, "token").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("__known"))  # a text's own tokens
    piece = F.zip_with(F.split("text", token, -1), "__tokens", lambda gap, t: F.concat(gap, F.coalesce(F.element_at("__known", t), t, F.lit(""))))
    filled = held.join(known, "key", "left").select("key", F.when(F.col("__known").isNull(), F.col("text")).otherwise(F.array_join(piece, "")).alias("text"))
    return rows.filter("text is null or size(__tokens) = 0").select("key", "text").unionByName(filled)


def argument_verdicts(args: DataFrame, key_col: str, text_col: str, entries: DataFrame | None = None, **rules) -> DataFrame:
    """(key, deny, kinds): whether serialised arguments name a known person, a patient or an individual number."""
    masked, _ = mask(args, key_col, text_col, entries, site="prompt", **rules)
    kinds = F.array_sort(F.filter(F.map_keys("hits"), lambda k: F.startswith(k, F.lit("DICT_")) | k.isin("PATIENT_ID", "MYNUMBER")))
    return masked.select("key", (F.size(kinds) > 0).alias("deny"), kinds.alias("kinds"))
