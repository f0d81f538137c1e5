"""Rules that find personal data in text, as arrays of spans; resolving and replacing them is native."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import cut

# The patterns of each kind, in the order in which equal spans rank.
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?<![\d-])(?:\+81[-\s]?\d{1,4}|0(?:[1-9]\d{0,3}))[-\s(]?\d{1,4}[-\s)]?\d{3,4}(?![\d-])"
ZIP = r"〒\s?\d{3}-?\d{4}|(?<![\d-])\d{3}-\d{4}(?![\d-])"
MYNUMBER = r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)"
DOB_WESTERN = r"(?<!\d)(?:19|20)\d{2}\s?[年/.-]\s?\d{1,2}\s?[月/.-]\s?\d{1,2}\s?日?"
DOB_ERA = r"(?:令和|平成|昭和|大正|明治|[RHSTM])\s?(?:元|\d{1,2})年\s?\d{1,2}月\s?\d{1,2}日"
ADDRESS = (
    r"(?:北海道|東京都|京都府|大阪府|[一-龥]{2,3}県)[一-龥ぁ-んァ-ヶー]{1,10}(?:市|区|町|村|郡)[一-龥ぁ-んァ-ヶー]{0,12}"
    r"(?:[0-9一二三四五六七八九十]{1,4}(?:丁目|番地|番|号|-)){1,3}[0-9一二三四五六七八九十]{0,4}"
    r"(?:\s?[一-龥ぁ-んァ-ヶーA-Za-z0-9]{1,20}(?:ビル|マンション|ハイツ|コーポ|荘|号室|階|F))?"
)
ZIP_CONTEXT = r"〒|郵便|住所|所在地|お届け先|ご住所"
MYNUMBER_CONTEXT = r"マイナンバー|個人番号|my\s*number"
DOB_CONTEXT = r"生年月日|生まれ|誕生日|DOB|birth"
CODE_CONTEXT = r"arn:|://|[0-9a-f]{20,}|aws|account"
WINDOW, CODE_BEFORE, CODE_AFTER = 40, 12, 2
#: Keys and hashes: digits in the midst of them are no telephone number, which takes 12 digits at most.
CODE_RUN, LONGEST_RUN = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}|AKIA[0-9A-Z]{16}"), 16

#: What a text must hold for a rule to match at all, as the rules' own loop and as Spark look for it; a digit may be newer than Java's tables.
NEEDLES = {
    "EMAIL": lambda t: "@" in t,
    "ADDRESS": re.compile("[市区町村郡]").search,
    **dict.fromkeys(("PHONE", "ZIP", "MYNUMBER", "DOB"), re.compile(r"\d").search),
}
_DIGIT = r"[\p{Nd}\p{Cn}]"
LOOKS = {
    "EMAIL": "@",
    "ADDRESS": "[市区町村郡]",
    "PHONE": r"(?<![\p{Nd}-])(?:\+81|0[1-9])",
    "ZIP": f"〒|{_DIGIT}{{3}}-{_DIGIT}{{4}}",
    "MYNUMBER": f"{_DIGIT}{{4}}(?s:.?){_DIGIT}{{4}}(?s:.?){_DIGIT}{{4}}",
    "DOB": f"年|(?:19|20){_DIGIT}{{2}}(?s:.?)[/.-]",
}

SPANS = "array<struct<kind:string,start:int,end:int,rule:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.int32())]))


def _within(pattern: str, before: int, after: int):
    search = re.compile(pattern, re.IGNORECASE).search
    return lambda text, m: search(text, max(0, m.start() - before), min(len(text), m.end() + after)) is not None


def _real_address(allowed: frozenset[str]):
    def test(text, m):
        domain = m[0].lower().rpartition("@")[2]
        return not (domain in allowed or domain.startswith("example.") or domain.endswith((".invalid", ".test")))

    return test


def _in_code_run(text, m) -> bool:
    """Whether a match lies inside of a run that is a key or a hash; so much of the run as tells that is looked at."""
    return any(r.start() <= m.start() and m.end() <= r.end() for r in CODE_RUN.finditer(text, max(0, m.start() - LONGEST_RUN), m.end() + LONGEST_RUN))


def rules(patient_id: str | None = None, allow_emails=()) -> list[tuple]:
    """(kind, pattern, test of a match) in ranking order."""
    birth, near_zip, near_number = _within(DOB_CONTEXT, WINDOW, WINDOW), _within(ZIP_CONTEXT, WINDOW, WINDOW), _within(MYNUMBER_CONTEXT, WINDOW, WINDOW)
    code = _within(CODE_CONTEXT, CODE_BEFORE, CODE_AFTER)
    always = lambda text, m: True
    table = [
        ("EMAIL", EMAIL, _real_address(frozenset(a.lower() for a in allow_emails))),
        ("PHONE", PHONE, lambda text, m: 10 <= sum(c.isdigit() for c in m[0]) <= 12 and not _in_code_run(text, m)),
        ("ZIP", ZIP, lambda text, m: m[0][0] == "〒" or near_zip(text, m)),
        ("MYNUMBER", MYNUMBER, lambda text, m: near_number(text, m) and not code(text, m)),
        ("DOB", DOB_WESTERN, birth),
        ("DOB", DOB_ERA, birth),
        ("ADDRESS", ADDRESS, always),
    ]
    if patient_id:
        table.append(("PATIENT_ID", patient_id, always))
    return [(kind, re.compile(pattern), test) for kind, pattern, test in table]


def find_spans(text: Column, patient_id: str | None = None, allow_emails=(), kinds: tuple[str, ...] | None = None) -> Column:
    """All matches of the rules in each text, unresolved."""

    @F.arrow_udf(SPANS)
    def spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        active = [(i, *r) for i, r in enumerate(rules(patient_id, allow_emails)) if kinds is None or r[0] in kinds]

        def of(t: str | None) -> list[dict]:
            due = [(i, k, p, test) for i, k, p, test in active if k not in NEEDLES or NEEDLES[k](t)] if t else []
            return [{"kind": k, "start": m.start(), "end": m.end(), "rule": i} for i, k, p, test in due for m in p.finditer(t) if test(t, m)]

        for part in cut(texts):
            yield pa.array([of(t) for t in part.to_pylist()], _SPANS)

    if patient_id and (kinds is None or "PATIENT_ID" in kinds):
        return spans(text)  # whatever that pattern needs
    return spans(F.when(F.rlike(text, F.lit("|".join(look for kind, look in LOOKS.items() if kinds is None or kind in kinds))), text))


def resolve(text: Column, spans: Column) -> Column:
    """Of overlapping spans the first, and of those the longest; a span around a token is no span."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-(s["end"] - s["start"])).alias("less"), s["rule"].alias("rule"), s["kind"].alias("kind"), s["end"].alias("end"))))
    none = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("kept"))

    def step(acc, s):
        value = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        taken = (s["start"] >= acc["last"]) & ~(F.contains(value, F.lit("[")) & F.contains(value, F.lit("]")))
        one = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value.alias("value"))
        return F.struct(F.when(taken, s["end"]).otherwise(acc["last"]).alias("last"), F.when(taken, F.array_append(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(ordered, none, step, lambda acc: acc["kept"])


def replace(text: Column, spans: Column) -> Column:
    """The text with each (start, end) of ordered, disjoint spans replaced by its token."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["token"])).alias("parts"))
    return F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


# Fixed value: runs that may carry encoded data out.
BLOB = r"[A-Za-z0-9+/=_-]{48,}"
BLOB_NOTICE = "[ENCODED_BLOB_WITHHELD]"


def blob_hits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BLOB))


def withhold_blobs(text: Column) -> Column:
    return F.regexp_replace(text, BLOB, BLOB_NOTICE)
