"""Normal forms of text: widths, variant kanji, kana, digits; and the forms under which a value may show."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut

# Variant kanji and their common forms, in the same order.
VARIANTS = "髙﨑嵜齋齊斉邊邉澁國廣嶋櫻眞濵濱萬冨德瀨龍惠條彌禮舘藏壽實澤黑繫靜鐵榮與會學縣關靑淸"
STANDARD = "高崎崎斎斎斎辺辺渋国広島桜真浜浜万富徳瀬竜恵条弥礼館蔵寿実沢黒繋静鉄栄与会学県関青清"

HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(chr(ord(c) + 0x60) for c in HIRAGANA)
#: What Python's str.isspace, and thus \s, calls white space.
_BLANKS = r"[\s\x1c-\x1f\x85   -     　]+"
#: The same, character by character.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE_SPACE))


#: Blocks of common scripts. Greek has a letter whose lower case depends on its place.
_BLOCKS = [(0, 0x2FF), (0x370, 0x52F), (0x2010, 0x206F), (0x3000, 0x30FF), (0x4E00, 0x9FFF)]


def _stable(blocks=tuple(_BLOCKS)) -> str:
    """Ranges, for a pattern, of characters of common scripts that NFKC leaves alone in any order: none combines with one before it."""
    kept = [c for low, high in blocks for c in range(low, high + 1) if unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c))]
    starts = [c for c, before in zip(kept, [-2, *kept], strict=False) if c != before + 1]
    ends = [c for c, after in zip(kept, [*kept[1:], -2], strict=True) if c + 1 != after]
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in zip(starts, ends, strict=True))


#: A character that may change under NFKC; ASCII, which never does, is told by one range before the others are looked at.
UNSTABLE = rf"[\x{{80}}-\x{{10ffff}}&&[^{_stable()}]]"
#: A character whose views only Spark makes; all others have the same ones in Python, whatever Unicode's version.
ODD = rf"[\x{{80}}-\x{{10ffff}}&&[^{_stable([(0, 0x2FF), (0x400, 0x52F), *_BLOCKS[2:]])}]]"
_HIRAGANA_FOLD, _ANY_HIRAGANA = str.maketrans(HIRAGANA, KATAKANA), re.compile(f"[{HIRAGANA[0]}-{HIRAGANA[-1]}]")
_NO_DIGITS = bytes(c for c in range(256) if not 0x30 <= c <= 0x39)


@F.arrow_udf(T.StringType())
def _composed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in cut(texts):
        yield pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, which Spark has no function for; only texts that may change go to Python."""
    return F.coalesce(_composed(F.when(F.rlike(text, F.lit(UNSTABLE)), text)), text)


def fold_variants(text: Column) -> Column:
    return F.translate(text, VARIANTS, STANDARD)


def fold_kana(text: Column) -> Column:
    return F.translate(text, HIRAGANA, KATAKANA)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, _BLANKS, "")


def light(text: Column) -> Column:
    """NFKC and common kanji; case and blanks stay."""
    return fold_variants(nfkc(text))


def canon(text: Column) -> Column:
    """The form in which spellings are compared: light, katakana, no blanks, lower case."""
    return F.lower(squeeze(fold_kana(light(text))))


def digits(text: Column) -> Column:
    return F.regexp_replace(nfkc(text), r"(?U)\D", "")


def _forms(raw: Column, base: Column, number: Column, with_raw: bool) -> Column:
    plain = ([raw] if with_raw else []) + [base, F.lower(base), fold_kana(base), F.lower(fold_kana(base))]
    every = F.array(*plain, *map(squeeze, plain), F.when(F.length(number) >= 7, number).otherwise(""))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def value_forms(value: Column) -> Column:
    """Forms of a dictionary's value inside of light text."""
    base = light(strip(value))
    return _forms(value, base, digits(base), with_raw=False)


def egress_forms(value: Column) -> Column:
    """Forms that a protected value may take on its way out; kanji variants stay as they are."""
    raw = strip(value)
    base = nfkc(raw)
    return _forms(raw, base, F.regexp_replace(base, r"(?U)\D", ""), with_raw=True)


def admitted(form: Column) -> Column:
    """Digits alone need seven characters, all else three."""
    return F.length(form) >= F.when(F.rlike(form, F.lit(r"^(?U)\d+$")), 7).otherwise(3)


def haystacks(text: Column) -> Column:
    """The views of a text in which protected forms are looked for."""
    base = nfkc(text)
    kana = fold_kana(base)
    return F.array(text, base, F.lower(base), squeeze(base), kana, F.lower(kana), squeeze(kana), F.regexp_replace(base, r"(?U)\D", ""))


def odd(text: Column) -> Column:
    """The text if it has an odd character, else null."""
    return F.when((F.length(text) != F.octet_length(text)) & F.rlike(text, F.lit(ODD)), text)


def plain_views(text: str) -> list[str]:
    """The distinct haystacks of a text without odd characters, which is its own NFKC and has no digits but ASCII's."""
    views = [text, text.lower(), "".join(text.split()), text.encode("ascii", "ignore").translate(None, _NO_DIGITS).decode("ascii")]
    if not text.isascii() and _ANY_HIRAGANA.search(text):
        kana = text.translate(_HIRAGANA_FOLD)
        views += [kana, kana.lower(), "".join(kana.split())]
    return list(dict.fromkeys(views))
