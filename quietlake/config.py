"""Settings, and what names of columns tell."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import ClassVar

# Parts of column names that mark personal data.
PII_NAME_PARTS = [
    "name", "氏名", "名前", "kana", "カナ", "ふりがな",
    "tel", "phone", "電話", "mobile", "携帯", "fax",
    "mail", "メール",
    "birth", "dob", "生年月日", "誕生日",
    "address", "住所", "zip", "postal", "郵便",
    "patient", "患者", "member", "会員", "customer", "顧客",
    "user_id", "userid", "device_id", "deviceid", "line_id", "slack_id",
    "mynumber", "マイナンバー", "個人番号", "保険", "insurance", "passport", "license", "免許",
    "ip", "ip_address", "ua", "user_agent",
]

# A count column's whole name, or its part before the first blank or underscore.
COUNT_WORDS = ["n", "cnt", "count", "num", "number", "total", "rows", "件数", "人数", "回数", "user", "users", "patient", "patients", "member", "members", "ticket", "tickets", "event", "events", "session", "sessions"]


def _squeezed(name: str) -> str:
    return re.sub(r"[\s_-]", "", name)


def is_pii_column(name: str, parts: list[str] | None = None) -> bool:
    """Whether a column's name alone marks it as personal data; blanks, underscores and hyphens don't matter."""
    low = name.strip().lower()
    return any(p.lower() in low or _squeezed(p.lower()) in _squeezed(low) for p in (PII_NAME_PARTS if parts is None else parts))


def is_count_column(name: str) -> bool:
    """Whether a column's name says that it holds a count."""
    low = name.strip().lower()
    return low.startswith("count(") or re.split(r"[_\s]", low, maxsplit=1)[0] in COUNT_WORDS


@dataclass
class Settings:
    """Limits and paths; ``load`` reads the sections of a TOML file, and whatever that lacks keeps its default."""

    inbox: str = "~/PII/inbox"
    safe_dir: str = "./data/safe"
    analysis_dir: str = "./analysis"
    jdbc_url: str = ""
    db_schema: str = "safe"
    max_rows: int = 50
    max_output_chars: int = 40_000
    small_cell: int = 11
    result_bytes: int = 8_192
    string_max: int = 64
    timeout_s: int = 120
    statement_timeout_s: int = 30
    pii_parts: list[str] = field(default_factory=lambda: list(PII_NAME_PARTS))
    key_file: str = "~/.config/quietlake/pseudo.key"
    patient_id_regex: str | None = None
    allow_email_domains: list[str] = field(default_factory=list)

    #: section and key of the file, by field where they differ from it
    _NAMES: ClassVar[dict] = {
        "inbox": ("paths", "pii_inbox"), "safe_dir": ("paths", "safe_dir"), "analysis_dir": ("paths", "analysis_dir"), "jdbc_url": ("db", "url"), "db_schema": ("db", "schema"),
        "max_rows": ("limits", "max_rows"), "max_output_chars": ("limits", "max_output_chars"), "small_cell": ("limits", "small_cell"), "result_bytes": ("limits", "py_result_bytes"),
        "string_max": ("limits", "py_string_max"), "timeout_s": ("limits", "py_timeout_s"), "pii_parts": ("pii_columns", "patterns"), "key_file": ("pseudo", "key_file"),
        "patient_id_regex": ("masking", "patient_id_regex"), "allow_email_domains": ("masking", "allow_email_domains"),
    }

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        file = Path(path).expanduser()
        given = tomllib.loads(file.read_text(encoding="utf-8")) if file.exists() else {}
        found = {name: given[section][key] for name, (section, key) in cls._NAMES.items() if key in given.get(section, {})}
        kinds = {f.name: f.type for f in fields(cls)}
        return cls(**{k: int(v) if kinds[k] == "int" else v for k, v in found.items()})

    def is_pii(self, name: str) -> bool:
        return is_pii_column(name, self.pii_parts)
