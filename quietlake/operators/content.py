"""Content blocks of conversations, flattened into rows: their texts, media policy, write-back, and how strictly a row is masked."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Block types, tools, doors, envelope fields and notices.
MEDIA = ["image", "document", "audio"]
ENGINE_OWNED = ["thinking", "redacted_thinking", "tool_use", "server_tool_use"]
CODE_TOOLS = ["Read", "Edit", "Write", "MultiEdit", "NotebookEdit", "Grep", "Glob", "LS"]
PROMPT_DOORS, ATTACHMENT_DOORS = ["prompt", "command", "delivery"], ["attachment", "hook-context", "note"]
ENVELOPE = ["tool", "tool_use_id", "consent", "agentId"]
BLOCKED = "[quietlake] 個人情報の検査に失敗したため、内容を伏せています。"
DROPPED = "[quietlake] 検査できない画像や文書は取り除きました。"


def site_of(door: Column, kind: Column, tool: Column, safe_prefixes=(), bash_site: str = "data") -> Column:
    """How strictly to mask a row, from where it came."""
    tool = F.coalesce(tool, F.lit(""))
    safe = F.lit(False)
    for prefix in filter(None, safe_prefixes):
        safe = safe | F.startswith(tool, F.lit(prefix))
    by_tool = F.when(safe, "safe").when(tool.isin(CODE_TOOLS), "code").when(tool == "Bash", bash_site).otherwise("data")
    by_door = F.when(door.isin(PROMPT_DOORS), "prompt").when(door.isin(ATTACHMENT_DOORS), "attachment").otherwise("data")
    return F.when(kind == "tool", by_tool).otherwise(by_door)


def tool_args(event: Column) -> Column:
    """A tool call's own arguments: its JSON object without the envelope."""
    fields = F.from_json(event, "map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, _v: ~k.isin(ENVELOPE)))


def _texts(blocks) -> list[dict]:
    """The readable blocks, in order; blocks inside of tool results count, media and the engine's own don't."""
    found = []
    for block in blocks if isinstance(blocks, list) else []:
        kind = block.get("type") if isinstance(block, dict) else None
        field = {"text": "text", "tool_result": "content"}.get(kind)
        if field and isinstance(block.get(field), str):
            found.append((block, field))
        elif kind == "tool_result":
            found += _texts(block.get("content"))
    return found


def _blocks(content: str | None) -> list | None:
    """The blocks, or None if the text isn't a JSON array of objects, nested ones included."""

    def sound(blocks) -> bool:
        return isinstance(blocks, list) and all(isinstance(b, dict) and (not isinstance(b.get("content"), list) or b.get("type") != "tool_result" or sound(b["content"])) for b in blocks)

    try:
        blocks = json.loads(content)
        return blocks if sound(blocks) else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def block_texts(contents: pd.Series) -> pd.Series:
    """All texts that a reader of the blocks (JSON) would see; null where the blocks can't be read."""
    return contents.map(lambda c: [] if not c else None if (blocks := _blocks(c)) is None else [b[f] for b, f in _texts(blocks)])


def _without_media(blocks: list, top: bool = True) -> tuple[list, int]:
    kept, dropped = [], 0
    for block in blocks:
        if block.get("type") in MEDIA:
            dropped += 1
            continue
        if block.get("type") == "tool_result" and isinstance(block.get("content"), list):
            inner, n = _without_media(block["content"], top=False)
            block, dropped = {**block, "content": inner or [{"type": "text", "text": DROPPED}]}, dropped + n
        kept.append(block)
    if top and dropped and not kept:
        kept = [{"type": "text", "text": DROPPED}]
    return kept, dropped


def _write_back(content: str, texts, keep_media: bool) -> tuple[str | None, int]:
    if content is None:
        return None, 0
    if (blocks := _blocks(content)) is None:  # nobody can say what it holds
        return json.dumps([{"type": "text", "text": BLOCKED}], ensure_ascii=False), 0
    for (block, field), text in zip(_texts(blocks), texts, strict=False):
        if text is not None:
            block[field] = text
    blocks, dropped = (blocks, 0) if keep_media else _without_media(blocks)
    return json.dumps(blocks, ensure_ascii=False), dropped


def apply_texts(content: Column, texts: Column, images: str = "drop") -> Column:
    """(content, dropped): the blocks with their texts replaced in order; a missing text leaves the old one; media go unless they pass.

    What isn't a JSON array of blocks is withheld as a whole.
    """

    @F.pandas_udf("content string, dropped int")
    def written(contents: pd.Series, given: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_write_back(c, [] if t is None else list(t), images == "pass") for c, t in zip(contents, given, strict=True)], columns=["content", "dropped"])

    return written(content, texts)


def blocked_content(content: Column) -> Column:
    """The blocks with every text replaced by a notice and without media: what a failed inspection leaves."""
    return apply_texts(content, F.transform(block_texts(content), lambda _t: F.lit(BLOCKED)))["content"]


def findings(hits: DataFrame, file_col: str = "file") -> DataFrame:
    """(file, kind, n) from rows with a map ``hits``."""
    return hits.select(file_col, F.explode("hits").alias("kind", "n")).groupBy(file_col, "kind").agg(F.sum("n").alias("n"))
