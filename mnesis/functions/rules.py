"""Text rules of the write path and the evaluation: classification, injection labels, normalisation, dates, magic bytes."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and patterns of the injection gate, in order; case is ignored.
INJECTION = (
    ("en:ignore-previous-instructions", r"ignore\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|messages?)"),
    ("en:disregard-previous", r"disregard\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?)"),
    ("zh:ignore-previous-instructions", r"忽略((之前|以上|上面|先前|所有|全部|任何)的?)+(系统)?(指令|提示词?|规则|设定|约束)"),
    ("zh:override-instructions", r"(无视|推翻|覆盖)((之前|以上|上面|所有|系统)的?)+(指令|规则|设定)"),
    ("zh:fake-authority", r"(系统|管理员|开发者|运营方)(指令|通知|要求)(：|:)"),
    ("en:role-hijack", r"you\s+are\s+now\s+(a|an|no\s+longer)"),
    ("en:prompt-exfiltration", r"(reveal|print|show|output)\s+(me\s+)?(your\s+)?(system\s+prompt|initial\s+instructions?|hidden\s+rules?)"),
    ("zh:prompt-exfiltration", r"(输出|打印|泄露|吐出)(你的|系统的)?(系统提示词|初始指令|隐藏规则)"),
    ("zh:must-execute", r"(必须|立即|马上)(执行|遵照|obey)(以下|如下|这条|下面)(的)?(指令|命令|要求)"),
    ("ex:jailbreak", r"jailbreak\s*(prompt|mode|template)|越狱(模式|提示词|模板)"),
)

# Rules of the memory type, in order (type, rule, pattern); what matches none is episodic by default.
TYPE_RULES = (
    ("procedural", "code_block", r"```|\bdef \w+\(|\bclass \w+[:（(]|\bimport \w+"),
    ("procedural", "command", r"\b(git|curl|pip|apt|docker|systemctl|psql|pytest|grep|sed|awk|npm|make)\s+\S|\bpython3?\s+-m\b"),
    ("procedural", "rule_word", r"coding|代码|脚本|命令行?用法|规则|流程|步骤|SOP|规范|手册|做法|禁止|必须|前置条件"),
    ("semantic", "definition", r"(?<!自)定义|是指|指的是|含义|概念|原理|定律|定理|means\b|defined as|refers to"),
    ("semantic", "fact_word", r"事实[:：]|架构[:：]|口径[:：]|属于.{1,12}(类别|类型|种类)"),
)

# Leading bytes (hexadecimal) of the image types.
MAGIC = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"))


def injection_labels(text: Column) -> Column:
    """The labels of the patterns that a text matches, in order; none for a null."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?iu){p}"), F.lit(k)) for k, p in INJECTION]))


def should_scan(tier: Column, scope: str = "external_only") -> Column:
    """Whether a row of that source tier goes through the gate: all do, or those that no user wrote."""
    return F.lit(True) if scope == "all" else F.coalesce(tier, F.lit("agent")) != "user"


def classify(text: Column) -> Column:
    """struct(memory_type, rule) of the first rule that the text matches, words being Unicode's."""
    out = F.struct(F.lit("episodic").alias("memory_type"), F.lit("default").alias("rule"))
    for kind, rule, pattern in reversed(TYPE_RULES):
        out = F.when(F.coalesce(text, F.lit("")).rlike(f"(?U){pattern}"), F.struct(F.lit(kind).alias("memory_type"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def staleness(original: Column, now: Column) -> Column:
    """fresh up to 30 days (or without a date), aging up to 90, then stale."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(original.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.when(original.isNull() | (days <= 30), "fresh").when(days <= 90, "aging").otherwise("stale")


def derive_title(text: Column, most: int = 48) -> Column:
    """The first line that a text begins with after white space, cut at `most` characters; untitled if there is none."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    line = F.left(F.regexp_replace(F.element_at(F.split(whole, r"\r\n|[\r\n]"), 1), r"\s+$", ""), F.lit(most))
    return F.when(F.length(line) > 0, line).otherwise(F.lit("untitled"))


def squeezed(text: Column) -> Column:
    """A text without its white space, in lower case: what quotations are matched on."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def norm_group(text: Column, most: int = 120) -> Column:
    """A group's name without outer white space, cut; null if nothing is left."""
    out = F.left(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(most))
    return F.when(F.length(out) > 0, out)


def norm_ids(ids: Column, most: int = 200) -> Column:
    """The first `most` ids as strings; null for none."""
    out = F.slice(ids.cast("array<string>"), 1, most)
    return F.when(F.size(out) > 0, out)


def probe_state(writes: Column, landed: Column, eligible: Column) -> Column:
    """Where the chain from feedback to use breaks, if it does."""
    return F.when(writes == 0, "no_writes").when(landed == 0, "write_only").when(eligible == 0, "joined_no_consume").otherwise("alive")


def session_date(text: Column) -> Column:
    """The first yyyy/mm/dd ... hh:mm of a text as a time; null if there is none or no such time."""
    pattern = r"(\d{4})/(\d{2})/(\d{2}).*?(\d{2}):(\d{2})"
    part = lambda k: F.regexp_extract(text, pattern, k)
    joined = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":00"))
    return F.when(text.rlike(pattern), F.try_to_timestamp(joined, F.lit("yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")


def sniff_mime(content: Column) -> Column:
    """The image type that the leading bytes show; null if none."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.left(head, F.lit(8)).eqNullSafe("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "image/webp")
    for magic, mime in reversed(MAGIC):
        out = F.when(head.startswith(magic), F.lit(mime)).otherwise(out)
    return out


def session_of(turn: Column) -> Column:
    """A turn's id without its last _part: that of its session."""
    return F.regexp_replace(turn, "_[^_]*$", "")


def is_uuid(text: Column) -> Column:
    return text.rlike("(?i)^[0-9a-f-]{36}$")


def lenient_json(text: Column) -> Column:
    """What stands from the first { to the last } of a text (fences and words around go), if it is JSON; else null."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def window_days(days: int | None) -> int:
    """A look-back in days: 7 by default, from 1 to 365."""
    return 7 if days is None else max(1, min(365, int(days)))


FILTERS = {"domain", "tags", "tenant_id", "agent_id", "staleness", "memory_type", "date_range", "as_of", "include_archived"}
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?")


def utc(value: str) -> datetime:
    """An ISO 8601 date or time as a time of UTC without a zone, as the rows have them: Z and offsets count, none is UTC. What is no such date is a ValueError."""
    text = str(value)
    if not _ISO.fullmatch(text):
        raise ValueError(f"{text!r} is no ISO 8601 date")
    at = datetime.fromisoformat(text)
    return at if at.tzinfo is None else at.astimezone(UTC).replace(tzinfo=None)


def validate_filters(filters: dict | None) -> dict:
    """Filters as they came, or a ValueError: an object with ISO dates, known staleness values and memory types."""
    if filters is None:
        return {}
    if not isinstance(filters, dict):
        raise ValueError("filters must be an object")
    listed = lambda x: list(x) if isinstance(x, (list, tuple)) else [x]
    for key, allowed in (("staleness", ("fresh", "aging", "stale")), ("memory_type", ("semantic", "procedural", "episodic"))):
        if filters.get(key) and not set(map(str, listed(filters[key]))) <= set(allowed):
            raise ValueError(f"{key} must be among {json.dumps(allowed)}")
    dates = filters.get("date_range") or {}
    if not isinstance(dates, dict):
        raise ValueError("date_range must be an object")
    for name, value in [*((f"date_range.{k}", dates.get(k)) for k in ("from", "to")), ("as_of", filters.get("as_of"))]:
        if value is not None:
            try:
                utc(value)
            except (ValueError, OverflowError) as e:
                raise ValueError(f"{name} must be an ISO 8601 date") from e
    return filters
