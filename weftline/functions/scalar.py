"""Scalar functions as column expressions: all stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that tell a skill's type, looked for in this order.
TOOL_HINTS = ("docker", "kubernetes", "k8s", "git", "linux", "mysql", "redis", "kafka", "hadoop", "spark", "flink", "tableau", "opencv", "cuda", "onnx", "vllm", "langchain", "tensorflow", "pytorch", "paddle", "mindspore", "scikit")
SOFT_HINTS = ("沟通", "管理", "协作", "规划", "培训")
DOMAIN_HINTS = ("治理", "合规", "安全", "画像", "分析", "建模", "标准", "场景", "孪生")
# Categories of the four general domains; every other domain is embodied.
CATEGORY = {"AI": "ai", "BD": "bigdata", "IOT": "iot", "IS": "smart"}
# Weights of event types; a missing type is 其他, an unknown one weighs 0.40.
EVENT_WEIGHTS = {"技术演示": 0.45, "论文发表": 0.55, "技术突破": 0.68, "开源发布": 0.76, "产品发布": 0.84, "平台/工具发布": 0.88, "企业事件": 0.92, "标准/政策": 0.72, "其他": 0.35}
AUTO_APPROVE = 0.90
# Full-width punctuation and what stands for it, characters that join words, characters that go.
WIDE, NARROW = "，。！？；：“”‘’（）【】、", ",.!?;:\"\"''()[] "
JOINTS, OTHERS = r"(?U)[\s\-/\\|]+", r"(?U)[^一-龥a-zA-Z0-9_\s]"
# Patterns of a monthly pay range and of a single amount, in lower case.
PAY_RANGE, PAY = r"(\d+(?:\.\d+)?)\s*[-~]\s*(\d+(?:\.\d+)?)\s*[k千]", r"(\d+(?:\.\d+)?)\s*[k千]"


def _or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def clean(x: Column) -> Column:
    """White space collapsed and trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(_or_empty(x), r"(?U)\s+", " "))


def normalize_text(x: Column) -> Column:
    """Lower-case text of CJK letters, ASCII letters and digits, ``_`` and single spaces."""
    t = F.translate(_or_empty(x), WIDE, NARROW)
    t = F.regexp_replace(t, JOINTS, " ")
    t = F.regexp_replace(t, OTHERS, " ")
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def squeeze(x: Column) -> Column:
    """Only ASCII letters and digits and CJK letters, in lower case."""
    return F.lower(F.regexp_replace(_or_empty(x), r"[^A-Za-z0-9一-鿿]+", ""))


def dedup_key(*parts: Column) -> Column:
    """The parts without any white space, in lower case, joined by ``|``."""
    return F.concat_ws("|", *(F.lower(F.regexp_replace(_or_empty(p), r"(?U)\s+", "")) for p in parts))


def salary(x: Column) -> Column:
    """struct(low, high) in units: ``a-bK``, ``a~bK`` or ``aK`` (also 千); anything else is null."""
    t = F.lower(F.trim(_or_empty(x)))
    pair, one = PAY_RANGE, PAY

    def units(group: Column) -> Column:
        return F.floor(group.cast("double") * 1000).cast("long")

    is_pair, is_one = t.rlike(pair), t.rlike(one)
    low = F.when(is_pair, units(F.regexp_extract(t, pair, 1))).when(is_one, units(F.regexp_extract(t, one, 1)))
    high = F.when(is_pair, units(F.regexp_extract(t, pair, 2))).when(is_one, units(F.regexp_extract(t, one, 1)))
    return F.struct(low.alias("low"), high.alias("high"))


def level(x: Column) -> Column:
    """junior, mid or senior from a text about experience."""
    t = _or_empty(x)
    years = F.try_to_number(F.nullif(F.regexp_extract(t, r"(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long")
    by_years = F.when(years.isNull(), "mid").when(years < 3, "junior").when(years < 5, "mid").otherwise("senior")
    return F.when(t.contains("以上"), "senior").when(t.contains("以下") | t.contains("以内"), "junior").otherwise(by_years)


def skill_type(x: Column, tool: Sequence[str] = TOOL_HINTS, soft: Sequence[str] = SOFT_HINTS, domain: Sequence[str] = DOMAIN_HINTS) -> Column:
    low = F.lower(_or_empty(x))

    def any_of(hints: Sequence[str]) -> Column:
        return low.rlike("|".join(rf"\Q{h}\E" for h in hints))

    return F.when(any_of(tool), "tool").when(any_of(soft), "soft").when(any_of(domain), "domain").otherwise("hard")


def list_field(x: Column) -> Column:
    """The members of a JSON array, or of a text split at commas; trimmed, without empty ones."""
    t = F.trim(_or_empty(x))
    parsed = F.when(t.startswith("["), F.from_json(t, "array<string>", {"mode": "PERMISSIVE"}))
    members = F.coalesce(parsed, F.split(t, "[,，]"))
    return F.filter(F.transform(members, lambda m: F.trim(m)), lambda m: m.isNotNull() & (m != ""))


def status(source: Column, confidence: Column, has_evidence: Column) -> Column:
    good = (source == "dictionary") & (confidence >= AUTO_APPROVE) & F.coalesce(has_evidence, F.lit(False))
    return F.when(good, "approved").otherwise("pending")


def severity(missing: Column, total: Column) -> Column:
    share = missing / total
    return F.when(total <= 0, "minor").when(share >= 0.6, "severe").when(share >= 0.3, "moderate").otherwise("minor")


def snippet(text: Column, keywords: Sequence[str], size: int = 170) -> Column:
    """``size`` characters from 40 before the first keyword on, with a mark where text follows."""
    t = F.regexp_replace(_or_empty(text), r"(?U)\s+", " ")
    low = F.lower(t)
    places = [F.when(F.instr(low, F.lit(k.lower())) > 0, F.instr(low, F.lit(k.lower())) - 1) for k in keywords]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(0))
    start = F.greatest(F.lit(0), first - 40)
    end = start + size
    cut = F.substring(t, start + 1, F.lit(size))
    return F.concat(cut, F.when(end < F.length(t), "…").otherwise(""))


def mask_key(x: Column) -> Column:
    t = _or_empty(x)
    return F.when(t == "", "").when(F.length(t) <= 8, F.concat(F.substring(t, 1, 2), F.lit("***"))).otherwise(F.concat(F.substring(t, 1, 3), F.lit("***"), F.right(t, F.lit(2))))


def event_date(x: Column) -> Column:
    """The date at the head of a text (yyyy-MM-dd or yyyyMMdd), or null."""
    head = F.substring(_or_empty(x), 1, 10)
    return F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(F.substring(head, 1, 8), "yyyyMMdd"))


def lookup(x: Column, values: Mapping[str, float], default: float, missing: str | None = None) -> Column:
    table = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    key = x if missing is None else F.coalesce(F.nullif(x, F.lit("")), F.lit(missing))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def category(l1: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in CATEGORY.items() for v in kv])
    return F.coalesce(F.try_element_at(table, l1), F.lit("embodied"))


def demand(amount: Column, most: Column) -> Column:
    """0 to 99 from an amount and the largest one; 60 where there is none."""
    return F.when(F.coalesce(most, F.lit(0.0)) <= 0, 60).otherwise(F.least(F.lit(99), F.floor(50 + 49 * F.coalesce(amount, F.lit(0.0)) / most).cast("int")))


def heat(count: Column, most: Column) -> Column:
    return F.when((count <= 0) | (most <= 0), 0.0).otherwise(0.12 + 0.88 * count / most)


def root_code(code: Column) -> Column:
    return F.regexp_replace(code, r"\.[^.]*$", "")


def split_terms(name: Column) -> Column:
    """Parts of a name joined by 与, 及, 和, 、 or /."""
    return F.filter(F.transform(F.split(_or_empty(name), "[与及和、/]"), lambda p: F.trim(p)), lambda p: p != "")


def fill(template: Column, name: Column) -> Column:
    return F.replace(template, F.lit("{技术}"), name)


def extracted_json(x: Column) -> Column:
    """The JSON object in a text: without code fences, or the outermost braces; null if it does not parse."""
    bare = F.trim(F.regexp_replace(_or_empty(x), r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    outer = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    kind = "map<string,string>"
    return F.coalesce(F.when(bare.startswith("{") & F.from_json(bare, kind).isNotNull(), bare), F.when(F.from_json(outer, kind).isNotNull() & (outer != ""), outer))


def short_title(x: Column) -> Column:
    """The first line, if it has 1 to 12 characters."""
    first = F.trim(F.substring_index(_or_empty(x), "\n", 1))
    return F.when(F.length(first).between(1, 12), first)


def note(added: Column, removed: Column, modified: Column) -> Column:
    """What changed: how many of each kind, and the first five added and removed, with 等 where there are more."""

    def part(title: str, items: Column) -> Column:
        more = F.when(F.size(items) > 5, "等").otherwise("")
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{title} "), F.size(items), F.lit(" 项（"), F.array_join(F.slice(items, 1, 5), "、"), more, F.lit("）")))

    changed = F.when(F.size(modified) > 0, F.concat(F.lit("置信度/证据更新 "), F.size(modified), F.lit(" 项")))
    whole = F.concat_ws("；", part("新增能力", added), part("移除能力", removed), changed)
    return F.when(whole == "", "能力结构无变化").otherwise(whole)


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of a double in fewer steps: Spark's own, by way of decimal text, is asked only near halves and far from 0."""
    y = x * 10.0**digits
    plain = (F.abs(y) < 1e9) & (F.abs(y - F.floor(y) - 0.5) > 1e-5)
    return F.when(plain, F.floor(y + 0.5) / 10.0**digits).otherwise(F.round(x, digits))
