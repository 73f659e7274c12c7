from pyspark.sql import functions as F

from weftline.functions import scalar as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def test_normalisation(spark):
    assert one(spark, S.normalize_text(F.lit("强化学习，PyTorch（测试）"))) == "强化学习 pytorch 测试"
    assert one(spark, S.normalize_text(lit(None))) == ""
    assert one(spark, S.normalize_text(F.lit("C++ / C#"))) == "c c"


def test_levels(spark):
    cases = {"3年以下": "junior", "3-5年": "mid", "5年以上": "senior", "不限": "mid", None: "mid", "5-10年": "senior", "99999999999999999999999年": "mid"}
    for text, level in cases.items():
        assert one(spark, S.level(lit(text))) == level, text


def test_skill_types(spark):
    for term, kind in {"PyTorch": "tool", "Docker": "tool", "沟通能力": "soft", "数据治理": "domain", "强化学习": "hard"}.items():
        assert one(spark, S.skill_type(F.lit(term))) == kind


def test_lists(spark):
    for text, items in {'["a", "b"]': ["a", "b"], "a, b，c": ["a", "b", "c"], "[broken": ["[broken"], "": [], None: []}.items():
        assert one(spark, S.list_field(lit(text))) == items


def test_status(spark):
    rule = lambda s, c, e: one(spark, S.status(F.lit(s), F.lit(c), F.lit(e)))
    assert rule("dictionary", 0.95, True) == "approved"
    assert rule("llm", 0.95, True) == rule("dictionary", 0.85, True) == rule("dictionary", 0.95, False) == "pending"


def test_severity(spark):
    for missing, total, kind in ((0, 5, "minor"), (2, 5, "moderate"), (3, 5, "severe"), (1, 0, "minor")):
        assert one(spark, S.severity(F.lit(missing), F.lit(total))) == kind


def test_salary(spark):
    cases = {"20-30k": (20000, 30000), "15-20K·13薪": (15000, 20000), "30K": (30000, 30000), "20k-30k": (20000, 20000), "1.5-2万": (None, None), None: (None, None)}
    for text, want in cases.items():
        assert tuple(one(spark, S.salary(lit(text)))) == want, text


def test_keys_and_masks(spark):
    assert one(spark, S.dedup_key(F.lit("A b\t"), F.lit("C\n"), lit(None))) == "ab|c|"
    assert one(spark, S.mask_key(F.lit("sk-1234567890abcdef"))) == "sk-***ef"
    assert one(spark, S.mask_key(F.lit("short"))) == "sh***"


def test_json(spark):
    for text in ('{"a": 1}', '```json\n{"a": 1}\n```', 'see {"a": 1} there'):
        assert one(spark, S.extracted_json(F.lit(text))) == '{"a": 1}'
    assert one(spark, S.extracted_json(F.lit("nothing"))) is None


def test_dates_and_lookups(spark):
    import datetime

    assert one(spark, S.event_date(F.lit("2025-06-01T10:00"))) == datetime.date(2025, 6, 1)
    assert one(spark, S.event_date(F.lit("20250601"))) == datetime.date(2025, 6, 1)
    assert one(spark, S.event_date(F.lit("2025/06/01"))) is None
    assert one(spark, S.lookup(lit(None), S.EVENT_WEIGHTS, 0.4, "其他")) == 0.35
    assert one(spark, S.lookup(F.lit("x"), S.EVENT_WEIGHTS, 0.4, "其他")) == 0.4
    assert one(spark, S.category(F.lit("BD"))) == "bigdata" and one(spark, S.category(F.lit("T3"))) == "embodied"


def test_small_ones(spark):
    assert one(spark, S.split_terms(F.lit("感知与控制/规划"))) == ["感知", "控制", "规划"]
    assert one(spark, S.fill(F.lit("学{技术}"), F.lit("SLAM"))) == "学SLAM"
    assert one(spark, S.root_code(F.lit("T1.02.03"))) == "T1.02"
    assert one(spark, S.short_title(F.lit("张三\n工程师"))) == "张三"
    assert one(spark, S.demand(F.lit(10.0), F.lit(0.0))) == 60
    assert one(spark, S.heat(F.lit(5), F.lit(10))) == 0.12 + 0.88 * 0.5
