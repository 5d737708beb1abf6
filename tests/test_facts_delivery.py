"""Declared facts and delivery judgement on golden cases."""

import json

import pytest
from pyspark.sql import functions as F

from tellback import dims
from tellback.operators import delivery as D
from tellback.operators import facts as X


def truth_of(spark, content="", blocks=(), **cuts):
    df = spark.createDataFrame([(1, content, list(blocks))], "page_id long, content string, jsonld_blocks array<string>")
    return {r["field"]: (r["values"], r["source"], r["sources"]) for r in X.ground_truth(df, **cuts).collect()}


def test_founder_as_string(spark):
    got = truth_of(spark, blocks=[json.dumps({"@type": "Organization", "name": "TestCo", "founder": "김철수"})])
    assert got["ceo_or_leader"][0] == ["김철수"]


def test_extended_labels(spark):
    got = truth_of(spark, "회사명: TestCo\n대표이사: 홍길동\n주소: 서울특별시 강남구\n사업 분야: IT 서비스\n주요 서비스: 웹개발, 앱개발")
    assert got["entity_name"][0] == ["TestCo"]
    assert got["ceo_or_leader"][0] == ["홍길동"]
    assert got["headquarters"][0] == ["서울특별시 강남구"]
    assert got["entity_type"][0] == ["IT 서비스"]
    assert got["key_products"][0] == ["웹개발", "앱개발"]


INLINE = (
    "공식 사실 요약 서비스명: Nimbus (Weather Answers) 설명: Nimbus는 기상 자료를 분석해 주는 서비스입니다. 업종: 기상 분석 / 예보 SaaS "
    "설립연도: 2026 대표이사: 김하늘 (Sky Kim) 주요 서비스: 기상 진단, 예보 리포트, 자료 페이지 제작"
)


def test_inline_block(spark):
    got = truth_of(spark, INLINE)
    assert got["entity_name"][0] == ["Nimbus (Weather Answers)"]
    assert got["entity_type"][0] == ["기상 분석 / 예보 SaaS"]
    assert got["founded"][0] == ["2026"]
    assert got["ceo_or_leader"][0] == ["김하늘 (Sky Kim)"]
    assert "기상 진단" in got["key_products"][0]


def test_inline_block_followed_by_prose(spark):
    got = truth_of(spark, INLINE + " 핵심 관찰 " + "긴 본문이 이어져도 값이 늘어나지 않아야 한다 " * 6, limits=dims.MAX_VALUE_LENGTH, item_chars=80, items=8)
    assert got["description"][0] == ["Nimbus는 기상 자료를 분석해 주는 서비스입니다."]
    assert all(len(i) < 60 for i in got["key_products"][0])


def test_long_values_are_kept(spark):
    products = [f"product number {k} " + "with a long name " * 6 for k in range(12)]
    text = "Lorem ipsum. " * 3000 + "\nName: A\nFounded: 1999\nDescription: " + "very long " * 500 + "\nProducts: " + ", ".join(products)
    got = truth_of(spark, text)
    assert got["key_products"][0] == [p.strip() for p in products] and len(got["description"][0][0]) > 4000
    inline = "Facts summary Name: A Founded: 1999 " + "prose without any label " * 200 + "Headquarters: Busan"
    assert truth_of(spark, inline)["headquarters"][0] == ["Busan"]


def test_alternate_names(spark):
    block = json.dumps({"@type": "Organization", "name": "N", "alternateName": ["Nimbus Weather", "님버스"]})
    df = spark.createDataFrame([(1, [block])], "page_id long, jsonld_blocks array<string>")
    assert X.alternate_names(df).first()["alternate_names"] == ["Nimbus Weather", "님버스"]


def test_web_page_name_is_no_fact(spark):
    block = json.dumps({"@type": "WebPage", "name": "Company | About | Brand", "description": "intro"})
    assert truth_of(spark, blocks=[block]) == {}


def test_block_far_down_the_page(spark):
    got = truth_of(spark, "Lorem ipsum " * 200 + "\n\n회사명: DeepCo\n설립일: 2023\n본사: 부산\n업종: 딥러닝")
    assert (got["entity_name"][0], got["founded"][0], got["headquarters"][0]) == (["DeepCo"], ["2023"], ["부산"])


def test_runs_and_last_value(spark):
    content = "Type: stray\nno colon here\nName: A\nColour: red\nFounded: 1999\nName: B\nend\nRevenue: 5"
    df = spark.createDataFrame([(1, content)], "page_id long, content string")
    got = {r["field"]: r["values"] for r in X.explode_entries(df, X.block_from_lines(F.col("content"))).collect()}
    assert got == {"entity_name": ["B"], "founded": ["1999"]}


def test_jsonld_confirms_a_block_value(spark):
    block = json.dumps({"@graph": [{"@type": "Organization", "name": "Other", "foundingDate": "2001"}]})
    got = truth_of(spark, "Name: A\nFounded: 1999", [block, "{broken"])
    assert got["founded"] == (["1999"], "official_facts_block", ["official_facts_block", "jsonld"])


def judge(spark, fields, text, alternates=()):
    rows = [(1, f, v if isinstance(v, list) else [v], "official_facts_block", ["official_facts_block"]) for f, v in fields]
    truth = spark.createDataFrame(rows, "page_id long, field string, values array<string>, source string, sources array<string>")
    said = spark.createDataFrame([(1, "e", text)], "page_id long, engine string, text string")
    names = spark.createDataFrame([(1, list(alternates))], "page_id long, alternate_names array<string>")
    out = D.delivery_eval_text(said, truth, ["page_id", "engine"], names).collect()
    return {r["field"] for r in out if r["delivered"]}, {r["field"] for r in out if not r["delivered"]}


CASES = {
    "full": (
        [("entity_name", "Nimbus"), ("entity_type", "기상 분석 서비스"), ("founded", "2024"), ("headquarters", "서울"), ("ceo_or_leader", "김하늘")],
        "Nimbus는 기상 분석 서비스를 제공하는 회사로, 2024년에 설립되었습니다. 본사는 서울에 위치하며 대표자는 김하늘입니다.",
        (),
        {"entity_name", "entity_type", "founded", "headquarters", "ceo_or_leader"},
    ),
    "one array item is enough": ([("key_products", ["기상 지도", "진단 엔진", "모니터링"])], "주요 서비스에는 기상 지도 생성 기능이 있다.", (), {"key_products"}),
    "year suffix": ([("founded", "2024")], "이 회사는 2024년에 설립되었습니다.", (), {"founded"}),
    "alternate name": ([("entity_name", "김하늘")], "The founder, Sky Kim, started it.", ("Sky Kim",), {"entity_name"}),
    "not found lines": (
        [("entity_name", "Conductor"), ("headquarters", "New York")],
        "**entity name:** 찾지 못함\n**headquarters:** 찾지 못함\n\nconductor.com could not be read.",
        (),
        set(),
    ),
    "not found is per line": (
        [("entity_name", "Semley"), ("headquarters", "Boston"), ("description", "Data Driven Marketing Tools for Growth")],
        "* **entity name**: Semley\n* **headquarters**: 찾지 못함\n* **description**: Data Driven Marketing Tools for Growth",
        (),
        {"entity_name", "description"},
    ),
    "deflection": (
        [("entity_name", "Nimbus (Weather Answers)"), ("entity_type", "기상 SaaS"), ("founded", "2026"), ("headquarters", "대한민국")],
        "해당 웹사이트에 대한 구체적인 정보를 찾기 어렵습니다. 직접 방문하여 확인해 보시기 바랍니다.",
        (),
        set(),
    ),
    "name only": (
        [("entity_name", "Nimbus"), ("entity_type", "기상 예보 SaaS"), ("founded", "2026")],
        "Nimbus는 관련 서비스를 제공하는 것으로 보입니다. 정확한 시기나 유형은 확인되지 않습니다.",
        (),
        {"entity_name"},
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_delivery(spark, name):
    fields, text, alternates, wanted = CASES[name]
    hit, missed = judge(spark, fields, text, alternates)
    assert hit == wanted
    assert missed == {f for f, _ in fields} - wanted


def test_faq_share(spark):
    pairs = spark.createDataFrame(
        [(1, 1, "q1", "Nimbus는 Weather Answer 서비스로, 예보의 정확도를 높이는 플랫폼입니다."), (1, 2, "q2", "네, 14일 무료 체험을 제공합니다.")],
        "page_id long, pair_no long, question string, answer string",
    )
    said = spark.createDataFrame(
        [(1, "e", "Nimbus는 Weather Answer 서비스로 예보의 정확도를 높이는 플랫폼입니다. 유료만 있습니다.")],
        "page_id long, engine string, text string",
    )
    got = {r["question"]: r["delivered"] for r in D.faq_delivery(said, pairs, ["page_id", "engine"]).collect()}
    assert got == {"q1": True, "q2": False}


def test_missed_causes_in_order(spark):
    rows = [
        (["jsonld"], True, None, None, None, None, "robots_blocked", "high"),
        (["jsonld"], None, None, True, None, None, "js_rendering_only", "medium"),
        (["jsonld"], None, None, None, True, None, "content_sparse", "medium"),
        (["jsonld"], None, None, None, None, None, "jsonld_only", "low"),
        (["jsonld"], None, None, None, None, True, "dual_source_missed", "low"),
        (["official_facts_block"], None, None, None, None, None, "facts_block_only", "low"),
        ([], None, None, None, None, None, "unknown", "low"),
    ]
    schema = (
        "sources array<string>, robots_blocked boolean, no_static_html boolean, js_rendered boolean, low_words boolean, "
        "has_facts_block boolean, want string, sure string"
    )
    for r in D.missed_cause(spark.createDataFrame(rows, schema)).collect():
        assert (r["signal"], r["confidence"]) == (r["want"], r["sure"])


def test_citation_level_is_the_best_of_all(spark):
    rows = [
        ("https://www.a.example/x/", ["https://a.example/x"], "exact"),
        ("https://a.example/x", ["https://a.example/y", "https://a.example/x/z"], "path"),
        ("https://a.example/x", ["https://a.example/y"], "host_only"),
        ("https://a.example/x", ["https://b.example/x", "junk"], "none"),
        ("https://a.example/", ["https://a.example/any"], "path"),
        ("https://a.example/", [], "none"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, url string, citations array<string>, want string")
    for r in D.citation_match_level(df, ["k", "want"]).collect():
        assert r["citation_level"] == r["want"], r
