"""Verdicts, accuracy and source profiles on golden cases."""

import pytest

from tellback.operators import citations as C
from tellback.operators import recognition as R

ENTITY = dict(
    company_name="NWA",
    domain="nwa.co.kr",
    title="NWA | Nimbus Weather Answers",
    description="NWA is a Nimbus Weather Answers platform that helps brands build weather profile pages, improve citations, and monitor forecast visibility.",
    aliases=["NWA", "Nimbus Weather Answers"],
)
ENTITY_SCHEMA = (
    "entity_id long, company_name string, domain string, title string, description string, aliases array<string>, "
    "snap_title string, snap_description string, h1_texts array<string>, h2_texts array<string>, content_preview string, jsonld_blocks array<string>"
)


def entity(spark, e):
    row = (1, e["company_name"], e["domain"], e["title"], e["description"], e["aliases"], "", "", [], [], "", [])
    return C.source_archetype(R.verification_hints(R.entity_hints(spark.createDataFrame([row], ENTITY_SCHEMA))))


def judge(spark, text, citations, mode="live_search", intent="awareness"):
    row = (1, mode, intent, text, citations)
    df = spark.createDataFrame([row], "entity_id long, mode string, intent string, text string, citations array<string>")
    joined = df.join(entity(spark, ENTITY), "entity_id")
    return R.judge(C.citation_metrics(C.citation_details(joined))).first()


VERDICTS = {
    "aligned": (
        "NWA는 nwa.co.kr에서 운영되는 Nimbus Weather Answers 플랫폼입니다. 브랜드가 weather profile page를 만들고 citation visibility를 모니터링하도록 돕습니다.",
        ["https://nwa.co.kr/profile"],
        "live_search",
        "awareness",
        "recognized",
        "aligned",
    ),
    "wrong entity": (
        "NWA는 보통 nanowire array를 뜻하는 재료공학 용어로 설명됩니다. 이 물질은 산업 연구와 semiconductor coating 문맥에서 자주 언급되며, materialsproject.org 같은 자료가 pore structure와 oxide layer 특성을 설명합니다.",
        ["https://materialsproject.org/docs"],
        "live_search",
        "awareness",
        "misidentified",
        "wrong_entity",
    ),
    "domain mismatch": (
        "Nimbus Weather Answers 브랜드인 NWA는 브랜드의 citation을 관리하는 service 플랫폼이라고 소개됩니다. 하지만 실제 pricing, customer onboarding, demo 신청, 사례 자료는 모두 partnerhub.io에서 안내되고 있으며 공식 소개도 그 도메인으로 연결됩니다.",
        ["https://partnerhub.io/pricing"],
        "live_search",
        "awareness",
        "misidentified",
        "domain_mismatch",
    ),
    "service mismatch": (
        "NWA(nwa.co.kr)는 대학 입학 행정과 학생 기록을 관리하는 admissions office입니다. 이 조직은 campus administration, 지원서 접수, 서류 검토, 학생 service desk 운영을 담당한다고 설명됩니다.",
        ["https://nwa.co.kr"],
        "live_search",
        "awareness",
        "misidentified",
        "service_mismatch",
    ),
    "comparison": (
        "NWA(nwa.co.kr)는 Nimbus Weather Answers에 집중하고, 다른 도구와 비교하면 weather profile page와 citation monitoring에 더 초점을 둡니다. 비교 자료로 rivalspot.com이 자주 언급되지만, 공식 엔티티는 NWA입니다.",
        ["https://nwa.co.kr/profile", "https://www.rivalspot.com"],
        "live_search",
        "comparison",
        "recognized",
        "aligned",
    ),
    "weak": (
        "현재 기억만으로는 NWA에 대한 신뢰할 만한 구체 정보를 확인하기 어렵습니다. 추측하지 않고 모른다고 답하겠습니다.",
        [],
        "strict_recall",
        "awareness",
        "unknown",
        "weak",
    ),
}


@pytest.mark.parametrize("name", VERDICTS)
def test_verdicts(spark, name):
    text, cites, mode, intent, status, verdict = VERDICTS[name]
    got = judge(spark, text, cites, mode, intent)
    assert (got["match_status"], got["verdict"]) == (status, verdict)
    if status == "recognized":
        assert got["accuracy"] >= 30
    if status == "misidentified":
        assert got["accuracy"] == 0
    if status == "unknown":
        assert got["accuracy"] <= 10


PROFILES = {
    "software strong": (
        dict(company_name="NWA", domain="nwa.co.kr", title="NWA | Nimbus Weather Answers", description="Weather software platform for brands and SaaS teams", aliases=[]),
        ["https://nwa.co.kr/profile", "https://www.g2.com/products/nwa", "https://techcrunch.com/2026/01/10/nwa", "https://docs.vendor.io/nwa"],
        ("software_service", "strong", "mixed", None),
    ),
    "local strong": (
        dict(company_name="River Yoga Studio", domain="riveryoga.kr", title="River Yoga Studio", description="요가 필라테스 스튜디오", aliases=[]),
        ["https://riveryoga.kr", "https://www.yelp.com/biz/r", "https://www.tripadvisor.com/r", "https://www.instagram.com/r"],
        ("local_business", "strong", None, "directory"),
    ),
    "creator strong": (
        dict(company_name="June Creator", domain="junecreator.kr", title="June Creator", description="뷰티 유튜버이자 인스타그램 인플루언서", aliases=[]),
        ["https://junecreator.kr", "https://www.instagram.com/j", "https://www.youtube.com/@j", "https://www.threads.net/@j"],
        ("creator_media", "strong", None, "social"),
    ),
    "developer strong": (
        dict(company_name="RiverFlow SDK", domain="riverflow.io", title="RiverFlow SDK", description="Developer API SDK and CLI for workflow automation", aliases=[]),
        ["https://riverflow.io", "https://docs.readthedocs.io/en/x.html", "https://github.com/r/sdk", "https://stackoverflow.com/q"],
        ("developer_tool", "strong", None, None),
    ),
    "official gap": (
        dict(company_name="Opsly Cloud", domain="opslycloud.com", title="Opsly Cloud", description="software platform for enterprise monitoring", aliases=[]),
        ["https://www.g2.com/p", "https://www.capterra.com/p", "https://www.reuters.com/m"],
        ("software_service", "official_gap", "third_party_only", None),
    ),
    "off pattern": (
        dict(company_name="Beacon AI", domain="beacon.ai", title="Beacon AI", description="AI platform for operations automation", aliases=[]),
        ["https://www.instagram.com/b", "https://www.tiktok.com/@b", "https://medium.com/@b/x"],
        ("software_service", "off_pattern", "third_party_only", None),
    ),
}


@pytest.mark.parametrize("name", PROFILES)
def test_source_profiles(spark, name):
    e, cites, (archetype, fit, mix, dominant) = PROFILES[name]
    df = spark.createDataFrame([(1, cites)], "entity_id long, citations array<string>").join(entity(spark, e), "entity_id")
    got = C.source_profile(C.citation_metrics(C.citation_details(df))).first()
    assert (got["archetype"], got["fit_status"]) == (archetype, fit)
    assert mix is None or got["source_mix"] == mix
    assert dominant is None or got["dominant_type"] == dominant
