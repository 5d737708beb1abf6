"""Fixed values that results depend on: word lists, lookup tables, weights.

Small, constant-size tables only; each is far below any broadcast limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellback.functions.text import literal_map, quoted

# Usual sub-page paths of a company site.
USUAL_PATHS = [
    "/about",
    "/about-us",
    "/company",
    "/who-we-are",
    "/contact",
    "/product",
    "/products",
    "/service",
    "/services",
    "/company-info",
    "/회사소개",
    "/서비스",
    "/제품",
    "/contact-us",
]
HOME_CANDIDATES = ["/ai-profile"]

# Paths never followed.
EXCLUDED_PATHS = ["/diagnose", "/insights", "/llms.txt", "/robots.txt", "/sitemap.xml"]
EXCLUDED_PREFIXES = ["/products/", "/insights/", "/experiments/"]

# A path is useful when it holds one of these.
USEFUL_PATH_WORDS = [
    "about",
    "company",
    "service",
    "product",
    "contact",
    "who-we-are",
    "회사",
    "소개",
    "서비스",
    "제품",
    "문의",
]

# Hosts that are never public.
BLOCKED_HOSTS = ["localhost", "ip6-localhost", "metadata.google.internal"]
BLOCKED_HOST_SUFFIXES = [".localhost", ".local", ".internal", ".home.arpa"]

# Crawlers whose access is reported.
AI_BOTS = ["GPTBot", "OAI-SearchBot", "ChatGPT-User", "PerplexityBot", "ClaudeBot", "Google-Extended"]

# Fact fields, in report order.
FIELDS = [
    "entity_name",
    "entity_type",
    "founded",
    "headquarters",
    "key_products",
    "ceo_or_leader",
    "employee_count",
    "revenue",
    "parent_company",
    "description",
    "competitors",
    "unique_value",
]
ARRAY_FIELDS = ["key_products", "competitors"]

# Labels a facts block may use for a field.
FIELD_LABELS = {
    "entity_name": ["회사명", "서비스명", "브랜드명", "name", "상호"],
    "entity_type": ["업종", "산업", "분류", "type", "industry", "사업 분야", "업태"],
    "founded": ["설립", "창립", "founded", "설립일", "창립일", "설립연도"],
    "headquarters": ["본사", "위치", "headquarters", "location", "주소", "소재지"],
    "ceo_or_leader": ["대표", "대표자", "ceo", "founder", "대표이사", "대표자명"],
    "employee_count": ["직원 수", "임직원", "employees", "인원"],
    "revenue": ["매출", "revenue", "매출액"],
    "parent_company": ["모회사", "parent", "소속"],
    "key_products": [
        "서비스",
        "제품",
        "key products",
        "key services",
        "products",
        "services",
        "주요 서비스",
        "주요 제품",
        "사업 영역",
    ],
    "description": ["한 줄 소개", "설명", "description", "소개"],
}

# Headings that announce a facts section.
FACT_ANCHORS = ["공식 사실 요약", "핵심 사실 요약", "기본 정보", "company overview", "official facts", "key facts"]

# Longest scalar value accepted per field.
MAX_VALUE_LENGTH = {
    "entity_name": 120,
    "entity_type": 120,
    "founded": 40,
    "headquarters": 120,
    "ceo_or_leader": 120,
    "employee_count": 80,
    "revenue": 120,
    "parent_company": 120,
    "description": 420,
}

# Labels of the short official-page variant.
OFFICIAL_LABELS = {
    "entity_name": ["회사명", "서비스명", "브랜드명", "name"],
    "entity_type": ["업종", "산업", "분류", "type", "industry"],
    "founded": ["설립", "창립", "founded"],
    "headquarters": ["본사", "위치", "headquarters", "location"],
    "ceo_or_leader": ["대표", "대표자", "ceo", "founder"],
    "employee_count": ["직원 수", "임직원", "employees"],
    "revenue": ["매출", "revenue"],
    "parent_company": ["모회사", "parent"],
    "key_products": ["서비스", "제품", "products", "services"],
    "description": ["한 줄 소개", "설명", "description"],
}

# JSON-LD types that may declare an entity's facts.
ENTITY_JSONLD_TYPES = [
    "Organization",
    "Corporation",
    "LocalBusiness",
    "ProfessionalService",
    "Service",
    "SoftwareApplication",
    "Product",
    "Person",
    "ProfilePage",
]

# JSON-LD keys counted as facts.
JSONLD_FACT_KEYS = [
    "name",
    "alternateName",
    "foundingDate",
    "founder",
    "description",
    "email",
    "telephone",
    "address",
    "serviceType",
    "knowsAbout",
    "sameAs",
]

# Infobox keys that answer a field, best first.
INFOBOX_KEYS = {
    "entity_type": ["산업 분야", "서비스", "업종", "형태", "Industry", "Services", "Type"],
    "founded": ["창립", "설립", "설립일", "Founded"],
    "headquarters": ["본사 소재지", "본사", "본부", "Headquarters"],
    "key_products": ["제품", "서비스", "Products", "Services"],
    "ceo_or_leader": ["핵심 인물", "대표", "대표이사", "CEO", "Key people"],
    "employee_count": ["직원 수", "종업원 수", "사원수", "Employees"],
    "revenue": ["매출액", "Revenue"],
    "parent_company": ["모회사", "Parent", "Parent company"],
}

# Names a response may use for a field when it says it found nothing.
FIELD_MENTIONS = {
    "entity_name": ["entity name", "company name", "회사명"],
    "entity_type": ["entity type", "industry", "업종", "산업"],
    "founded": ["founded", "founding date", "설립", "설립연도"],
    "headquarters": ["headquarters", "address", "본사", "주소"],
    "key_products": ["key products", "products", "services", "주요 제품", "주요 서비스"],
    "description": ["description", "summary", "설명", "소개"],
    "ceo_or_leader": ["ceo", "leader", "founder", "대표", "대표자", "대표이사"],
}


def alias_rows(labels: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(alias, field) pairs; a later field takes an alias listed twice."""
    table: dict[str, str] = {}
    for field, aliases in (labels or FIELD_LABELS).items():
        for alias in aliases:
            table[alias.lower()] = field
    return list(table.items())


def alias_map(labels: dict[str, list[str]] | None = None):
    """alias -> field as a literal map expression."""
    return literal_map(alias_rows(labels))


def small_table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A constant table, marked for broadcast; its size is fixed by this file."""
    structs = [
        "named_struct(" + ", ".join(f"{quoted(n)}, {quoted(v)}" for n, v in zip(names, row)) + ")" for row in rows
    ]
    return F.broadcast(spark.range(1).selectExpr("inline(array(" + ", ".join(structs) + "))"))

# Words that carry no service meaning.
STOP_WORDS = [
    "and", "the", "of", "for", "a", "an", "in", "is", "to", "that", "this", "with", "it", "its", "are", "was", "be",
    "at", "by", "from", "as", "or", "but", "co", "inc", "ltd", "이", "가", "을", "를", "의", "에", "와", "과", "한", "하는",
    "있는", "하여", "위한",
]

# Business words too general to define a service.
GENERIC_TERMS = [
    "company", "official", "website", "business", "brand", "platform", "service", "services", "solution", "solutions",
    "기업", "회사", "공식", "브랜드", "서비스", "솔루션", "플랫폼",
]

# Phrases by which an answer says it does not know the entity.
UNKNOWN_SIGNALS = [
    "정보를 찾기 어렵", "알려진 정보가 없", "확인할 수 없", "잘 모르겠",
    "구체적인 정보", "정보가 부족", "찾을 수 없", "i don't have",
    "i'm not sure", "not familiar", "no information", "couldn't find",
    "unable to find", "i don't have specific", "알 수 없", "파악되지",
    "cannot find information", "i cannot find", "can't find information",
    "cannot identify", "could not identify", "not enough information",
    "does not appear to refer to", "not clearly refer to",
    "specific company cannot be identified", "정확한 엔티티", "특정하기 어렵",
    "특정할 수 있는 회사를 찾", "직접 내용을 불러오지 못", "확실하게 말할 수 있는 것은",
    "정보는 갖고 있지 않", "세부 정보가 없", "찾기 어렵", "설명해 드리기 어렵",
    "고유한 이름이라기보다는", "개념이나 설명처럼 보", "특정 기업이나 제품", "정확한 명칭의 특정",
    "정확히 식별할 수 없다", "정확히 식별하기 어렵", "공식 정보가 없다", "공식 웹사이트를 참고",
    "해당 회사가 무엇을 하는 곳인지", "정확히 설명드리기 어렵", "모른다고 답", "추측하지 않고, 모른다고",
    "확인되지 않습니다", "확인되지 않는", "존재하지 않는 것으로", "등장하지 않습니다", "등장하지 않는",
    "검색 결과에서 확인되지", "확인되지 않고", "특정되지 않", "존재하지 않는다고",
    "존재하지 않으며", "단일 회사는 존재하지", "단일 공식 기업은 존재하지",
    "회사가 아니라", "기업이 아니라", "마케팅 전략 용어", "전문 용어로",
    "브랜드명이라기보다", "고유한 브랜드명이라기보다", "특정 단일 회사",
    "특정 기업의 고유한", "회사명으로 사용하는 특정", "특정 단일",
    "is not a company", "is a marketing term", "is a strategy", "is not a specific company",
    "does not exist as a company", "no specific company",
]

# Hedging phrases.
HEDGED_SIGNALS = [
    "아마", "것 같", "것으로 보", "일 수도", "추정", "불분명", "확실하지 않",
    "다고 생각", "가능성", "정확하지 않", "확실하게 말하기 어렵",
    "probably", "likely", "might be", "i think", "i believe", "possibly",
    "not entirely sure", "not certain", "i'm not certain",
]

# Words that mark a specific claim.
CLAIM_WORDS = [
    "서비스", "제품", "고객", "매출", "ceo", "대표", "설립", "founded", "industry", "플랫폼", "company", "기업", "브랜드", "기술", "솔루션",
    "반도체", "핀테크", "교육", "가격", "도입", "사례", "비교", "연구", "행정", "기록", "지원서", "citation", "profile", "monitoring",
    "research", "compound", "material", "materials", "coating", "office", "records", "application", "admission",
    "campus",
]

# Words of a comparison.
COMPARISON_CUE = "비교|경쟁|대안|차이|대비|vs(?![A-Za-z0-9_])|versus|alternative|alternatives|competitor|competitors|compare|comparison"

# Known domains per source type.
SOURCE_DOMAINS = {
    "docs": ["readthedocs.io"],
    "wiki": ["wikipedia.org", "wikidata.org", "fandom.com", "namu.wiki"],
    "news": [
        "reuters.com", "bloomberg.com", "forbes.com", "wsj.com", "ft.com", "nytimes.com",
        "cnbc.com", "businessinsider.com", "techcrunch.com", "theverge.com", "wired.com",
        "hankyung.com", "mk.co.kr", "chosun.com", "joongang.co.kr", "koreaherald.com",
        "zdnet.com", "zdnet.co.kr",
    ],
    "directory": [
        "crunchbase.com", "zoominfo.com", "owler.com", "g2.com", "capterra.com", "cbinsights.com",
        "pitchbook.com", "tracxn.com", "yelp.com", "tripadvisor.com", "yellowpages.com", "foursquare.com",
    ],
    "community": ["reddit.com", "quora.com", "stackoverflow.com", "stackexchange.com", "github.com"],
    "social": [
        "linkedin.com", "x.com", "twitter.com", "facebook.com", "instagram.com",
        "youtube.com", "tiktok.com", "threads.net",
    ],
    "blog": ["medium.com", "substack.com", "blogspot.com", "wordpress.com", "tistory.com", "velog.io", "brunch.co.kr"],
}

# Authority tier and score per source type.
AUTHORITY = {
    "official": ("high", 1.0),
    "docs": ("high", 0.82),
    "wiki": ("high", 0.8),
    "news": ("high", 0.86),
    "directory": ("medium", 0.6),
    "community": ("low", 0.35),
    "social": ("low", 0.28),
    "blog": ("low", 0.42),
    "unknown": ("medium", 0.5),
}
# Wikis of medium authority.
MINOR_WIKIS = ["fandom.com", "namu.wiki"]
MINOR_WIKI_AUTHORITY = ("medium", 0.62)

# How well a source type fits an archetype; other types take the default.
FIT_WEIGHTS = {
    "software_service": {"official": 1.0, "docs": 0.95, "directory": 0.82, "news": 0.74, "community": 0.62, "wiki": 0.48, "blog": 0.44, "social": 0.34, "default": 0.46},
    "developer_tool": {"official": 1.0, "docs": 1.0, "community": 0.8, "directory": 0.55, "news": 0.58, "wiki": 0.44, "blog": 0.45, "social": 0.28, "default": 0.44},
    "local_business": {"official": 0.96, "directory": 0.96, "social": 0.74, "news": 0.58, "community": 0.42, "blog": 0.4, "wiki": 0.26, "docs": 0.22, "default": 0.44},
    "creator_media": {"official": 0.94, "social": 1.0, "news": 0.72, "blog": 0.62, "community": 0.46, "wiki": 0.4, "directory": 0.32, "docs": 0.2, "default": 0.38},
    "general_business": {"official": 1.0, "news": 0.82, "directory": 0.72, "docs": 0.62, "wiki": 0.55, "community": 0.45, "blog": 0.4, "social": 0.36, "default": 0.45},
}
OFFICIAL_PREFERRED = ["software_service", "developer_tool", "general_business"]

# Keywords of an archetype; on a tie the earlier archetype wins.
ARCHETYPE_WORDS = {
    "developer_tool": [
        "developer", "developers", "api", "sdk", "cli", "github", "open source", "open-source",
        "framework", "library", "devtool", "docs", "developer tool", "개발자", "오픈소스",
    ],
    "creator_media": [
        "creator", "influencer", "youtuber", "youtube", "instagram", "tiktok", "podcast", "streamer",
        "newsletter", "photographer", "artist", "writer", "크리에이터", "인플루언서", "유튜버", "인스타그램",
        "틱톡", "작가", "블로거", "콘텐츠", "미디어",
    ],
    "local_business": [
        "restaurant", "cafe", "salon", "clinic", "hospital", "yoga", "pilates", "studio", "bakery",
        "hotel", "shop", "store", "academy", "gym", "카페", "식당", "레스토랑", "미용실", "의원", "병원",
        "요가", "필라테스", "스튜디오", "맛집", "학원", "헬스장",
    ],
    "software_service": [
        "software", "saas", "platform", "automation", "analytics", "crm", "tool", "app", "solution",
        "cloud", "workflow", "assistant", "ai", "소프트웨어", "플랫폼", "솔루션", "앱", "자동화", "에이전트",
    ],
}

# Modes, intents, engines and which of them go together.
MODES = ["strict_recall", "live_search"]
INTENTS = ["awareness", "comparison", "purchase"]
ENGINE_ORDER = ["chatgpt", "perplexity", "gemini"]
UNSUPPORTED = [("perplexity", "strict_recall")]
MODE_PRIORITY = {
    ("live_search", "awareness"): 100,
    ("live_search", "comparison"): 60,
    ("live_search", "purchase"): 58,
    ("strict_recall", "awareness"): 80,
    ("strict_recall", "comparison"): 35,
    ("strict_recall", "purchase"): 30,
}
ENGINE_PRIORITY = {"chatgpt": 10, "perplexity": 8, "gemini": 6}

# Search-query templates; {name}, {domain} and {category} are filled per entity.
QUERY_SLOTS = {
    "brand": ["{name} 회사", "{name} official site", "{name} company profile", "{anchor}"],
    "official": ["{name} 공식 사이트", "site:{domain} {name}", "site:{domain} about", "{domain}"],
    "category_awareness": ["{name} {category}", "{category} company {name}", "{name} service", "{name} 무엇을 하는 회사"],
    "trust": ["{name} about", "{name} mission", "{name} profile", "{name} 소개"],
    "category_comparison": ["{name} {category}", "{category} alternatives", "{category} competitors", "{name} category"],
    "competitor": ["{name} alternatives", "{name} competitors", "{name} vs alternatives", "{name} comparison"],
    "differentiator": ["{name} differentiators", "{name} unique features", "{name} comparison official", "{name} why choose"],
    "commercial": ["{name} pricing", "{name} plans", "{name} quote", "{name} 가격"],
    "proof": ["{name} case study", "{name} customer story", "{name} implementation", "{name} 사례"],
    "conversion": ["{name} contact", "{name} demo", "site:{domain} contact", "site:{domain} pricing"],
}
INTENT_SLOTS = {
    "awareness": ["brand", "official", "category_awareness", "trust"],
    "comparison": ["brand", "category_comparison", "competitor", "differentiator"],
    "purchase": ["official", "commercial", "proof", "conversion"],
}

# Tool words that are no search query.
QUERY_NOISE = [
    "search", "web_search", "web search", "web-search", "search_preview", "web_search_preview", "web search preview",
    "tool", "action", "tool_call", "tool call", "function_call", "function call", "browser.search", "browser_search",
]
