"""Lead forms and log redaction."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tellback.functions import text as T
from tellback.functions import urls as U

# Rules of industry templates, first match wins.
TEMPLATE_RULES = [
    ("b2b-saas", "saas|software|b2b|platform|crm|erp|ai 솔루션|ai platform"),
    ("developer-tool", "developer|sdk|api|cli|library|framework|개발자|문서|깃허브|github"),
    ("local-business", "restaurant|cafe|clinic|salon|yoga|gym|local|매장|카페|식당|병원|미용실|학원"),
    ("professional-service", "consulting|agency|law|tax|accounting|clinic|studio|컨설팅|에이전시|법률|세무|노무|병원"),
    ("commerce-brand", "commerce|shop|store|brand|product|mall|쇼핑몰|브랜드|상품|커머스|이커머스"),
    ("creator-education", "creator|influencer|course|class|교육|강의|콘텐츠|크리에이터|인플루언서|유튜브|youtube"),
]


def industry_template(*parts: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *parts))
    out = None
    for name, pattern in TEMPLATE_RULES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("general-business")


def clean(col: Column, limit: int) -> Column:
    return F.substring(T.squeeze(col), 1, limit)


def domain_of(col: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(clean(col, 255), "(?i)^https?://", ""), "(?i)^www\\.", "")
    return F.lower(F.regexp_replace(bare, "/.*$", ""))


def _first(*names: str) -> Column:
    return T.first_text(*[F.coalesce(F.col(n), F.lit("")) for n in names])


def lead_cleanse(leads: DataFrame, hosting: list[str]) -> DataFrame:
    """Normalised lead records with the list of missing or bad fields."""
    url_in = clean(_first("url", "website_url", "target_url"), 400)
    url = F.coalesce(U.normal(url_in), F.when(url_in != "", U.normal(F.concat(F.lit("https://"), url_in))), F.lit(""))
    df = leads.withColumns(
        {
            "contact_name": clean(F.col("contact_name"), 80),
            "email": F.lower(clean(F.col("email"), 160)),
            "company": clean(_first("company_name", "company", "name"), 120),
            "clean_url": url,
            "main_service": clean(F.col("main_service"), 220),
            "hosting": F.when(F.col("hosting").isin(hosting), F.col("hosting")).otherwise("other"),
        }
    )
    df = df.withColumn(
        "clean_domain", domain_of(T.first_text(F.coalesce("domain", F.lit("")), U.bare_host(F.col("clean_url"))))
    )
    df = df.withColumn("template", industry_template(F.col("industry"), F.col("main_service"), F.lit("")))
    error = lambda cond, name: F.when(cond, F.lit(name))
    errors = F.array(
        error(F.col("contact_name") == "", "contact_name"),
        error(~F.col("email").rlike("^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"), "email"),
        error(F.col("company") == "", "company"),
        error((F.col("clean_domain") == "") & (F.col("clean_url") == ""), "domain"),
        error(F.col("main_service") == "", "main_service"),
    )
    return df.withColumn("errors", F.array_compact(errors))


# --- redaction --------------------------------------------------------------------
# Key names whose values are secret.
SECRET_KEYS = {"apikey", "api_key", "token", "authorization", "secret", "password", "credential", "cookie", "session"}


def redact_email(col: Column) -> Column:
    return F.regexp_replace(col, "(?s)^(.)[^@]*(@.*)$", "$1***$2")


def redact_url(col: Column) -> Column:
    p = U.path(col)
    short = F.when(F.length(p) > 60, F.concat(F.substring(p, 1, 60), F.lit("..."))).otherwise(p)
    return F.coalesce(F.when(U.host(col) != "", F.concat(U.host(col), short)), F.substring(col, 1, 80))


def _mask_email(text: str) -> str:
    at = text.find("@")
    return text if at <= 0 else text[0] + "***" + text[at:]


def _mask(value, key: str = ""):
    low = key.lower()
    if key and (low in SECRET_KEYS or any(w in low for w in ("key", "token", "secret"))):
        return "[REDACTED]"
    if low in ("email", "phone"):
        return _mask_email(value) if isinstance(value, str) else "[REDACTED]"
    if isinstance(value, dict):
        return {k: _mask(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [_mask(v) if isinstance(v, (dict, list)) else v for v in value]
    if key and isinstance(value, str) and len(value) > 200:
        return value[:200] + "..."
    return value


@F.pandas_udf(ST.StringType())
def redact_json(values: pd.Series) -> pd.Series:
    """Secrets masked by key, e-mails shortened, long texts cut, at any depth of a JSON record."""

    def one(text):
        try:
            return json.dumps(_mask(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return values.map(one)
