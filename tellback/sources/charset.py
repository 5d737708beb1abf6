"""Charset choice and byte decoding of fetched pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

# Web names of charsets that differ from their codec.
CODECS = {
    "iso-8859-1": "cp1252",
    "latin1": "cp1252",
    "ascii": "cp1252",
    "us-ascii": "cp1252",
    "windows-1252": "cp1252",
    "euc-kr": "cp949",
    "ks_c_5601-1987": "cp949",
    "korean": "cp949",
    "shift_jis": "cp932",
    "sjis": "cp932",
    "gb2312": "gbk",
}


def detect_charset(content_type: Column, body: Column) -> Column:
    """Charset named by the header, else by a <meta> in the first 4096 bytes, else ''."""
    from_header = F.regexp_replace(
        F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), "(?i)charset=([^\\s;]+)", 1)), "['\"]", ""
    )
    # bytes above 127 are not letters of a charset name, so one byte per character is enough here
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    direct = F.regexp_extract(head, "(?i)<meta[^>]+charset=[\"']?\\s*([a-z0-9_-]+)", 1)
    in_content = F.regexp_extract(head, "(?i)<meta[^>]+content=[\"'][^\"']*charset=([a-z0-9_-]+)", 1)
    return F.when(from_header != "", from_header).otherwise(F.lower(F.when(direct != "", direct).otherwise(in_content)))


@F.pandas_udf(ST.StringType())
def decode_bytes(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Decode bytes; unknown charsets fall back to UTF-8. The built-in decode knows few charsets."""

    def one(data, name):
        if data is None:
            return None
        try:
            return bytes(data).decode(CODECS.get(name, name) or "utf-8", errors="replace")
        except LookupError:
            return bytes(data).decode("utf-8", errors="replace")

    return pd.Series([one(d, n) for d, n in zip(body, charset)])
