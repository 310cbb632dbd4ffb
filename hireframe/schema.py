"""Schemas of the stored tables and of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def job_listings() -> T.StructType:
    return struct(
        "id long, job_title string, company_name string, salary_range string, salary_avg int, location string, "
        "openings int, requirements string, search_keyword string, data_year int, created_at timestamp_ntz"
    )


def city_mapping() -> T.StructType:
    return struct("short_name string, full_name string")


def users() -> T.StructType:
    return struct("id long, email string, name string, hashed_password string, created_at timestamp_ntz, updated_at timestamp_ntz")


def chat_sessions() -> T.StructType:
    return struct("id long, user_id long, session_id string, title string, created_at timestamp_ntz, updated_at timestamp_ntz")


def chat_messages() -> T.StructType:
    return struct("id long, chat_session_id long, role string, content_type string, content string, created_at timestamp_ntz")


def nodes() -> T.StructType:
    return struct("id string, labels array<string>, properties map<string,string>")


def edges() -> T.StructType:
    return struct("src string, dst string, type string, properties map<string,string>")


def extraction() -> T.StructType:
    return struct(
        "nodes array<struct<id string, type string, properties map<string,string>>>, "
        "relationships array<struct<source string, target string, type string, properties map<string,string>>>"
    )


#: Labels and edge types that an extraction may hold.
NODE_LABELS = ["JobPosting", "Company", "Skill", "Location", "Year"]
EDGE_TYPES = ["OFFERED_BY", "LOCATED_IN", "REQUIRES_SKILL", "BELONGS_TO", "YEAR"]

#: Columns of a crawl sheet and their names in job_listings.
SHEET_COLUMNS = {"岗位名称": "job_title", "公司名称": "company_name", "薪资范围": "salary_range", "城市": "location", "职位描述": "requirements", "搜索关键词": "search_keyword", "数据年份": "data_year"}


def create_tables(spark, names: list[str] | None = None, database: str | None = None) -> list[str]:
    """Creates the stored tables that do not exist yet, as Parquet tables of the session's catalogue, in its database or another."""
    made = []
    for name, schema in {"job_listings": job_listings, "city_mapping": city_mapping, "users": users, "chat_sessions": chat_sessions, "chat_messages": chat_messages}.items():
        if names is None or name in names:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema())
            spark.sql(f"CREATE TABLE IF NOT EXISTS {f'{database}.' if database else ''}{name} ({columns}) USING parquet")
            made.append(name)
    return made


def missing_columns(df, required: list[str]) -> list[str]:
    """Required columns that df lacks, in the order asked."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df, required: list[str]) -> None:
    if missing := missing_columns(df, required):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def add_column_if_absent(df, name: str, kind: str):
    from pyspark.sql import functions as F

    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
