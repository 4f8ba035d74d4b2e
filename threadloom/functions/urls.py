"""URL functions; malformed URLs give nulls, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of company blogs.
CORPORATE = [
    "cursor.com", "github.blog", "openai.com", "anthropic.com", "blog.replit.com", "sourcegraph.com", "codeium.com", "tabnine.com",
    "vercel.com", "aws.amazon.com", "devblogs.microsoft.com", "ai.meta.com", "blog.google", "huggingface.co", "pinecone.io",
    "blog.langchain.dev", "databricks.com", "supabase.com", "blog.cloudflare.com", "fly.io", "blog.jetbrains.com",
    "blog.postman.com", "linear.app", "netflixtechblog.com", "uber.com", "discord.com", "engineering.atspotify.com",
]


def normalize_url(url: Column) -> Column:
    """Trim, drop the fragment, lower case, no slash at the end."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(url), "#.*$", "")), "/+$", "")


def normalize_url_keep_query(url: Column) -> Column:
    """The other form: drop the fragment and the slashes at the end of the path, keep the query, lower case."""
    plain = F.regexp_replace(url, "#.*$", "")
    path, rest = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"(\?.*)$", 1)
    return F.lower(F.concat(F.regexp_replace(path, "/+$", ""), rest))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1), F.lit("")))


def domain(url: Column) -> Column:
    """The last two labels of the host."""
    return F.array_join(F.slice(F.split(host(url), r"\."), F.greatest(-F.size(F.split(host(url), r"\.")), F.lit(-2)), 2), ".")


def source_type(url: Column, corporate: list[str] | None = None) -> Column:
    h = host(url)
    named = F.lit(False)
    for d in corporate or CORPORATE:
        named = named | (h == d) | h.endswith("." + d)
    return (
        F.when(h.contains("medium.com"), "medium").when(h.contains("substack.com"), "substack").when(h.contains("stackoverflow.com"), "stackoverflow")
        .when(named, "corporate").otherwise("personal")
    )


def url_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def url_hash(url: Column) -> Column:
    return F.substring(F.md5(normalize_url(url)), 1, 12)
