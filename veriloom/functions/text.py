"""Column functions on texts and partial dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that are too general to carry a match.
GENERIC = ["security", "engineering", "development", "management", "system", "systems", "architecture", "infrastructure", "professional", "user", "data", "communication"]

# A number tied to an outcome unit (percent, currency, distance, area, volume, people).
METRIC = [
    r"\d[\d,]*\.?\d*\s?%",
    r"[$€£]\s?\d[\d,]*\.?\d*",
    r"\d[\d,]*\.?\d*\s?(?:eur|usd|gbp|euros?|dollars?)\b",
    r"\d[\d,]*\+?[\s-]?(?:km|kilomet(?:er|re)s?|miles?|mi)\b",
    r"\d[\d,]*\+?[\s-]?acres?\b",
    r"\d[\d,]*[\s-]?(?:rows?|records?|items?|batches?|files?|documents?|programmes?|programs?)\b",
    r"\d[\d,]*\+?[\s-]?(?:participants?|customers?|clients?|users?|people|learners?|students?|employees?|experts?)\b",
]

# Names of months.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def present(c: Column | str) -> Column:
    """The value, with the empty string as missing."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def terms(c: Column) -> Column:
    """All ``[a-z0-9]+`` runs of the lower-cased text, in order; null gives none. A dotted capital I is an ``i`` within its
    word, as in SQL; Spark alone would put a combining dot after it, which cuts the word."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\u0130"), F.lit("i"))), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(c: Column) -> Column:
    """Distinct terms."""
    return F.array_distinct(terms(c))


def normalize(c: Column) -> Column:
    """Without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def list_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def exact_class(query: Column, name: Column, aliases: Column) -> Column:
    """``canonical_exact`` if the query is the name, else ``alias_exact`` if it is an alias, else null."""
    q = normalize(query)
    return F.when(q == normalize(name), "canonical_exact").when(F.exists(list_or_empty(aliases), lambda a: normalize(a) == q), "alias_exact")


def meaningful_overlap(query: Column, name: Column, aliases: Column) -> Column:
    """Sorted tokens that the query shares with the name or an alias, without general ones."""
    own = F.array_union(tokens(name), tokens(F.array_join(list_or_empty(aliases), " ")))
    return F.array_sort(F.array_except(F.array_intersect(tokens(query), own), F.array(*map(F.lit, GENERIC))))


def _metric_pattern(flags: str, digit: str, space: str, edge: str = r"\b") -> str:
    """``METRIC`` as one pattern. Numbers that several units share are read once, and only from their first digit, as a
    match from a later one is a match from there as well."""
    number, first = r"\d[\d,]*", f"[{digit}]"  # what precedes is looked at from a digit only, not from every sign

    def of(p: str) -> str:
        for own, same in ((r"[\d,]", f"[{digit},]"), (r"\d", f"[{digit}]"), (r"[\s-]", f"[{space}-]"), (r"\s", f"[{space}]"), (r"\b", edge)):
            p = p.replace(own, same)
        return p

    units = "|".join(of(p.removeprefix(number)) for p in METRIC if p.startswith(number))
    return "|".join([*[of(p) for p in METRIC if not p.startswith(number)], f"{first}(?<![{digit}]{first})[{digit},]*(?{flags}:{units})"])


def has_metric(c: Column, like_sql: bool = False) -> Column:
    """Whether the text names a number with an outcome unit; null and empty don't. Digits, white space and words are those of
    Unicode; ``like_sql`` they are ASCII ones, as in DuckDB's patterns. Texts of ASCII alone take a cheaper pattern."""
    if like_sql:
        space, word = r"\t\n\f\r ", "[0-9A-Za-z_]"
        wide = _metric_pattern("iu", "0-9", space, f"(?-iu:(?<={word})(?!{word})|(?<!{word})(?={word}))")
    else:
        space, wide = r"\t-\r ", "(?U)" + _metric_pattern("i", r"\d", r"\s")
    return F.coalesce(F.when(c.rlike(r"[^\x00-\x7F]"), c.rlike(wide)).otherwise(c.rlike(_metric_pattern("i", "0-9", space))), F.lit(False))


def slug(c: Column) -> Column:
    """Lower case, everything but ``[a-z0-9]`` as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truncate(c: Column, width: int = 90) -> Column:
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.substring(c, 1, width - 1), F.lit("…")))


def partial_date(c: Column) -> Column:
    """``2026-01-01`` as ``Jan 2026``, ``2025`` as is; a year that is no number leaves the text as it is."""
    parts = F.split(c, "-")
    y, m = (F.get(parts, i).try_cast("int") for i in (0, 1))
    named = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.when(m.between(1, 12), m).otherwise(1)), y.cast("string"))
    return F.when(present(c).isNull(), None).when(y.isNull(), c).when(m.between(1, 12), named).otherwise(y.cast("string"))


def natural_list(items: Column) -> Column:
    """``a, b and c``."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(items, n - 1)))


def skill_bucket(name: Column, category: Column) -> Column:
    """The section of a skill: by fixed lists, else by category."""
    chosen = F.lit(None).cast("string")
    for bucket, names in reversed(SKILL_BUCKETS.items()):
        chosen = F.when(name.isin(names), bucket).otherwise(chosen)
    return F.coalesce(chosen, F.when(category == "technical", "programming").when(category == "tool", "tools").otherwise("capabilities"))


# Well-known names by section.
SKILL_BUCKETS = {
    "programming": ["python", "c", "c++", "typescript", "javascript", "sql"],
    "frameworks": ["fastapi", "fastify", "react", "react native", "expo", "expo router", "zod", "drizzle orm", "streamlit", "node.js"],
    "databases": ["postgresql", "sqlite", "pglite"],
    "tools": [
        "docker", "docker compose", "git", "github", "pnpm", "jwt", "jwks", "oauth", "google oauth", "figma", "claude code", "chatgpt", "uvicorn", "groq api", "llama 3.3 70b", "pdfplumber",
        "python-docx", "swagger ui", "ngrok", "render", "make", "minilibx", "http", "json", "openapi", "unix", "linux", "posix threads", "tcp/ip", "gps systems", "supabase", "pandas", "numpy", "openpyxl",
    ],
}

# Themes in rule order.
THEMES = [
    (["typescript", "react", "javascript"], "Full-stack TypeScript/React development"),
    (["llm api integration", "prompt engineering", "ai automation", "llm engineering"], "AI/LLM automation pipelines"),
    (["fastify", "fastapi", "node.js", "backend engineering", "api development"], "Backend API development"),
    (["postgresql", "sqlite", "sql"], "PostgreSQL/data systems"),
    (["claude code"], "AI-assisted development with Claude Code"),
    (["c", "c++", "systems programming", "algorithms"], "Systems programming fundamentals"),
    (["docker", "docker compose", "containerization"], "Containerized deployment"),
]
