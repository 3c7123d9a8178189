"""Selection: canonical copies, licences, stubs, domains, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded

#: What a domain is called by a collection's categories.
CATEGORY_DOMAIN = {
    "bio-research": "research",
    "customer-support": "support",
    "data": "analytics",
    "design": "business",
    "engineering": "software",
    "enterprise-search": "research",
    "finance": "finance",
    "human-resources": "business",
    "legal": "business",
    "marketing": "marketing",
    "operations": "operations",
    "product-management": "business",
    "productivity": "productivity",
    "sales": "sales",
    "small-business": "business",
    "cowork-plugin-management": "software",
}

#: Patterns on names, the first that matches decides.
NAME_HINTS = (
    (r"ads\b|seo|brand|social|growth|funnel|campaign|tiktok|influencer|content", "marketing"),
    (r"lead|prospect|crm|quota|shopify|ecommerce|ebay|etsy|walmart|amazon|checkout", "sales"),
    (r"financ|account|tax|invoice|billing|crypto|trading|backtest|trade|budget|expense|payroll", "finance"),
    (r"support|ticket|escalat|helpdesk", "support"),
    (r"operations|\bops\b|oncall|incident|vendor|procurement|logistics|supply", "operations"),
    (r"legal|contract|nda|compliance|hiring|interview|onboard|hr\b|recruit|leadership|manag", "business"),
    (r"research|digest|survey|interview", "research"),
    (r"\bdata\b|dashboard|analytics|visual|sql|statistic|report|scrap|metric", "analytics"),
    (r"meeting|productiv|assistant|email|calendar|notes|slides|pdf|template|notion|workflow", "productivity"),
    (r"kotlin|golang|django|backend|pattern|cache|testing|perl|rust|coroutine|android|ios|mobile|code|deploy|debug|\bapi\b|sdk|cli\b|mcp\b|devops|docker|k8s", "software"),
    (r"writ|copy|editor|author|blog|postmortem|runbook|poem|story|novel", "writing"),
)


def path_score(relpath: Column) -> Column:
    """Lower is more canonical: skills, .agents/skills, elsewhere, docs."""
    under = lambda p: (relpath == p) | relpath.startswith(p + "/")
    return F.when(under("skills"), 0).when(under(".agents/skills"), 1).when(under("docs"), 3).otherwise(2)


def canonical(df: DataFrame, repo: str = "repo", name: str = "skill_name", relpath: str = "relpath", score: Column | None = None) -> DataFrame:
    """One copy for each (repository, name): the lowest path score, then the first path."""
    w = Window.partitionBy(repo, name).orderBy(path_score(F.col(relpath)) if score is None else score, relpath)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def by_map(col: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def domain(repo: Column, relpath: Column, name: Column, *, repo_domains: dict[str, str] | None = None, category_repos: tuple[str, ...] = (), hints=NAME_HINTS) -> Column:
    """Category (for repositories laid out by category; design with `copy` is writing), repository, name pattern, business."""
    category = by_map(F.get(F.filter(F.split(relpath, "/"), lambda p: p != ""), 0), CATEGORY_DOMAIN)
    category = F.when(repo.isin(*category_repos), F.when(F.get(F.split(relpath, "/"), 0).eqNullSafe(F.lit("design")) & name.contains("copy"), "writing").otherwise(category)) if category_repos else F.lit(None).cast("string")
    hinted = F.lit("business")
    for pattern, d in reversed(hints):
        hinted = F.when(name.rlike(pattern), d).otherwise(hinted)
    return F.coalesce(category, by_map(repo, repo_domains or {}), hinted)


def quota_sample(df: DataFrame, quotas: dict[str, int], *, domain: str = "domain", key: str = "id", seed: int = 42) -> DataFrame:
    """Up to the quota of each domain, in a seeded order. The top rows of each task are cut before the shuffle."""
    limit = by_map(F.col(domain), {k: str(v) for k, v in quotas.items()}).cast("int")
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(seeded(seed, F.col(key)), key))
    most = max(quotas.values(), default=0)
    return df.withColumn("_rank", rank).where(f"_rank <= {most}").where(F.col("_rank") <= limit).withColumnRenamed("_rank", "rank")


def shortfalls(df: DataFrame, quotas: dict[str, int], domain: str = "domain") -> DataFrame:
    """(domain, have, want) where a domain has fewer records than its quota."""
    want = df.sparkSession.createDataFrame(sorted(quotas.items()), f"{domain} string, want bigint")
    have = df.groupBy(domain).agg(F.count("*").alias("have"))
    return want.join(have, domain, "left").select(domain, F.coalesce("have", F.lit(0)).alias("have"), "want").where("have < want")


def skip_counts(df: DataFrame, *, repo: str = "repo", stub: str = "stub", licence: str = "licence", excluded: str = "excluded") -> DataFrame:
    """(reason, n): why records leave the pool, tested in the order exclusion, stub, licence; kept ones count as `pool`."""
    reason = (
        F.when(F.col(excluded), F.lit("excluded"))
        .when(F.col(stub), F.concat(F.lit("stub:"), F.col(repo)))
        .when(F.col(licence).isNull(), F.col(repo))
        .otherwise(F.lit("pool"))
    )
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
