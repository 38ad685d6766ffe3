"""The sources that can be asked, as rows: what each takes, where it asks, its bounds; and the rules by which a profile counts as found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source, category, delivery, host, selector kinds it takes, most bytes of a response, most calls, seconds that a response stays fresh.
SOURCES = (
    ("github", "Public profiles", "native", "api.github.com", "username", 2 << 20, 1, 28800),
    ("codeberg", "Public profiles", "native", "codeberg.org", "username", 2 << 20, 1, 28800),
    ("hackernews", "Public profiles", "native", "hacker-news.firebaseio.com", "username", 2 << 20, 1, 28800),
    ("dns", "Public records", "native", "cloudflare-dns.com", "domain", 8 << 20, 1, 28800),
    ("rdap", "Public records", "native", "", "domain", 8 << 20, 1, 28800),
    ("crt_sh", "Public records", "native", "crt.sh", "domain", 8 << 20, 1, 28800),
    ("searxng", "Text discovery", "native", "127.0.0.1:8088", "name", 4 << 20, 1, 0),
    ("wayback", "Public records", "native", "web.archive.org", "domain", 8 << 20, 1, 28800),
    ("osint_industries", "Optional providers", "provider_backed", "api.osint.industries", "email phone username name wallet", 8 << 20, 1, 0),
    ("lenso", "Optional providers", "provider_backed", "api.lenso.ai", "image", 8 << 20, 1, 0),
    ("eyematch", "Optional providers", "provider_backed", "api.eyematch.ai", "image", 8 << 20, 1, 0),
    ("osint_industries_credits", "Optional providers", "provider_backed", "api.osint.industries", "username email phone name domain ip wallet image", 64 << 10, 1, 0),
    ("pimeyes", "Browser workflows", "manual_workflow", "", "image", 2 << 20, 0, 0),
    ("instantusername", "Browser workflows", "manual_workflow", "", "username", 2 << 20, 0, 0),
    ("whatsmyname", "Browser workflows", "manual_workflow", "", "username", 2 << 20, 0, 0),
    ("osint_industries_web", "Browser workflows", "manual_workflow", "", "ip domain image", 2 << 20, 0, 0),
)

#: Source, address asked, address shown, field with the identity, whether letter case counts, whether a numeric id must be there,
#: status of a missing profile, its message (null: the literal null), whether bracketed details may follow the message, most bytes.
RECIPES = (
    ("github", "https://api.github.com/users/{username}", "https://github.com/{username}", "login", False, True, 404, "Not Found", False, 2097152),
    ("codeberg", "https://codeberg.org/api/v1/users/{username}", "https://codeberg.org/{username}", "login", False, True, 404, "The user does not exist", True, 2097152),
    ("hackernews", "https://hacker-news.firebaseio.com/v0/user/{username}.json", "https://news.ycombinator.com/user?id={username}", "id", True, False, 200, None, False, 2097152),
)
REFUSALS = (401, 402, 403, 429)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sources(spark: SparkSession) -> DataFrame:
    """The registry: source, category, delivery, host, kinds (array), most_bytes, most_calls, fresh_seconds."""
    rows = spark.createDataFrame(SOURCES, "source string, category string, delivery string, host string, kinds string, most_bytes long, most_calls int, fresh_seconds int")
    return rows.withColumn("kinds", F.split("kinds", " "))


def recipes(spark: SparkSession) -> DataFrame:
    schema = "source string, asked string, shown string, identity_field string, case_matters boolean, numeric_id boolean, missing_status int, missing_message string, details_follow boolean, most_bytes long"
    return spark.createDataFrame(RECIPES, schema)


def choices(selectors: DataFrame, delivery: str = "native") -> DataFrame:
    """selectors (kind, ...) with each source of that delivery that takes their kind; the registry is a fixed list, so it is broadcast."""
    kinds = sources(selectors.sparkSession).filter(F.col("delivery") == delivery).select("source", "host", "most_calls", F.explode("kinds").alias("kind"))
    return selectors.join(F.broadcast(kinds), "kind")


def profile_outcomes(responses: DataFrame) -> DataFrame:
    """responses (source, username, status, redirected, body) with outcome and url by the source's recipe.

    blocked, error, not_found, found (url is the shown address) or unknown: too long, redirected, no JSON, a missing or other identity,
    no recipe. Null status, body or username: unknown.
    """
    j = responses.join(F.broadcast(recipes(responses.sparkSession)), "source", "left").withColumn("__v", F.try_parse_json("body"))
    v, status = F.col("__v"), F.col("status")

    def text_of(field: str) -> Column:
        part = F.try_variant_get(v, f"$.{field}", "variant")
        return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))

    message, expected = text_of("message"), F.col("missing_message")
    missing = F.when(expected.isNull(), F.is_variant_null(v)).otherwise((message == expected) | (F.col("details_follow") & F.startswith(message, F.concat(expected, F.lit(" [")))))
    identity = F.lit(None).cast("string")
    for field in sorted({r[3] for r in RECIPES}):
        identity = F.when(F.col("identity_field") == field, text_of(field)).otherwise(identity)
    plain = lambda x: F.when(F.col("case_matters"), x).otherwise(F.translate(x, UPPER, LOWER))
    whole = F.schema_of_variant(F.try_variant_get(v, "$.id", "variant")).rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))$")
    numbered = ~F.col("numeric_id") | (whole & (F.try_variant_get(v, "$.id", "decimal(38,0)") > 0))
    usable = F.col("asked").isNotNull() & (F.octet_length("body") <= F.col("most_bytes")) & ~F.coalesce("redirected", F.lit(False))
    outcome = (
        F.when(~F.coalesce(usable, F.lit(False)), "unknown").when(status.isin(*REFUSALS), "blocked").when(status >= 500, "error").when(v.isNull(), "unknown")
        .when((status == F.col("missing_status")) & missing, "not_found").when((status == 200) & (plain(identity) == plain(F.col("username"))) & numbered, "found").otherwise("unknown")
    )
    out = j.withColumn("outcome", outcome)
    return out.withColumn("url", F.when(F.col("outcome") == "found", F.replace("shown", F.lit("{username}"), F.col("username")))).select(*responses.columns, "outcome", "url")
