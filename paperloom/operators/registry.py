"""A company registry: ingest with aliases, last-wins and upsert; look-ups with reasons; n-gram search and facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: Rows up to which a key list is broadcast to the registry; beyond it the join shuffles both sides on the key.
KEYS_BROADCAST = 200_000
#: Facet values are ranked in so many groups before the best of all groups are.
RANK_GROUPS = 64
SEARCH_FIELDS = ("name", "address", "owner", "industries", "vat")
#: Header names of registry exports, the first present wins.
ALIASES = {
    "vat": ("統一編號", "vat", "tax_id", "business_id"),
    "name": ("營業人名稱", "公司名稱", "name", "company_name"),
    "address": ("營業地址", "公司所在地", "address"),
    "owner": ("負責人姓名", "代表人姓名", "owner"),
    "org_type": ("組織別名稱", "組織型態", "org_type"),
    "status": ("營業狀況", "公司狀況", "status"),
}


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Field -> column by alias, without case; vat and name are required."""
    lower = {c.strip().lower(): c for c in columns}
    found = {field: next((lower[a.lower()] for a in names if a.lower() in lower), None) for field, names in ALIASES.items()}
    if not found["vat"] or not found["name"]:
        raise ValueError("the header must name the business id and the company")
    return {k: v for k, v in found.items() if v}


def ingest(raw: DataFrame, order_col: str | None = None) -> DataFrame:
    """Registry rows: valid ids and names, empty text as null, industries gathered, the last row of an id wins."""
    fields = resolve_headers(raw.columns)
    value = lambda c: F.nullif(F.trim(raw[c].cast("string")), F.lit(""))
    industries = [c for c in raw.columns if c.startswith("名稱")]
    out = raw.select(
        *[value(c).alias(f) for f, c in fields.items()],
        *[F.lit(None).cast("string").alias(f) for f in ALIASES if f not in fields],
        (F.array_join(F.array_distinct(F.array_compact(F.array(*[value(c) for c in industries]))), " / ") if industries else F.lit(None).cast("string")).alias("industries"),
        (raw[order_col] if order_col else F.monotonically_increasing_id()).alias("_order"),
    ).filter(F.col("vat").rlike("^[0-9]{8}$") & F.col("name").isNotNull())
    return last_wins(out, "vat", "_order").drop("_order")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as one aggregation: partial results are combined before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def upsert_category(registry: DataFrame, source: DataFrame, category: str) -> DataFrame:
    """New ids are added; of known ids only the category changes."""
    s = source.select("vat", *[F.col(c).alias(f"_{c}") for c in source.columns if c != "vat"], F.lit(True).alias("_new"))
    joined = registry.withColumn("_old", F.lit(True)).join(s, "vat", "full_outer")
    keep = lambda c: F.coalesce(c, f"_{c}") if f"_{c}" in joined.columns else F.col(c)
    return joined.select("vat", *[(F.when(F.col("_new"), category).otherwise(F.col(c)) if c == "category" else keep(c)).alias(c) for c in registry.columns if c != "vat"])


def lookup(keys: DataFrame, registry: DataFrame, key_col: str = "vat") -> DataFrame:
    """Every key in its order, repeated keys included, with the registry's row or the reason why there is none."""
    small = F.broadcast(keys) if keys.count() <= KEYS_BROADCAST else keys
    found = registry.join(small.select(F.col(key_col).alias("vat")).distinct(), "vat", "left_semi")
    hits = found.select(F.col("vat").alias("_vat"), *[c for c in registry.columns if c != "vat"])
    joined = keys.join(hits, keys[key_col] == F.col("_vat"), "left")
    reason = F.when(F.col("_vat").isNotNull(), "found").when(~F.coalesce(keys[key_col].rlike("^[0-9]{8}$"), F.lit(False)), "非 8 位數字").otherwise("查無")
    return joined.withColumn("result", reason).drop("_vat")


def fold(text: Column) -> Column:
    """Variants of one character, and case, made equal."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "臺", "台"))


def tokens(text: Column) -> Column:
    """Index tokens: each CJK character by itself, other runs as words."""
    return F.regexp_extract_all(fold(text), F.lit(rf"{T.CJK}|[\p{{L}}\p{{N}}&&[^㐀-䶿一-鿿豈-﫿]]+"), 0)


def postings(registry: DataFrame, fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
    """(token, vat, field): the inverted index, to be written partitioned by field and sorted by token."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(tokens(F.col(f))).alias("tokens")) for f in fields if f in registry.columns]))
    return registry.select("vat", each.alias("x")).select("vat", "x.field", F.explode("x.tokens").alias("token"))


def matches(registry: DataFrame, text: str, fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
    """Rows in which every keyword stands in some field; variants are folded."""
    for word in text.split():
        hit = reduce(lambda a, b: a | b, [fold(F.col(f)).contains(fold_plain(word)) for f in fields if f in registry.columns])
        registry = registry.filter(hit)
    return registry


def fold_plain(word: str) -> str:
    return word.lower().replace("臺", "台")


def filtered(found: DataFrame, org_type: str | None = None, categories: list[str] | None = None, city: str | None = None, industry: str | None = None) -> DataFrame:
    """Only the rows that fit; a filter is part of the plan only if it is asked for."""
    if org_type:
        found = found.filter(F.col("org_type") == org_type)
    if categories:
        found = found.filter(F.col("category").isin(categories))
    if city:
        found = found.filter(fold(F.col("address")).startswith(fold_plain(city)))
    if industry:
        found = found.filter(F.col("industries").contains(industry))
    return found


def search(registry: DataFrame, text: str = "", fields: tuple[str, ...] = SEARCH_FIELDS, limit: int = 100, **filters) -> DataFrame:
    """Filtered matches of parts of words, without an index (``search_index`` has one), by name, then id."""
    return filtered(matches(registry, text, fields), **filters).orderBy("name", "vat").limit(max(1, min(limit, 500)))


def facets(found: DataFrame, k: int = 8) -> DataFrame:
    """(facet, value, count): the k most frequent cities, kinds and industries of all matches."""
    values = F.array(
        F.struct(F.lit("city").alias("facet"), T.city_of(F.coalesce("address", F.lit(""))).alias("value")),
        F.struct(F.lit("org").alias("facet"), F.col("org_type").alias("value")),
    )
    industries = F.transform(F.split(F.coalesce("industries", F.lit("")), r"\s*[／/]\s*"), lambda v: F.struct(F.lit("industry").alias("facet"), F.trim(v).alias("value")))
    rows = found.select(F.explode(F.concat(values, industries)).alias("x")).select("x.*").filter("value IS NOT NULL AND value <> ''")
    counted = rows.groupBy("facet", "value").agg(F.count("*").alias("count"))
    return most_frequent(counted, k)


def most_frequent(counted: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each facet, from (facet, value, count); ranked in groups first, so that no task sorts
    all values of a facet."""
    order = [F.desc("count"), "value"]
    grouped = counted.withColumn("_group", F.pmod(F.xxhash64("value"), F.lit(RANK_GROUPS)))
    some = grouped.withColumn("_rank", F.row_number().over(Window.partitionBy("facet", "_group").orderBy(*order))).filter(F.col("_rank") <= k)
    return some.withColumn("_rank", F.row_number().over(Window.partitionBy("facet").orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank", "_group")


def category_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy(F.coalesce("category", F.lit("未分類")).alias("category")).agg(F.count("*").alias("count"))
