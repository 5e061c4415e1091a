"""Invoices from scanned codes: fixed-width parsing, item lists, keyed dedup, enrichment, rules, fiscal periods, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import business as B
from paperloom.session import numbered

CODE_CHARS = 77
BUFFER_ROWS = 1000

#: Fixed values: (account subject, words in a seller's industries), first match wins.
INDUSTRY_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("油料費", ("加油站", "汽油零售", "汽油及柴油", "車用燃料", "車輛汽油", "石油", "燃料零售", "燃料油零售", "潤滑油")),
    ("旅費", ("計程車", "客運", "通運", "公共汽車", "汽車運輸", "鐵路運輸", "捷運", "輕軌運輸", "航空運輸", "航空公司", "高鐵", "船舶運輸", "水上運輸", "渡輪")),
    ("旅費", ("停車場", "停車塔", "停車管理")),
    ("旅費", ("旅館業", "飯店", "民宿", "汽車旅館", "短期住宿", "套房")),
    ("郵電費", ("電信", "行動通信", "電信服務", "電信批發", "電信零售", "網路電話", "網際網路接取")),
    ("郵電費", ("郵政", "郵局", "郵務")),
    ("水電瓦斯費", ("電力供應", "電力供給", "電力業", "輸配電", "自來水", "瓦斯供應", "燃氣", "蒸氣供應")),
    ("運費", ("快遞", "物流", "貨運", "宅配", "倉儲", "運輸承攬", "報關業", "船務代理", "海空運承攬")),
    ("文具印刷費", ("印刷業", "印刷服務", "影印", "曬圖", "打字", "裝訂", "文具", "事務用品", "辦公用品")),
    ("資訊服務費", ("軟體出版", "軟體服務", "資訊服務", "雲端服務", "資料處理", "電腦軟體", "電腦系統", "系統整合", "電腦周邊", "電腦諮詢", "電腦設備", "電腦零售", "電腦批發", "資訊諮詢", "資訊顧問", "資訊批發", "資訊零售", "網站經營", "入口網站", "資料儲存", "電子商務")),
    ("保險費", ("保險業", "保險經紀", "保險代理", "再保險", "人身保險", "財產保險")),
    ("伙食費", ("餐館", "餐廳", "餐飲", "速食", "便當", "飲料店", "茶飲料店", "小吃店", "咖啡店", "咖啡館", "麵店", "燒烤", "燒臘", "牛肉麵", "便利商店", "便當店", "餐盒", "外燴", "冰品", "冷飲", "甜點", "麵包", "烘焙", "壽司", "日本料理", "韓式料理", "西式餐飲")),
    ("書報雜誌", ("書店", "出版", "報紙出版", "雜誌出版", "圖書批發", "圖書零售", "電子書")),
    ("修繕費", ("汽車修理", "機車修理", "輪胎", "汽車保養", "機械修理", "電器修理", "建物修繕", "水電工程", "管路工程")),
    ("廣告費", ("廣告業", "廣告服務", "廣告設計", "媒體代理", "公關服務", "市場研究")),
    ("醫療費", ("醫療業", "醫院", "診所", "牙醫", "中醫", "藥局", "藥房", "復健", "物理治療")),
    ("訓練費", ("補習班", "教育訓練", "短期補習", "技藝補習", "電腦補習", "語文補習", "美語", "兒童才藝", "職業訓練", "成人教育")),
    ("租金支出", ("不動產租賃", "辦公室租賃", "倉庫租賃", "房屋租賃", "土地租賃")),
    ("手續費", ("銀行業", "信用合作社", "票券金融", "金融租賃")),
    ("清潔費", ("清潔服務", "建築物一般清潔", "廢棄物處理")),
)


def parse_left(code: Column) -> Column:
    """The fixed-width half of an invoice code as a struct, null unless it is one."""
    buyer = F.substring(code, 38, 8)
    fields = F.struct(
        F.substring(code, 1, 10).alias("invoice_number"),
        B.era_date(F.substring(code, 11, 7)).alias("date"),
        F.substring(code, 18, 4).alias("random_code"),
        B.hex_amount(F.substring(code, 22, 8)).alias("amount_untaxed"),
        B.hex_amount(F.substring(code, 30, 8)).alias("amount_total"),
        F.nullif(buyer, F.lit("00000000")).alias("buyer_vat"),
        F.substring(code, 46, 8).alias("seller_vat"),
    )
    return F.when((F.length(code) >= CODE_CHARS) & F.substring(code, 1, 10).rlike("^[A-Z]{2}[0-9]{8}$"), fields)


def parse_items(code: Column) -> Column:
    """Item names of the other half: the official layout, or triples of name, number and price; null if neither."""
    parts = F.split(code, ":", -1)
    official = parts[0].rlike(r"^\*\*\d+$") & (F.size(parts) >= 7) & F.get(parts, F.lit(1)).rlike(r"^\d+$") & F.get(parts, F.lit(2)).isin("0", "1")
    names = F.filter(F.transform(F.slice(parts, 7, F.greatest(F.size(parts) - 6, F.lit(0))), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("**"))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.sequence(F.lit(0), F.floor(F.size(rest) / 3).cast("int") - 1)
    triple = F.transform(at, lambda k: F.struct(F.trim(F.get(rest, k * 3)).alias("name"), F.trim(F.get(rest, k * 3 + 1)).try_cast("double").alias("n"), F.trim(F.get(rest, k * 3 + 2)).try_cast("double").alias("price")))
    whole = (parts[0] == "**") & (F.size(rest) >= 3) & (F.size(rest) % 3 == 0)
    fine = F.forall(triple, lambda t: (t["name"] != "") & t["n"].isNotNull() & t["price"].isNotNull())
    official_names = F.when(official & (F.get(parts, F.lit(2)) == "0") & (F.size(names) > 0), names)
    return F.coalesce(official_names, F.when(whole, F.when(fine, F.transform(triple, lambda t: t["name"]))))


def classify_codes(codes: DataFrame, code_col: str = "qr_text") -> DataFrame:
    """Each code with its kind (invoice, items, unknown) and what was parsed."""
    out = codes.withColumn("invoice", parse_left(F.col(code_col))).withColumn("items", parse_items(F.col(code_col)))
    return out.withColumn("kind", F.when(F.col("invoice").isNotNull(), "invoice").when(F.col("items").isNotNull(), "items").otherwise("unknown"))


def code_stats(classified: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, total, left_qr_count, right_qr_count, unknown_count): what the codes of each scan were."""
    kinds = {"left_qr_count": "invoice", "right_qr_count": "items", "unknown_count": "unknown"}
    return classified.groupBy(batch).agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == kind).alias(name) for name, kind in kinds.items()))


#: How many rules of one's own are taken, and how many words of a rule.
OWN_RULES, RULE_WORDS = 200, 20


def own_rules(rules: Sequence[tuple[str, Sequence[str]]]) -> list[tuple[str, tuple[str, ...]]]:
    """A user's rules (subject, words) as they are applied: blanks and repeats dropped, rules without words left out."""
    tidy = [(subject.strip(), tuple(dict.fromkeys(w.strip() for w in words if w.strip()))) for subject, words in rules]
    kept = [(subject, words) for subject, words in tidy if subject and words]
    if len(kept) > OWN_RULES or any(len(words) > RULE_WORDS for _, words in kept):
        raise ValueError(f"at most {OWN_RULES} rules of {RULE_WORDS} words each")
    return kept


def pair_items(invoices: DataFrame, items: DataFrame, batch: str = "batch_id", pos: str = "pos") -> DataFrame:
    """The k-th item list of a batch goes to its k-th invoice; lists left over have no invoice."""
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(pos))
    left = invoices.withColumn("_k", rank)
    right = items.select(batch, pos, F.col("items")).withColumn("_k", rank).drop(pos)
    return left.drop("items").join(right, [batch, "_k"], "full_outer").drop("_k")


def deduplicate(fresh: DataFrame, stored: DataFrame | None = None, key: str = "invoice_number", owner: str = "user_key", order: str = "scanned_at", cap: int | None = BUFFER_ROWS) -> DataFrame:
    """New rows of each owner whose key is neither stored nor earlier in the batch; rows without key are never duplicates.

    ``cap`` is the buffer's size, a feature of it; None keeps all.
    """
    keyed = F.coalesce(F.trim(key), F.lit("")) != ""
    if stored is not None:
        fresh = fresh.join(stored.filter(keyed).select(owner, key).distinct(), [owner, key], "left_anti")
    once = fresh.filter(keyed).withColumn("_n", F.row_number().over(Window.partitionBy(owner, key).orderBy(order))).filter("_n = 1").drop("_n")
    out = once.unionByName(fresh.filter(~keyed))
    if cap is None:
        return out
    full = stored.groupBy(owner).agg(F.count("*").alias("_held")) if stored is not None else None
    out = out.join(full, owner, "left") if full is not None else out.withColumn("_held", F.lit(0))
    place = F.row_number().over(Window.partitionBy(owner).orderBy(order, F.col(key).asc_nulls_last()))
    return out.withColumn("_place", place).filter(F.col("_place") + F.coalesce("_held", F.lit(0)) <= cap).drop("_place", "_held")


def enrich(invoices: DataFrame, registry: DataFrame) -> DataFrame:
    """Seller's registry fields; the invoice's own name stays where the registry has none."""
    r = registry.select(F.col("vat").alias("_vat"), F.col("name").alias("_name"), F.col("address").alias("seller_address"), F.col("industries").alias("seller_industries"))
    joined = invoices.join(r, invoices.seller_vat == F.col("_vat"), "left")
    own = F.col("seller_name") if "seller_name" in invoices.columns else F.lit(None).cast("string")
    return joined.withColumn("seller_name", F.coalesce(F.nullif("_name", F.lit("")), own)).drop("_vat", "_name")


def account_subject(industries: Column, name: Column, custom: Sequence[tuple[str, tuple[str, ...]]] = (), name_rules: Sequence[tuple[str, tuple[str, ...]]] = (), industry_rules: Sequence[tuple[str, tuple[str, ...]]] = INDUSTRY_RULES) -> Column:
    """(subject, source) of the first rule that fits: own rules, then industries, then names. One CASE, no join."""
    out = F.lit(None).cast("struct<subject:string,source:string>")
    ordered: list[tuple[Column, str, str]] = []
    for subject, words in own_rules(custom):
        for word in words:
            ordered += [(industries.contains(word), subject, "custom-industries"), (name.contains(word), subject, "custom-name")]
    for source, column, rules in (("industries", industries, industry_rules), ("name", name, name_rules)):
        for subject, words in rules:
            ordered.append((column.rlike("|".join(rf"\Q{w}\E" for w in words)), subject, source))
    for hit, subject, source in reversed(ordered):
        out = F.when(hit, F.struct(F.lit(subject).alias("subject"), F.lit(source).alias("source"))).otherwise(out)
    return out


def reclassified(before: DataFrame, after: DataFrame, key: str = "invoice_number") -> DataFrame:
    """(total, classified, changed) of a second classification."""
    joined = after.select(key, F.col("subject").alias("new")).join(before.select(key, F.col("subject").alias("old")), key, "left")
    return joined.agg(F.count("*").alias("total"), F.count("new").alias("classified"), F.count_if(~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))


def attach_items(invoices: DataFrame, items: DataFrame, owner: str = "user_key", order: str = "scanned_at") -> DataFrame:
    """Item lists go to the owner's latest invoice; names it has already aren't repeated."""
    # of invoices scanned at one time the first number counts; names keep the order in which they were given
    first = Window.partitionBy(owner).orderBy(F.desc(order), "invoice_number")
    latest = invoices.select(owner, "invoice_number", F.row_number().over(first).alias("_n")).filter("_n = 1").drop("_n")
    given = items.select(owner, F.posexplode("items").alias("_k", "item"), *([F.col(order).alias("_at")] if order in items.columns else [F.lit(0).alias("_at")]))
    merged = given.groupBy(owner).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_k", "item"))), lambda x: x["item"])).alias("more"))
    joined = invoices.join(latest.join(merged, owner), [owner, "invoice_number"], "left")
    return joined.withColumn("items", F.when(F.col("more").isNull(), F.col("items")).otherwise(F.array_union(F.coalesce("items", F.array().cast("array<string>")), "more"))).drop("more")


def export_columns(catalogue: Sequence[dict], order: Sequence[str] = (), visible: Sequence[str] = (), labels: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(id, label) of the columns to export: the order's known and visible ones, the default ones if none is named."""
    known = {c["id"]: c for c in catalogue}
    shown = set(visible) or {i for i, c in known.items() if c.get("default_visible", True)}
    ids = [i for i in order if i in known and i in shown] or [c["id"] for c in sorted(catalogue, key=lambda c: c.get("default_order", 0)) if c["id"] in shown]
    return [(i, ((labels or {}).get(i, "").strip() or known[i]["label"])[:64]) for i in ids]


def export_rows(invoices: DataFrame, columns: Sequence[tuple[str, str]], order: str = "scanned_at") -> DataFrame:
    """The chosen columns under their labels, with the computed ones: seq, tax, items."""
    out = invoices
    if any(i == "seq" for i, _ in columns):
        in_time = invoices.schema[order].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
        group = F.date_format(order, "yyyy-MM-dd") if in_time else F.lpad(F.floor(F.col(order) / 100_000).cast("string"), 20, "0")
        out = numbered(invoices, "seq", group, order, "invoice_number")
    out = out.withColumn("tax", F.col("amount_total") - F.col("amount_untaxed"))
    if "items" in out.columns:
        out = out.withColumn("items", F.array_join("items", " / "))
    return out.select(*[F.col(i).alias(label) for i, label in columns])
