"""Findings across documents: entities, amounts, dates, duplicates, outliers, severities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import checks
from paperloom.functions import text as T
from paperloom.operators.segments import labels_normalised

LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Fixed values: (kind, expression, shortest, longest) of the entities in business texts.
ENTITIES: tuple[tuple[str, str, int, int], ...] = (
    ("company", r"([A-Za-z0-9一-鿿·]+?(?:股份有限公司|有限公司|企業社|商號|行號|工作室|事務所|診所|醫院|診療所))", 4, 40),
    ("government", r"([一-鿿]{2,8}?(?:部|處|局|署|委員會|廳|院|公所|縣政府|市政府|衛生所))", 3, 20),
    ("school", r"([一-鿿]{2,15}?(?:大學|學院|高中|高級中學|國中|國民中學|國小|國民小學|附小|附中))", 4, 30),
    ("legal_person", r"((?:財團法人|社團法人)[一-鿿]{2,15})", 6, 30),
    ("tax_id", rf"{LEFT}([0-9]{{8}}){RIGHT}", 8, 8),
    ("case_number", rf"{LEFT}([A-Z]{{2,5}}-?[0-9]{{2,4}}-?[0-9]{{2,8}}){RIGHT}", 1, 100),
    ("date", rf"{LEFT}(20[0-9]{{2}}[-/.年]\s*[0-9]{{1,2}}[-/.月]\s*[0-9]{{1,2}}|[0-9]{{1,3}}[年]\s*[0-9]{{1,2}}[月]\s*[0-9]{{1,2}}[日])", 1, 100),
)
RATIOS = (10, 100, 1000)
LEAST_AMOUNT = 10_000


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, value, n): entities of each document; one pass over the text, one partial count a task."""

    def of_kind(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all(docs[text_col], F.lit(pattern), 1)
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), T.without_space(v).alias("value")))

    found = [of_kind(k, p) for k, p, _, _ in ENTITIES]
    rows = docs.select(docs[id_col], F.explode(F.concat(*found)).alias("e")).select(id_col, "e.*")
    fits = reduce(lambda a, b: a | b, [(F.col("kind") == F.lit(k)) & F.length("value").between(low, high) for k, _, low, high in ENTITIES])
    return rows.filter(fits).groupBy(id_col, "kind", "value").agg(F.count("*").alias("n"))


def across_files(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(kind, value, total_count, file_count): how often and in how many files."""
    return found.groupBy("kind", "value").agg(F.sum("n").alias("total_count"), F.count(id_col).alias("file_count"))


def entity_files(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(kind, value, file, n, total_count): the files of each entity, a row each, so that an entity of all files is no group."""
    total = found.groupBy("kind", "value").agg(F.sum("n").alias("total_count"))
    return found.join(total, ["kind", "value"]).select("kind", "value", F.col(id_col).alias("file"), "n", "total_count")


def outliers(totals: DataFrame) -> DataFrame:
    """Values of few files beside a kind's leading one: at most half of its files, or one file. A kind's leader is an
    aggregate, so that a kind of very many values is no task of its own."""
    lead = F.min(F.struct(-F.col("file_count"), -F.col("total_count"), F.col("value"))).alias("lead")
    leaders = totals.groupBy("kind").agg(F.max("file_count").alias("top_files"), lead).select(F.col("kind").alias("_kind"), F.col("lead.value").alias("top_value"), "top_files")
    ranked = totals.join(leaders, F.col("kind").eqNullSafe(F.col("_kind"))).drop("_kind")
    few = (F.col("file_count") <= F.floor(F.col("top_files") / 2)) | ((F.col("file_count") == 1) & (F.col("top_files") >= 2))
    return ranked.filter((F.col("value") != F.col("top_value")) & (F.col("top_files") >= 2) & few)


def amounts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, amount): distinct amounts from ten thousand up; decimals are cut off."""
    numbers = F.transform(F.regexp_extract_all(docs[text_col], F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), 0), lambda v: F.regexp_replace(F.regexp_replace(v, r"\..*$", ""), ",", "").try_cast("long"))
    return docs.select(docs[id_col], F.explode(F.array_distinct(F.filter(numbers, lambda v: v >= LEAST_AMOUNT))).alias("amount"))


def digit_shifts(found: DataFrame, id_col: str = "doc_id", value: str = "amount") -> DataFrame:
    """(low, high, ratio): amounts of different files that differ by a power of ten; three equi-joins, not a theta join."""
    per_value = found.groupBy(F.col(value).alias("v")).agg(F.min(id_col).alias("first_file"), F.max(id_col).alias("last_file"))
    b = per_value.select(F.col("v").alias("high"), F.col("first_file").alias("fb"), F.col("last_file").alias("lb"))
    shifted = per_value.select("v", "first_file", "last_file", F.explode(F.array(*[F.lit(r).cast("long") for r in RATIOS])).alias("ratio")).withColumn("high", F.col("v") * F.col("ratio"))
    # the same single file on both sides is no finding
    other = (F.col("first_file") != F.col("fb")) | (F.col("last_file") != F.col("lb")) | (F.col("first_file") != F.col("last_file"))
    return shifted.join(b, "high").filter(other).select(F.col("v").alias("low"), "high", "ratio")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, n, first): groups of equal content."""
    return docs.groupBy(F.sha2(docs[text_col].cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(id_col).alias("first")).filter("n > 1")


def severity_score(findings: DataFrame, by: str = "case_id", severity: str = "severity") -> DataFrame:
    """(by, fails, warns, infos, score): 100 less 10 a fail and 3 a warning, never below 0."""
    out = findings.groupBy(by).agg(*[F.count_if(F.col(severity) == s).alias(f"{s}s") for s in ("fail", "warn", "info")])
    return out.withColumn("score", F.greatest(F.lit(0), 100 - 10 * F.col("fails") - 3 * F.col("warns")))


def apply_overrides(findings: DataFrame, overrides: DataFrame, key: str = "finding_key") -> DataFrame:
    """Overridden findings become infos and keep what they were."""
    o = overrides.select(F.col(key).alias("_key")).distinct()
    joined = findings.join(o, findings[key] == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    return joined.withColumn("original_severity", F.when(hit, F.col("severity"))).withColumn("severity", F.when(hit, "info").otherwise(F.col("severity"))).drop("_key")


def fuzzy_matches(left: DataFrame, right: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b, distance): edit distance at most 3 and under 40 % of the shorter.

    A name of b is cut into limit + 1 pieces; within so many edits one piece is found in a unchanged, at most ``limit`` places
    off. Candidates meet by an equi-join on length, piece and place; names shorter than that meet by length alone, of which
    there are few.
    """
    pieces = limit + 1
    cut = lambda k, n: F.floor(k * n / pieces).cast("int")
    b = right.select(F.col("name").alias("b")).distinct().withColumn("n", F.length("b"))
    parts = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).withColumn("at", cut(F.col("k"), F.col("n")))
    parts = parts.withColumn("piece", F.when(F.col("n") < pieces, "").otherwise(F.substring(F.col("b"), F.col("at") + 1, cut(F.col("k") + 1, F.col("n")) - F.col("at"))))
    parts = parts.filter("n >= 4 OR k = 0").select("b", "n", "k", "piece")
    a = left.select(F.col("name").alias("a")).distinct().withColumn("len", F.length("a")).withColumn("n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("len") - limit), F.col("len") + limit)))
    a = a.withColumn("k", F.explode(F.when(F.col("n") < pieces, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(pieces - 1))))).withColumn("at", cut(F.col("k"), F.col("n"))).withColumn("size", cut(F.col("k") + 1, F.col("n")) - F.col("at"))
    starts = F.when(F.col("n") < pieces, F.array(F.lit(0))).otherwise(F.sequence(F.greatest(F.lit(0), F.col("at") - limit), F.col("at") + limit))
    a = a.withColumn("from", F.explode(starts)).withColumn("piece", F.when(F.col("n") < pieces, "").otherwise(F.substring(F.col("a"), F.col("from") + 1, F.col("size")))).select("a", "len", "n", "k", "piece").distinct()
    met = a.join(parts, ["n", "k", "piece"]).select("a", "b", "len", "n").distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", limit)).filter((F.col("distance") > 0) & (F.col("distance") < 0.4 * F.least("len", "n"))).select("a", "b", "distance")


def contained_names(found: DataFrame, own: list[str], value: str = "value") -> DataFrame:
    """Rows whose value contains an own name or is contained in one, white space aside; ``own`` is a setting, a short list."""
    plain = T.without_space(F.col(value))
    hits = [plain.contains(n) | F.lit(n).contains(plain) for n in ("".join(o.split()) for o in own) if n]
    return found.filter(reduce(lambda a, b: a | b, hits, F.lit(False)))


def consensus(corrections: DataFrame, key: str = "key", round_col: str = "round") -> DataFrame:
    """Corrections that every round but the first has made."""
    rounds = corrections.filter(F.col(round_col) > 1)
    n = rounds.agg(F.countDistinct(round_col).alias("n"))
    return rounds.groupBy(key).agg(F.countDistinct(round_col).alias("seen")).join(F.broadcast(n), F.col("seen") == F.col("n")).select(key)


def expand_references(profile: DataFrame, key: str = "key", value: str = "value", depth: int = 5) -> DataFrame:
    """Values that name another key (``同X``) replaced by its value; a circle keeps the text as it is."""
    out = profile
    for _ in range(depth):
        target = F.regexp_extract(out[value], "^同(.+)$", 1)
        named = profile.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
        out = out.join(named, (target == F.col("_k")) & (F.col("_k") != out[key]), "left").select(key, F.coalesce(F.nullif("_v", F.lit("")), value).alias(value))
    return out


def declared_attachments(docs: DataFrame, actual: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, declared, actual, mismatch): the highest attachment number named, in digits or Chinese numerals up to ten."""
    numerals = F.create_map(*[F.lit(x) for kv in zip("一二三四五六七八九十", range(1, 11)) for x in kv])
    found = F.regexp_extract_all(docs[text_col], F.lit(r"附件\s*([0-9]{1,3}|[一二三四五六七八九十])"), 1)
    declared = F.coalesce(F.array_max(F.transform(found, lambda v: F.coalesce(v.try_cast("int"), F.element_at(numerals, v)))), F.lit(0))
    return docs.select(docs[id_col], declared.alias("declared"), actual.alias("actual")).withColumn("mismatch", (F.col("declared") > 0) & (F.abs(F.col("declared") - F.col("actual")) > 1))


def expiring(dates: DataFrame, today: Column, days: int, column: str = "day") -> DataFrame:
    """Days to come before the deadline; past ones aren't reported."""
    return dates.filter((F.col(column) > today) & (F.col(column) < F.date_add(today, days)))


def dashboard(cases: DataFrame, findings: DataFrame, since: Column) -> DataFrame:
    """(kind, value, n): cases by state and findings by category, of cases since a time; average score in tenths."""
    fresh = cases.filter(F.col("created_at") >= since)
    by_state = fresh.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("status").alias("kind"), F.col("status").alias("value"), "n")
    top = findings.join(fresh.select("case_id"), "case_id").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(10)
    score = fresh.agg(F.round(F.avg("score") * 10).cast("long").alias("n")).select(F.lit("score_tenths").alias("kind"), F.lit("avg").alias("value"), "n")
    return by_state.union(top.select(F.lit("category"), "category", "n")).union(score)


def case_board(cases: DataFrame, findings: DataFrame, since: Column) -> DataFrame:
    """(kind, value, n): the dashboard with files, layers and severities as well, of cases (case_id, status, score, created_at,
    n_files, layers) and their findings (case_id, category, severity). Null counts of files and null layers count nothing."""
    fresh = cases.filter(F.col("created_at") >= since)
    row = lambda kind, value, n: (F.lit(kind).alias("kind"), value.alias("value"), n.cast("long").alias("n"))
    files = fresh.agg(F.sum(F.coalesce("n_files", F.lit(0))).alias("n")).select(*row("files_total", F.lit("all"), F.coalesce("n", F.lit(0))))
    layers = fresh.select(F.explode("layers").alias("layer")).groupBy("layer").agg(F.count("*").alias("n")).select(*row("layer", F.col("layer"), F.col("n")))
    found = findings.join(fresh.select("case_id"), "case_id").groupBy("severity").agg(F.count("*").alias("n")).select(*row("severity", F.col("severity"), F.col("n")))
    return dashboard(cases, findings, since).union(files).union(layers).union(found)


def merge_variants(groups: DataFrame, by: str = "group_id") -> DataFrame:
    """(by, value, total_count, files): spellings of one name as its longest one, counts summed, files united."""
    longest = F.max_by("value", F.struct(F.length("value"), F.col("value"))).alias("value")
    return groups.groupBy(by).agg(longest, F.sum("total_count").alias("total_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))


def finding_key(category: Column, evidence: Column, title: Column, page: Column) -> Column:
    """The same finding's key in every version of a case: its category and what identifies it; ``evidence`` is JSON."""
    of = lambda path: F.coalesce(F.get_json_object(evidence, f"$.{path}"), F.lit(""))
    metadata = F.array_join(F.array_sort(F.coalesce(F.json_object_keys(of("metadata")), F.array().cast("array<string>"))), ",")
    known = {
        "tax-id-mismatch": of("actual"),
        "tax-id-invalid": F.coalesce(F.nullif(of("tax_id"), F.lit("")), of("value")),
        "identity-mismatch": of("actual"),
        "identity-outlier": of("outlier"),
        "metadata-leak": metadata,
        "duplicate-hash": F.left(of("sha256"), F.lit(16)),
        "template-residue": F.left(of("file_id"), F.lit(8)),
    }
    own = F.concat(F.left(F.coalesce(title, F.lit("")), F.lit(50)), F.lit(":"), F.coalesce(page.cast("string"), F.lit("")))
    for name, value in known.items():
        own = F.when(category == name, value).otherwise(own)
    return F.concat(category, F.lit(":"), own)


def tax_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, tax_id, valid): the eight-digit numbers of each text, each once, in order."""
    found = F.array_distinct(F.regexp_extract_all(docs[text_col], F.lit(rf"{LEFT}([0-9]{{8}}){RIGHT}"), 1))
    return docs.select(docs[id_col], F.posexplode(found).alias("place", "tax_id")).withColumn("valid", checks.business_id_valid(F.col("tax_id")))


def rule_findings(totals: DataFrame, main: str = "", main_id: str = "", counterparty: str = "", case_number: str = "", own_names: list[str] = (), own_ids: list[str] = ()) -> DataFrame:
    """(category, severity, kind, value, total_count, file_count) from the totals of a case and what is expected of it.

    With an expected party, other organisations are warnings unless they are the counterparty or one's own; an expected tax
    id or case number makes others findings. Without, several valid foreign tax ids are one warning. Eight digits without a
    valid checksum warn where they stand once, and inform where they are in use.
    """
    plain = F.col("value")
    either = lambda name: plain.contains(name) | F.lit(name).contains(plain)
    known = [n for n in ("".join(x.split()) for x in [counterparty, *own_names]) if n]
    columns = ["kind", "value", "total_count", "file_count"]
    as_finding = lambda rows, category, severity: rows.select(F.lit(category).alias("category"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), *columns)
    parts = []
    if main:
        kinds = ["company", "legal_person", "school", *([] if counterparty else ["government"])]
        fine = reduce(lambda a, b: a | b, [either(n) for n in known], either("".join(main.split())))
        parts.append(as_finding(totals.filter(F.col("kind").isin(kinds) & ~fine), "identity-mismatch", "warn"))
    ids = totals.filter("kind = 'tax_id'")
    valid = checks.business_id_valid(plain)
    if main_id:
        parts.append(as_finding(ids.filter(plain != main_id), "tax-id-mismatch", "warn"))
    else:
        foreign = ids.filter(valid & ~plain.isin([str(x) for x in own_ids])) if own_ids else ids.filter(valid)
        # a row for each of several ids: their number is bounded by nothing
        several = foreign.agg(F.count("*").alias("n")).filter("n >= 2")
        parts.append(as_finding(foreign.join(F.broadcast(several), F.lit(True)), "tax-id-multiple", "warn"))
    used = (F.col("file_count") >= 2) | (F.col("total_count") >= 3)
    parts.append(as_finding(ids.filter(~valid), "tax-id-invalid", F.when(used, "info").otherwise("warn")))
    if case_number:
        parts.append(as_finding(totals.filter((F.col("kind") == "case_number") & (plain != case_number)), "case-num-other", "info"))
    return reduce(DataFrame.unionByName, parts)


#: What stands for "the same as above", and what a named reference begins and ends with.
DITTO = ("同上", "同前", "如上", "同上述", "同前述", "同左", "同右", "同上欄", "同左列", "同上所述", "略同上", "ditto", "同", "〃", "″", "”", '"')
REFERENCE_START, REFERENCE_END = ("同", "與", "如"), ("相同", "同", "一致", "者同")
NOWHERE = ("上", "前", "左", "右")


def resolve_references(profile: DataFrame, labels: DataFrame, sources: dict[str, str], by: str = "owner") -> DataFrame:
    """(by, key, value, source): values that refer to another one (同上, 同登記地址) replaced by it.

    ``labels`` (label, key) names keys, ``sources`` says which key a bare ditto under a key means. A target that is empty or
    itself a reference, one's own key, or an unknown name leaves the value as it is; nothing becomes blank.
    """
    clean = F.regexp_replace(F.coalesce("value", F.lit("")), r"(?U)^\s+|\s+$", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"^[（()）\[\]［］{}｛｝「」『』<>《》]+|[（()）\[\]［］{}｛｝「」『』<>《》]+$", ""), r"(?U)^\s+|\s+$", "")
    rows = profile.select(by, "key", "value").withColumn("clean", clean).withColumn("bare", F.col("clean").isin(*DITTO))
    body = F.regexp_replace(F.substring(F.col("clean"), 2, 2**31 - 1), r"(?U)^\s+|\s+$", "")
    for end in REFERENCE_END:
        body = F.when(body.endswith(end) & (F.length(body) > len(end)), F.rtrim(F.left(body, F.length(body) - len(end)))).otherwise(body)
    named = ~F.col("bare") & F.left(F.col("clean"), F.lit(1)).isin(*REFERENCE_START) & (F.length(body) >= 2) & ~body.isin(*NOWHERE)
    rows = rows.withColumn("label", F.when(named, labels_normalised(body)))
    index = labels.groupBy(labels_normalised(F.col("label")).alias("label")).agg(F.max("key").alias("named_key"))
    rows = rows.join(index, "label", "left")
    pair = F.element_at(F.create_map(*[F.lit(x) for kv in sources.items() for x in kv]), F.col("key")) if sources else F.lit(None).cast("string")
    wanted = F.when(F.col("label").isNotNull(), F.when(F.col("named_key") != F.col("key"), F.col("named_key"))).when(F.col("bare"), pair)
    is_reference = (F.col("clean") != "") & (F.length("clean") <= 20) & (F.col("bare") | F.col("named_key").isNotNull())
    given = rows.filter(~is_reference & (F.trim(F.coalesce("value", F.lit(""))) != "")).select(by, F.col("key").alias("wanted"), F.trim("value").alias("given"))
    asked = rows.withColumn("wanted", wanted).join(given, [by, "wanted"], "left")
    return asked.select(by, "key", F.coalesce("given", "value").alias("value"), F.when(F.col("given").isNotNull(), F.col("wanted")).alias("source"))
