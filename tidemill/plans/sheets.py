"""Sheets: classification, sections, candidate observations with their quality codes, header blocks and labels.

Grids are frames of (file, sheet, row_number, cells) as the workbook reader gives them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.catalog import query, read_table
from tidemill.functions.identity import identity_observation, row_hash
from tidemill.functions.parse import parse_fee, parse_number
from tidemill.functions.pii import suppressed
from tidemill.functions.text import ERROR_LITERALS, bound, codes, compact, contains_any, is_nonempty, normalized, safe_text
from tidemill.operators.reconcile import code_frequency

#: Weights of the words that make a candidate header.
SIGNALS = {
    "tiktok": (["tiktok"], 3), "follower": (["follower"], 3), "engagement": (["engagement", "engangement"], 2), "budget": (["budget", "buget"], 2),
    "selection": (["เลือก", "คอนเฟิร์ม", "confirm"], 1), "influencer": (["influencer", "อินฟลูเอนเซอร์"], 1),
}
LEAST_SCORE = 8
#: Sheet types by parts of a sheet's name, in order.
NAME_RULES = [
    ("ads", ["ads"]), ("sales_gmv", ["gmv"]), ("live", ["live", "livesteaming"]), ("campaign_price", ["price", "campagine price", "ค่าธรรมเนียม"]), ("shipment", ["เบิกสินค้า", "สำหรับการข"]),
    ("monthly_performance", ["report oct", "report nov", "report dec"]), ("performance", ["report influencer", "report kols", "report review"]),
    ("content_timeline", ["content", "timeline", "revise", "script", "artwork", "โพส คอนเทนต์", "รายละเอียดคอนเทนต์"]),
]
FALLBACK = "other_operations"
#: Header words of the candidate columns, and of columns with personal data.
IDENTITY_TERMS = ["influencer", "tiktok", "link tiktok"]
FIELDS = {
    "follower_raw": ["follower"], "engagement_raw": ["engagement", "engangement"], "budget_raw": ["budget", "buget"], "historical_sales_raw": ["ยอดขาย", "kalodata"], "audience_gender_raw": ["เพศผู้ติดตาม"],
    "audience_age_raw": ["อายุผู้ติดตาม", "อายุผุ้ติดตาม"], "selected_raw": ["เลือก"], "confirmed_raw": ["คอนเฟิร์ม", "confirm"], "pet_type_raw": ["pet", "สัตว์เลี้ยง"],
}
PII_TERMS = ["ที่อยู่", "เบอร์", "โทร", "เลขพัสดุ", "tracking", "dhl"]
STRUCTURE_WORDS = ["link", "tiktok", "lemon8", "script", "budget", "buget", "engagement", "engangement", "ลงโพส", "videoview"]
CONTEXT_WORDS = ["tier", "nano", "micro", "koc", "kol", "affiliate", "followers", "กลุ่มที่"]
#: Header words of deliverable and performance sheets, and of periods in labels.
SYNONYMS = {
    "identity": ["influencer", "kols name", "kol name", "บัญชี tiktok"], "post_url": ["ลิงค์โพส", "ลิงค์โพสต์", "link post", "post link"], "draft_url": ["ลิงค์ดราฟ", "ลิ้งค์ดราฟ", "link draft"],
    "posted_date": ["วันที่ลงโพสต์", "วันลงโพสต์"], "schedule_date": ["กำหนดการลงโพส", "กำหนดการ", "วันลง"], "confirmed": ["คอนเฟิร์ม", "confirm"], "posted": ["ลงโพส", "ลงโพสต์"], "gencode": ["รหัสเจนโค้ด", "gencode", "gen code"],
    "ad_status": ["status ads", "ads status"], "product": ["รีวิวสินค้า", "สินค้า", "product"], "views": ["videoview", "video view", "ยอดวิว"], "likes": ["like", "การถูกใจ"], "comments": ["comment", "ความคิดเห็น"], "saves": ["save"],
    "shares": ["shared", "share", "แชร์"], "gmv": ["gmv"], "sales": ["ยอดขาย"], "orders": ["ออเดอร์", "order", "คำสั่งซื้อ"], "traffic": ["traffic", "การเข้าชม"], "viewers": ["ผู้ชม", "ผู้ชมทั้งหมด"], "ctr": ["ctr"],
    "cost": ["ต้นทุน", "งบแอดใช้จริง", "ค่าแอด"], "revenue": ["รายได้ขั้นต้น", "revenue"], "roi": ["roi"], "roas": ["roas"], "impressions": ["impressions", "ยอดการแสดงผล"], "clicks": ["click", "ยอดการคลิก"],
}
INFLUENCER_EVIDENCE = ["post_url", "posted_date", "gencode", "views", "likes", "product", "confirmed"]
PERFORMANCE_EVIDENCE = ["sales", "orders", "traffic", "viewers", "views", "revenue", "gmv", "roi", "roas", "cost", "impressions"]
PERIOD_WORDS = ["ตุลาคม", "พฤศจิกายน", "ธันวาคม", "oct", "nov", "dec", "เดือน 1", "เดือน 2", "เดือน 3", "เดือน 4"]


def texts(cells: Column) -> Column:
    """The cells' texts; null where a cell is empty."""
    return F.transform(cells, lambda c: c["s"])


def row_text(values: Column) -> Column:
    return F.array_join(F.transform(F.filter(values, lambda v: v.isNotNull()), normalized), " | ")


def signal_hits(values: Column) -> dict[str, Column]:
    """Whether each signal is in a row; selection words in Thai are looked for with spaces kept."""
    text = row_text(values)
    dense = F.regexp_replace(text, r"(?U)\s+", "")
    return {name: contains_any(dense, words) | (contains_any(text, words[:2]) if name == "selection" else F.lit(False)) for name, (words, _) in SIGNALS.items()}


def header_score(values: Column) -> Column:
    return reduce(add, [F.when(hit, SIGNALS[name][1]).otherwise(0) for name, hit in signal_hits(values).items()])


def header_signature(values: Column) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in signal_hits(values).items()]))


def is_candidate_header(values: Column) -> Column:
    hits = signal_hits(values)
    return (header_score(values) >= LEAST_SCORE) & hits["tiktok"] & hits["follower"]


def is_influencer_header(values: Column) -> Column:
    """Any influencer table's header: it ends a section."""
    dense = F.regexp_replace(row_text(values), r"(?U)\s+", "")
    return contains_any(dense, ["influencer", "อินฟลูเอนเซอร์"]) & F.contains(dense, F.lit("follower")) & contains_any(dense, STRUCTURE_WORDS)


def classify(preview: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(file, sheet, sheet_type, confidence, basis, primary_header_row, detected_header_rows): an override, then a header, then the name, then the fallback."""
    v = texts(F.col("cells"))
    rows = preview.withColumns({"h": is_candidate_header(v), "score": header_score(v)})
    grouped = rows.groupBy("file", "sheet").agg(F.array_sort(F.collect_list(F.when(F.col("h"), F.struct(F.col("ord"), F.col("score"))))).alias("headers"))
    name = normalized(F.col("sheet"))
    rule = [F.when(F.contains(name, F.lit(p)), F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"))) for t, patterns in NAME_RULES for p in patterns]
    out = grouped.withColumns({"rule": F.coalesce(*rule), "first": F.try_element_at("headers", F.lit(1))})
    has, manual = F.col("first").isNotNull(), F.lit(None).cast("string")
    if overrides is not None:
        o = overrides.select(F.col("source_filename").alias("file"), F.col("sheet_name").alias("sheet"), F.col("sheet_type").alias("o_type"), "reason")
        out, manual = out.join(F.broadcast(o) if o.count() <= 100_000 else o, ["file", "sheet"], "left"), F.col("o_type")
    else:
        out = out.withColumn("reason", F.lit(None).cast("string"))
    return out.select(
        "file", "sheet", F.coalesce(manual, F.when(has, "influencer_candidate"), F.col("rule.t"), F.lit(FALLBACK)).alias("sheet_type"),
        F.when(manual.isNotNull() | has, "high").when(F.col("rule").isNotNull(), "medium").otherwise("low").alias("confidence"),
        F.when(manual.isNotNull(), F.concat(F.lit("manual override: "), F.col("reason"))).when(has, F.concat(F.lit("candidate header signature score="), F.col("first.score").cast("string")))
        .when(F.col("rule").isNotNull(), F.concat(F.lit("sheet-name rule: "), F.col("rule.p"))).otherwise("no candidate signature or known name rule").alias("basis"),
        F.when(manual.isNull(), F.col("first.ord")).alias("primary_header_row"), F.when(manual.isNull(), F.col("headers.ord")).alias("detected_header_rows"),
    )


def with_segments(rows: DataFrame, opens: Column, keys: list[str], order: str) -> DataFrame:
    """rows with header_row: the last row up to it where `opens` holds; rows before the first have none."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("header_row", F.last(F.when(opens, F.col(order)), ignorenulls=True).over(w))


def section_context(keys: list[str], order: str) -> Column:
    """Up to two of the 12 rows before with a context word, the oldest first."""
    values = texts(F.col("cells"))
    told = F.array_join(F.transform(F.filter(values, is_nonempty), safe_text), " | ")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-12, -1)
    lines = F.collect_list(F.when(contains_any(F.lower(told), CONTEXT_WORDS), told)).over(w)
    return F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 1), F.lit(2)), " || ")


def candidate_sections(grid: DataFrame) -> DataFrame:
    """Body rows of candidate sections, with their header's row and cells and the section's context."""
    keys, v = ["file", "sheet"], texts(F.col("cells"))
    marked = grid.withColumns({"candidate": is_candidate_header(v), "context": section_context(keys, "row_number")})
    marked = with_segments(marked, F.col("candidate") | is_influencer_header(v), keys, "row_number")
    headers = marked.where("candidate").select(*keys, "header_row", F.col("cells").alias("header"), F.col("context").alias("section_context_raw"))
    body = marked.where(F.col("row_number") > F.col("header_row")).drop("context", "candidate")
    return body.join(headers, [*keys, "header_row"])


def matching_columns(header: Column, terms: list[str]) -> Column:
    """Indices from 0 of header cells that hold a term, white space left out."""
    plain = [t.replace(" ", "") for t in terms]
    hits = F.transform(texts(header), lambda h, i: F.when(contains_any(compact(h), plain), i))
    return F.filter(hits, lambda i: i.isNotNull())


def first_value(cells: Column, columns: Column) -> Column:
    """The first cell that isn't empty among columns."""
    picked = F.transform(columns, lambda i: F.try_element_at(cells, i + 1))
    return F.try_element_at(F.filter(picked, lambda c: c.isNotNull() & is_nonempty(c["s"])), F.lit(1))


def quality_codes(handles: Column, follower: Column, engagement: Column, fee_model: Column, pii: Column) -> Column:
    """Codes of an observation, in order; follower and engagement are struct(raw, value)."""
    pair = lambda x, name: [(is_nonempty(x["raw"]) & x["value"].isNull(), f"DQ_{name}_INVALID"), (~is_nonempty(x["raw"]), f"DQ_{name}_MISSING")]
    return codes(
        (F.size(handles) == 0, "DQ_IDENTITY_UNPARSABLE"), (F.size(handles) > 1, "DQ_IDENTITY_CONFLICT"), *pair(follower, "FOLLOWER"), *pair(engagement, "ENGAGEMENT"),
        (fee_model == "unknown", "DQ_FEE_INVALID"), (fee_model == "pending", "DQ_FEE_PENDING"), (fee_model == "missing", "DQ_FEE_MISSING"), (pii, "DQ_PII_GUARD_SUPPRESSED"),
    )


def quality_status(found: Column) -> Column:
    error = F.arrays_overlap(found, F.array(F.lit("DQ_IDENTITY_UNPARSABLE"), F.lit("DQ_IDENTITY_CONFLICT"), F.lit("DQ_PII_GUARD_SUPPRESSED")))
    return F.when(error, "ERROR").when(F.size(found) > 0, "WARN").otherwise("PASS")


def candidate_observations(grid: DataFrame) -> DataFrame:
    """Observations of the candidate sections of sheets; personal values never leave, only the names of their columns."""
    rows = candidate_sections(grid)
    header, cells = F.col("header"), F.col("cells")
    raw = {name: first_value(cells, matching_columns(header, terms)) for name, terms in FIELDS.items()}
    identity_cells = F.transform(matching_columns(header, IDENTITY_TERMS), lambda i: F.try_element_at(cells, i + 1))
    # only texts are identities: numbers and truth values are ordinals and ticks
    plain = F.transform(F.filter(identity_cells, lambda c: c.isNotNull() & (c["t"] == "str")), lambda c: c["s"])
    rows = rows.withColumns({name: cell for name, cell in raw.items()} | {"identity": identity_observation(plain), "pii_columns": matching_columns(header, PII_TERMS)})
    s = lambda n: F.col(f"{n}.s")
    number = lambda n, percent=False: F.coalesce(F.col(f"{n}.n"), F.when(F.col(f"{n}.t") == "str", parse_number(s(n), percent)))
    fee = F.when(F.col("budget_raw.n").isNotNull(), F.struct(F.lit("fixed").alias("model"), F.col("budget_raw.n").alias("amount"), F.lit("campaign").alias("unit")))
    fee = fee.when(F.col("budget_raw.t") == "bool", F.struct(F.lit("unknown").alias("model"), F.lit(None).cast("double").alias("amount"), F.lit("").alias("unit"))).otherwise(parse_fee(s("budget_raw")))
    guarded = {n: suppressed(s(n)) for n in ("audience_gender_raw", "audience_age_raw", "selected_raw", "confirmed_raw", "pet_type_raw", "historical_sales_raw")}
    rows = rows.withColumns(
        {"follower": F.struct(s("follower_raw").alias("raw"), number("follower_raw").alias("value")), "engagement": F.struct(s("engagement_raw").alias("raw"), number("engagement_raw", True).alias("value")), "fee": fee, "sales": number("historical_sales_raw")}
        | {f"{n}_guarded": g for n, g in guarded.items()}
        | {"primary_guarded": suppressed(F.col("identity.primary_raw")), "secondary_guarded": suppressed(F.col("identity.secondary_raw"))}
    )
    any_pii = reduce(lambda a, b: a | b, [F.col(f"{n}_guarded.suppressed") for n in guarded] + [F.col("primary_guarded.suppressed"), F.col("secondary_guarded.suppressed")])
    evidence = (F.size("identity.handles") > 0) | F.col("engagement.value").isNotNull() | F.col("fee.model").isin("fixed", "barter", "free", "hourly") | F.col("sales").isNotNull()
    kept = rows.where((F.size("identity.raws") > 0) & (F.col("follower.value") >= 1) & evidence)
    found = quality_codes(F.col("identity.handles"), F.col("follower"), F.col("engagement"), F.col("fee.model"), any_pii)
    kept = kept.withColumns({"found": found, "any_pii": any_pii})
    whole = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    out = kept.select(
        F.col("file").alias("source_filename"), F.col("sheet").alias("source_sheet_name"), F.col("row_number").alias("source_row_number"), F.col("header_row").alias("source_section_header_row"), "section_context_raw",
        F.col("primary_guarded.text").alias("identity_primary_raw"), F.col("secondary_guarded.text").alias("identity_secondary_raw"), F.array_join("identity.handles", ";").alias("normalized_handle_candidates"),
        F.when(F.size("identity.handles") == 1, F.col("identity.handles")[0]).otherwise("").alias("canonical_handle_candidate"), safe_text(s("follower_raw")).alias("follower_raw"), F.col("follower.value").alias("follower_normalized"),
        whole(F.col("follower.value")).alias("follower_text"), safe_text(s("engagement_raw")).alias("engagement_raw"), F.col("engagement.value").alias("engagement_normalized"), safe_text(s("budget_raw")).alias("budget_raw"),
        F.col("fee.model").alias("fee_model"), F.col("fee.amount").alias("fee_amount_normalized"), F.col("fee.unit").alias("fee_unit"), F.col("sales").alias("historical_sales_normalized"),
        *[F.col(f"{n}_guarded.text").alias(n) for n in guarded], (F.size("pii_columns") > 0).alias("pii_present"), F.col("any_pii").alias("pii_guard_triggered"),
        F.array_join(F.transform("pii_columns", lambda i: safe_text(F.try_element_at(texts(header), i + 1))), ";").alias("pii_headers_present"), quality_status(F.col("found")).alias("dq_status"), F.array_join("found", ";").alias("dq_codes"),
    )
    return out.withColumn("source_row_hash", row_hash(*[F.col(c) for c in out.columns]))


def accepted_and_quarantined(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    return observations.where("dq_status <> 'ERROR'"), observations.where("dq_status = 'ERROR'")


def map_headers(values: Column) -> Column:
    """Map from a canonical field to its first column; one column may feed several fields."""
    entries = lambda plain: F.array(*[F.struct(F.lit(n).alias("k"), _first_index(plain, words).alias("v")) for n, words in SYNONYMS.items()])
    return F.map_from_entries(F.filter(bound(F.transform(values, normalized), entries), lambda e: e["v"].isNotNull()))


def _first_index(plain: Column, words: list[str]) -> Column:
    hits = F.filter(F.transform(plain, lambda h, i: F.when((h != "") & contains_any(h, words), i)), lambda i: i.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def header_kind(values: Column) -> Column:
    """influencer, performance, or null; an influencer header comes first."""
    n = lambda names, wanted: F.size(F.array_intersect(names, F.array(*[F.lit(w) for w in wanted])))
    kind = lambda x: F.when(F.array_contains(x, "identity") & (n(x, INFLUENCER_EVIDENCE) >= 2), "influencer").when(n(x, PERFORMANCE_EVIDENCE) >= 3, "performance")
    return bound(F.map_keys(map_headers(values)), kind)


def with_nearest_label(rows: DataFrame, name: str, keys: list[str], order: str) -> DataFrame:
    """rows with a label from the 68 rows before: the nearest period, then up to three short rows, the farthest first, without repeats.

    Each row takes what the last short row before it knows: itself, and the two before that one; so no list of rows is kept.
    """
    over = Window.partitionBy(*keys).orderBy(order)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    present = F.filter(F.transform(texts(F.col("cells")), safe_text), lambda v: v != "")
    label = F.array_join(present, " | ")
    usable = (F.size(present) >= 1) & (F.size(present) <= 2) & ~contains_any(label, ERROR_LITERALS)
    short = rows.withColumn("__n", F.row_number().over(over)).withColumn("__short", F.when(usable, F.struct(F.col("__n").alias("n"), label.alias("text"))))
    is_period = contains_any(normalized(F.col("__short.text")), PERIOD_WORDS)
    own = lambda c: F.when(F.col("__short").isNotNull(), F.col(c))
    told = short.withColumns({"__1": F.last("__short", ignorenulls=True).over(before), "__period": F.last(F.when(is_period, F.col("__short")), ignorenulls=True).over(before)})
    told = told.withColumn("__2", F.last(own("__1"), ignorenulls=True).over(before)).withColumn("__3", F.last(own("__2"), ignorenulls=True).over(before))
    near = [F.when(F.col(f"{c}.n") >= F.col("__n") - 68, F.col(f"{c}.text")) for c in ("__period", "__3", "__2", "__1")]
    return told.withColumn(name, F.array_join(F.array_distinct(F.array_compact(F.array(*near))), " || ")).drop("__n", "__short", "__period", "__1", "__2", "__3")


def next_nonempty(values: Column, index: int | Column) -> Column:
    """The first text to the right of a cell's index from 0."""
    rest = F.slice(values, F.lit(index) + 2, F.size(values))
    return F.try_element_at(F.filter(F.transform(rest, safe_text), lambda v: v != ""), F.lit(1))


# --- queries ----------------------------------------------------------------------------------------------------


@query(
    "classify_score",
    """WITH t AS (SELECT doc_id, regexp_replace(lower(source || ' | ' || CASE doc_id % 4 WHEN 0 THEN 'Link TikTok | Follower | Engangement' WHEN 1 THEN 'Tik Tok | Buget | Confirm' WHEN 2 THEN 'Influencer | TikTok | Followers | Budget' ELSE lang END), '\\s+', '', 'g') AS c FROM documents)
    SELECT doc_id, CAST(CASE WHEN c LIKE '%tiktok%' THEN 3 ELSE 0 END + CASE WHEN c LIKE '%follower%' THEN 3 ELSE 0 END + CASE WHEN c LIKE '%engagement%' OR c LIKE '%engangement%' THEN 2 ELSE 0 END + CASE WHEN c LIKE '%budget%' OR c LIKE '%buget%' THEN 2 ELSE 0 END
      + CASE WHEN c LIKE '%confirm%' THEN 1 ELSE 0 END + CASE WHEN c LIKE '%influencer%' THEN 1 ELSE 0 END AS INTEGER) AS score FROM t""",
)
def score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    header = lambda *names: F.array(*[F.lit(n) for n in names])
    rest = F.when(k == 0, header("Link TikTok", "Follower", "Engangement")).when(k == 1, header("Tik Tok", "Buget", "Confirm")).when(k == 2, header("Influencer", "TikTok", "Followers", "Budget")).otherwise(F.array("lang"))
    return read_table(spark, sf_dir, "documents").select("doc_id", header_score(F.concat(F.array("source"), rest)).alias("score"))


@query("first_value_coalesce", "SELECT o_orderkey, coalesce(nullif(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN '-' WHEN o_orderkey % 3 = 1 THEN ' ' ELSE o_orderstatus END), '-'), ''), o_orderpriority) AS first_value FROM orders")
def first_value_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    cell = lambda c: F.struct(F.lit("str").alias("t"), c.alias("s"))
    cells = F.array(cell(F.when(k == 0, "-").when(k == 1, " ").otherwise(F.col("o_orderstatus"))), cell(F.lit(None).cast("string")), cell(F.col("o_orderpriority")))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", first_value(cells, F.array(F.lit(0), F.lit(1), F.lit(2)))["s"].alias("first_value"))


DQ_SQL = """x AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS h, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE '12K' END AS f, CASE o_orderkey % 7 WHEN 0 THEN '-' ELSE '5%' END AS e,
  CASE o_orderkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'pending' WHEN 2 THEN 'unknown' ELSE 'fixed' END AS m, o_orderkey % 11 = 0 AS p FROM orders),
  c AS (SELECT k, concat_ws(';', CASE WHEN h = 0 THEN 'DQ_IDENTITY_UNPARSABLE' END, CASE WHEN h = 2 THEN 'DQ_IDENTITY_CONFLICT' END, CASE WHEN f = 'x' THEN 'DQ_FOLLOWER_INVALID' END, CASE WHEN f = '' THEN 'DQ_FOLLOWER_MISSING' END, CASE WHEN e = '-' THEN 'DQ_ENGAGEMENT_MISSING' END,
    CASE m WHEN 'unknown' THEN 'DQ_FEE_INVALID' WHEN 'pending' THEN 'DQ_FEE_PENDING' WHEN 'missing' THEN 'DQ_FEE_MISSING' END, CASE WHEN p THEN 'DQ_PII_GUARD_SUPPRESSED' END) AS dq_codes, CASE WHEN h <> 1 OR p THEN 'ERROR' WHEN f IN ('', 'x') OR e = '-' OR m <> 'fixed' THEN 'WARN' ELSE 'PASS' END AS dq_status FROM x)"""


def example_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    handles = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    f, e = F.when(k % 5 == 0, "").when(k % 5 == 1, "x").otherwise("12K"), F.when(k % 7 == 0, "-").otherwise("5%")
    model = F.when(k % 4 == 0, "missing").when(k % 4 == 1, "pending").when(k % 4 == 2, "unknown").otherwise("fixed")
    pair = lambda raw, percent=False: F.struct(raw.alias("raw"), parse_number(raw, percent).alias("value"))
    found = quality_codes(handles, pair(f), pair(e, True), model, k % 11 == 0)
    return read_table(spark, sf_dir, "orders").select(k, found.alias("found")).select("o_orderkey", F.array_join("found", ";").alias("dq_codes"), quality_status(F.col("found")).alias("dq_status"))


@query("dq_codes", f"WITH {DQ_SQL} SELECT k AS o_orderkey, dq_codes, dq_status FROM c")
def dq_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return example_quality(spark, sf_dir)


@query("accept_quarantine", f"WITH {DQ_SQL} SELECT CASE WHEN dq_status = 'ERROR' THEN 'quarantine' ELSE 'accepted' END AS side, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1")
def accept_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = accepted_and_quarantined(example_quality(spark, sf_dir))
    return good.withColumn("side", F.lit("accepted")).unionByName(bad.withColumn("side", F.lit("quarantine"))).groupBy("side").agg(F.count("*").alias("n"))


@query("code_frequency", f"WITH {DQ_SQL} SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(dq_codes, ';')) AS code FROM c) WHERE code <> '' GROUP BY 1")
def frequency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_frequency(example_quality(spark, sf_dir), F.col("dq_codes"))


@query(
    "section_segmentation",
    """WITH r AS (SELECT user_id, event_id, event_type IN ('signup', 'purchase') AS opens, event_type = 'signup' AS candidate FROM events),
    s AS (SELECT *, max(CASE WHEN opens THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS header_row FROM r) SELECT s.user_id, s.event_id, s.header_row FROM s JOIN r h ON h.event_id = s.header_row AND h.user_id = s.user_id AND h.candidate WHERE s.event_id > s.header_row""",
)
def segment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    s = with_segments(e, F.col("event_type").isin("signup", "purchase"), ["user_id"], "event_id")
    headers = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("header_row"))
    return s.join(headers, ["user_id", "header_row"]).where("event_id > header_row").select("user_id", "event_id", "header_row")


@query(
    "nearest_label_window",
    """WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'Report Oct' WHEN 'error' THEN 'Total' END AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    p AS (SELECT a.user_id, a.event_id, list(b.label ORDER BY b.event_id DESC) FILTER (WHERE b.label IS NOT NULL) AS near FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 68 AND a.n - 1 GROUP BY 1, 2),
    q AS (SELECT user_id, event_id, CASE WHEN list_contains(near, 'Report Oct') THEN 'Report Oct' END AS period, list_contains(near[1:3], 'Total') AS has_total FROM p)
    SELECT user_id, event_id, concat_ws(' || ', period, CASE WHEN has_total THEN 'Total' END) AS label FROM q""",
)
def label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "signup", "Report Oct").when(F.col("event_type") == "error", "Total")
    cell = F.struct(F.lit("str").alias("t"), label.alias("s"))
    e = read_table(spark, sf_dir, "events").withColumn("cells", F.when(label.isNotNull(), F.array(cell)).otherwise(F.array(cell, cell, cell)))
    return with_nearest_label(e, "label", ["user_id"], "event_id").select("user_id", "event_id", "label")
