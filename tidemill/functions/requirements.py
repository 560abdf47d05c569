"""Targets of campaigns and audiences: platform, gender, age, tags, and how well they fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import contains_any, normalized, split_list

AGE = r"(\d{1,2})\s*(?:-|–|—|to)\s*(\d{1,2})"
#: Words for women and men.
FEMALE, MALE = ["หญิง", "ผู้หญิง", "female"], ["ชาย", "ผู้ชาย", "male"]
GENDERED = ["ผู้หญิง", "ผู้ชาย", "เพศหญิง", "เพศชาย"]
#: Keywords by tag, for themes, personas and content styles.
TAXONOMY = {
    "campaign_theme": {
        "skin_care": ["ผิว", "สกินแคร์", "skincare", "โลชั่น", "สิว", "ชุ่มชื้น"],
        "clinic_aesthetic": ["คลินิก", "เจ็บ", "บวม", "หมอ", "เครื่องมือ"],
        "sleep_wellness": ["นอน", "หลับ", "ก่อนนอน", "วิตกกังวล", "กัมมี่"],
        "joint_mobility": ["ข้อ", "เข่า", "ข้อต่อ", "วิ่ง", "เวท"],
        "hair_care": ["ผม", "ทำสี", "ผมร่วง", "ผมแห้ง"],
        "pet_care": ["สัตว์เลี้ยง", "น้องกิน", "อึ", "ถ่ายเหลว", "ขนร่วง"],
        "eyewear_fashion": ["แว่น", "แฟชั่น", "accessory", "หน้าจอ"],
    },
    "persona": {
        "self_care": ["self-care", "ดูแลตัวเอง", "ดูแลรูปร่าง"],
        "skin_concern_user": ["ปัญหาผิว", "ผิวหมอง", "เป็นสิว", "ผิวขาดน้ำ", "ผิวแห้ง"],
        "clinic_review_creator": ["สกินแคร์เชิงวิชาการ", "รีวิวคลินิก", "ความรู้พื้นฐาน"],
        "student": ["นักศึกษา", "เรียน"],
        "early_career": ["วัยเริ่มทำงาน"],
        "freelancer": ["ฟรีแลนซ์"],
        "health_fitness": ["เฮลตี้", "ฟิตเนส", "วิ่ง", "เวท"],
        "office_worker": ["พนักงานออฟฟิศ", "วัยทำงาน", "working people"],
        "working_parent": ["working moms", "คุณแม่"],
        "pet_owner": ["เจ้าของสัตว์เลี้ยง"],
        "general_consumer": ["ลูกค้าจริง", "คนทั่วไป"],
        "fashion_minimal": ["แฟชั่นมินิมอล"],
        "everyday_glasses_user": ["ใส่แว่นจริง", "ใส่เรียน", "ใส่ทำงาน"],
    },
    "content_style": {
        "real_review": ["real review", "รีวิวจริง", "ใช้จริง", "ความรู้สึกหลังใช้"],
        "ugc": ["ugc"],
        "diary": ["diary"],
        "before_after": ["before", "after", "ก่อนใช้", "หลังใช้"],
        "vlog": ["vlog"],
        "informal_storytelling": ["เพื่อนเล่าให้เพื่อนฟัง", "informal", "ไม่ใช้สคริปต์ขาย"],
        "close_up_product": ["close-up", "texture", "เนื้อสัมผัส"],
        "routine": ["routine"],
        "unboxing": ["แกะกล่อง", "เปิดถุง"],
    },
}


def platform(raw: Column) -> Column:
    """struct(platform, method)."""
    text = normalized(raw)
    of = lambda p, m: F.struct(F.lit(p).alias("platform"), F.lit(m).alias("method"))
    return F.when(text == "", of("", "source_missing")).when(contains_any(text, ["tiktok", "tik tok"]), of("tiktok", "exact_keyword")).otherwise(of("", "unmapped"))


def budget_scope(raw: Column) -> Column:
    text = F.lower(raw)
    both = F.contains(text, F.lit("influencer")) & F.contains(text, F.lit("tiktok"))
    return F.when(both, "influencer_tiktok").when(contains_any(text, ["งบรวม", "งบประมาณรวม"]), "campaign_total").otherwise("candidate_pool_unspecified")


def target_gender(raw: Column) -> Column:
    """struct(mode, female_share, male_share, method)."""
    text = normalized(raw)
    female, male = contains_any(text, FEMALE), contains_any(text, MALE)
    percent = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,3})\s*%"), F.lit(1)), lambda p: p.try_cast("double") / 100)
    of = lambda mode, f, m, how: F.struct(F.lit(mode).alias("mode"), f.cast("double").alias("female_share"), m.cast("double").alias("male_share"), F.lit(how).alias("method"))
    at, lit = (lambda i: F.try_element_at(percent, F.lit(i))), (lambda x: F.lit(x))
    return (
        F.when(text == "", of("unknown", lit(None), lit(None), "source_missing"))
        .when(female & male & (F.size(percent) >= 2), of("mixed_weighted", at(1), at(2), "explicit_percentages"))
        .when(female & male, of("all", lit(0.5), lit(0.5), "explicit_both"))
        .when(female, of("female_only", lit(1.0), lit(0.0), "explicit_gender"))
        .when(male, of("male_only", lit(0.0), lit(1.0), "explicit_gender"))
        .otherwise(of("unmapped", lit(None), lit(None), "unmapped"))
    )


def age_range(raw: Column) -> Column:
    """struct(age_min, age_max, method): 13 to 80 in order."""
    text = F.regexp_replace(normalized(raw), "ปี", "")
    low, high = (F.regexp_extract(text, f"(?i){AGE}", i).try_cast("int") for i in (1, 2))
    of = lambda a, b, m: F.struct(a.cast("int").alias("age_min"), b.cast("int").alias("age_max"), F.lit(m).alias("method"))
    none = F.lit(None)
    return (
        F.when(text == "", of(none, none, "source_missing"))
        .when(low.isNull(), of(none, none, "unmapped"))
        .when((low > high) | (low < 13) | (high > 80), of(none, none, "invalid_range"))
        .otherwise(of(low, high, "explicit_range"))
    )


def audience_gender(raw: Column) -> Column:
    """struct(gender, method); an age in the cell tells of shifted columns."""
    text = normalized(raw)
    female, male = contains_any(text, [*FEMALE, "เพศหญิง"]), contains_any(text, [*MALE, "เพศชาย"])
    of = lambda g, m: F.struct(F.lit(g).alias("gender"), F.lit(m).alias("method"))
    return (
        F.when(text == "", of("unknown", "source_missing"))
        .when(text.rlike(f"(?i){AGE}"), of("invalid_age_in_gender", "schema_shift_detected"))
        .when(female & male, of("mixed", "explicit_both"))
        .when(female, of("female", "explicit_gender"))
        .when(male, of("male", "explicit_gender"))
        .otherwise(of("unmapped", "unmapped"))
    )


def audience_age(raw: Column) -> Column:
    """As age_range; a gender in the cell tells of shifted columns."""
    none = F.lit(None).cast("int")
    shifted = F.struct(none.alias("age_min"), none.alias("age_max"), F.lit("schema_shift_detected").alias("method"))
    return F.when(contains_any(normalized(raw), GENDERED), shifted).otherwise(age_range(raw))


def tags(text: Column, rules: dict[str, list[str]]) -> Column:
    """Sorted tags with a keyword in the text."""
    plain = normalized(text)
    hit = [F.when(contains_any(plain, [k.lower() for k in words]), F.lit(tag)) for tag, words in rules.items()]
    return F.array_sort(F.array_compact(F.array(*hit)))


def tag_evidence(text: Column, rules: dict[str, list[str]]) -> Column:
    """Sorted tag:keyword|keyword texts of the tags found."""
    plain = normalized(text)

    def of(tag: str, words: list[str]) -> Column:
        found = F.array_compact(F.array(*[F.when(F.contains(plain, F.lit(w.lower())), F.lit(w)) for w in sorted(set(words))]))
        return F.when(F.size(found) > 0, F.concat(F.lit(f"{tag}:"), F.array_join(found, "|")))

    return F.array_sort(F.array_compact(F.array(*[of(t, w) for t, w in rules.items()])))


def tag_coverage(target: Column, history: Column) -> Column:
    """Share of target tags in history, in percent: null without a target, 0 without history."""
    shared = F.size(F.array_intersect(target, history)) * F.lit(100.0) / F.size(target)
    return F.when(F.coalesce(F.size(target), F.lit(0)) > 0, F.when(F.coalesce(F.size(history), F.lit(0)) > 0, shared).otherwise(0.0))


def tag_coverage_text(target: Column, history: Column) -> Column:
    return tag_coverage(split_list(target), split_list(history))


def age_overlap(target_min: Column, target_max: Column, low: Column, high: Column) -> Column:
    """Percent of the observed band inside the target, rounded to 4 places; null where either is missing."""
    shared = F.greatest(F.lit(0), F.least(target_max, high) - F.greatest(target_min, low) + 1)
    known = target_min.isNotNull() & target_max.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(known, F.round(F.lit(100.0) * shared / F.greatest(F.lit(1), high - low + 1), 4))


def age_fit(target_min: Column, target_max: Column, low: Column, high: Column, neutral: float) -> Column:
    """As age_overlap without rounding: null without a target, neutral without a band."""
    shared = F.greatest(F.lit(0), F.least(target_max, high) - F.greatest(target_min, low) + 1)
    fit = F.least(F.lit(100.0), F.lit(100.0) * shared / F.greatest(F.lit(1), high - low + 1))
    return F.when(target_min.isNotNull() & target_max.isNotNull(), F.when(low.isNotNull() & high.isNotNull(), fit).otherwise(F.lit(neutral)))


def gender_fit_status(mode: Column, gender: Column) -> Column:
    known = gender.isin("female", "male", "mixed")
    return (
        F.when(mode.isin("", "unknown", "unmapped") | mode.isNull(), "target_unknown")
        .when(~known | gender.isNull(), "evidence_missing")
        .when(mode.isin("all", "mixed_weighted") | (mode == F.concat(gender, F.lit("_only"))), "match")
        .when(gender == "mixed", "partial_match")
        .otherwise("mismatch")
    )


def gender_fit(mode: Column, female_share: Column, male_share: Column, gender: Column, n: Column, neutral: float) -> Column:
    """0 to 100; null without a target; a share of 0 counts as missing, which is a half."""
    f = F.coalesce(F.nullif(female_share, F.lit(0.0)), F.lit(0.5))
    m = F.coalesce(F.nullif(male_share, F.lit(0.0)), F.lit(0.5))
    one = lambda same, other: F.when(gender == same, 100.0).when(gender == "mixed", 70.0).when(gender == other, 0.0).otherwise(neutral)
    weighted = F.when(gender == "mixed", 100.0).when(f == m, 80.0).when(gender == F.when(f > m, "female").otherwise("male"), 90.0).otherwise(50.0)
    fit = (
        F.when(F.coalesce(n, F.lit(0)) <= 0, neutral)
        .when(mode == "all", 100.0)
        .when(mode == "female_only", one("female", "male"))
        .when(mode == "male_only", one("male", "female"))
        .when(mode == "mixed_weighted", weighted)
        .otherwise(neutral)
    )
    return F.when(~F.coalesce(mode, F.lit("")).isin("", "unknown", "unmapped"), fit)


def bounded_score(value: Column, cap: float) -> Column:
    """value as a percentage of cap, from 0 to 100; 0 where the cap isn't positive."""
    if cap <= 0:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value.cast("double") * F.lit(100.0 / cap)))
