"""Handles, identifiers and evidence of identity. Matching is exact; nothing here is fuzzy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.text import codes, normalized, split_list, stripped

HANDLE = "([A-Za-z0-9._]+)"


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and the first 16 hex digits of the SHA-256 of the parts joined by bars; null counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, 16))


def short_id(prefix: str, text: Column, digits: int = 12) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, digits))


def row_hash(*columns: Column) -> Column:
    """SHA-256 of the columns' canonical text; null and empty differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def extract_handle(x: Column) -> Column:
    """By preference: a profile URL, (@handle), @handle, leading `handle (`, the whole text; lower case; else null."""
    text = stripped(x)
    part = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    plain = stripped(F.regexp_replace(text, "^@+", ""))
    found = F.coalesce(
        part(rf"(?i)tiktok\.com/@{HANDLE}"),
        part(rf"\(@{HANDLE}\)"),
        part(rf"@{HANDLE}"),
        part(rf"^{HANDLE}\s*\("),
        F.when(plain.rlike(f"^{HANDLE}$"), plain),
    )
    return F.when(~text.isin("", "-"), F.lower(found))


def identity_observation(cells: Column) -> Column:
    """struct(primary_raw, secondary_raw, raws, handles) of the identity cells of a row, in column order."""
    present = F.filter(F.transform(cells, stripped), lambda c: c.isNotNull() & ~c.isin("", "-"))
    raws = F.array_distinct(present)
    handles = F.array_distinct(F.array_compact(F.transform(present, extract_handle)))
    at = lambda i: F.coalesce(F.try_element_at(raws, F.lit(i)), F.lit(""))
    return F.struct(at(1).alias("primary_raw"), at(2).alias("secondary_raw"), raws.alias("raws"), handles.alias("handles"))


def strong_identity_cell(x: Column) -> Column:
    """How strongly a cell shows an identity: url, parenthesized_at, bare_at; else null."""
    text = stripped(x)
    return (
        F.when(text.rlike(rf"(?i)tiktok\.com/@{HANDLE}"), "tiktok_url")
        .when(text.rlike(rf"\(@{HANDLE}\)"), "parenthesized_at")
        .when(text.rlike(rf"(^|[^A-Za-z0-9._])@{HANDLE}"), "bare_at")
    )


def review_key(review_type: Column, handles: Column, primary: Column) -> Column:
    """What groups reviews: the sorted candidates of a conflict, else the lower-cased primary text."""
    sorted_handles = F.array_join(F.array_sort(split_list(handles)), ";")
    return F.when(review_type == "identity_conflict", F.concat(F.lit("conflict|"), sorted_handles)).otherwise(F.concat(F.lit("unparsable|"), normalized(primary)))


def review_evidence(review_type: Column, primary: Column, secondary: Column) -> Column:
    """struct(evidence_type, strength, required_check) of a review, tested in this order."""
    both = F.concat_ws(" ", primary, secondary)
    of = lambda kind, strength, check: F.struct(F.lit(kind).alias("evidence_type"), F.lit(strength).alias("strength"), F.lit(check).alias("required_check"))
    return (
        F.when(review_type == "identity_conflict", of("conflicting_handles", "conflict", "compare_profiles"))
        .when(both.rlike(rf"(?i)tiktok\.com/@{HANDLE}"), of("direct_profile_url", "strong", "open_profile"))
        .when(both.rlike(rf"@{HANDLE}"), of("embedded_handle", "medium", "confirm_handle"))
        .otherwise(of("display_name_only", "weak", "find_source_evidence"))
    )


#: What a reviewer may decide.
DECISIONS = ["same_identity_use_handle", "alias_confirmed", "different_identity_keep_separate", "insufficient_evidence"]


def decision_errors(decision: Column, handle: Column, evidence: Column, candidates: Column, reviewer: Column, reviewed_at: Column) -> Column:
    """Codes of what is wrong with a review decision, in order."""
    has = lambda c: F.coalesce(stripped(c) != "", F.lit(False))
    names_one = decision.isin(*DECISIONS[:2])
    known = decision.isin(*DECISIONS)
    return codes(
        (~has(decision), "DECISION_MISSING"),
        (has(decision) & ~known, "DECISION_INVALID"),
        (names_one & ~has(handle), "RESOLVED_HANDLE_REQUIRED"),
        (names_one & has(handle) & ~F.coalesce(F.array_contains(split_list(candidates), F.lower(stripped(handle))), F.lit(False)) & has(candidates), "RESOLVED_HANDLE_NOT_CANDIDATE"),
        (known & ~names_one & has(handle), "RESOLVED_HANDLE_NOT_ALLOWED"),
        (known & ~has(evidence), "DECISION_EVIDENCE_REQUIRED"),
        (known & (~has(reviewer) | ~has(reviewed_at)), "REVIEWER_REQUIRED"),
    )
