"""Sources, warehouse, reliability and plans on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemill import catalog
from tidemill.config import WEIGHTS_V1, MatchingConfig, campaign_map
from tidemill.contracts import CONTRACTS
from tidemill.operators.upsert import upsert, upsert_counts
from tidemill.plans import deliverables, feedback, identity, matching, reliability, sheets, temporal
from tidemill.plans.history import campaign_facts
from tidemill.plans.warehouse import Warehouse
from tidemill.sources import files, xlsx

HEADER = ["Number", "Influencer", "Link Tiktok", "Follower", "Engagement %", "BUDGET"]


def grid(spark, tmp_path, sheets_):
    xlsx.register(spark)
    xlsx.write_workbook(str(tmp_path / "book.xlsx"), sheets_)
    return spark.read.format("xlsx").option("path", str(tmp_path)).load()


def test_reader_types_gaps_and_errors(spark, tmp_path):
    g = grid(spark, tmp_path, {"S": [["a", None, 1.5], [], [True, 3]]})
    rows = {r.row_number: [(c.t, c.s) for c in r.cells] for r in g.collect()}
    assert rows == {1: [("str", "a"), ("none", None), ("float", "1.5")], 2: [], 3: [("bool", "True"), ("int", "3")]}
    assert g.where("sheet = 'none such'").count() == 0
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    assert spark.read.format("xlsx").option("path", str(tmp_path)).load().where("error is not null").select("file").first()[0] == "bad.xlsx"
    assert files.discover(spark, str(tmp_path)).count() == 2


def test_candidates_conflict_pii_and_sections(spark, tmp_path):
    pii = [*HEADER, "ที่อยู่จัดส่ง", "เพศผู้ติดตาม"]
    body = [
        ["Tier Nano"], pii,
        [1, "creator_a", "https://www.tiktok.com/@creator_a", 1000, 0.1, 1500, "12/3 ถนน", "ผู้หญิง"],
        [2, "creator_a", "Name (@creator_b) | TikTok", 1000, 0.1, 1500, None, None],
        [3, "creator_c", None, 900, None, "*Free*", None, "12/3 ถนน ก แขวง ข"],
        ["total", None, None, None, None, None],
        ["No", "Influencer", "Link Lemon8", "Follower"],
        [9, "creator_z", None, 5000],
    ]
    found = {r.source_row_number: r for r in sheets.candidate_observations(grid(spark, tmp_path, {"KOL": body})).collect()}
    assert sorted(found) == [3, 4, 5]
    assert (found[3].dq_status, found[3].canonical_handle_candidate, found[3].pii_headers_present, found[3].section_context_raw) == ("PASS", "creator_a", "ที่อยู่จัดส่ง", "Tier Nano")
    assert "DQ_IDENTITY_CONFLICT" in found[4].dq_codes and found[4].canonical_handle_candidate == ""
    assert found[5].pii_guard_triggered and found[5].audience_gender_raw == "" and found[5].dq_status == "ERROR" and found[5].fee_model == "free"


def test_classification_cascade(spark, tmp_path):
    g = grid(spark, tmp_path, {"Any": [HEADER], "Report Oct": [["x"]], "GMV Ads": [["x"]], "Misc": [["x"]], "Fixed": [HEADER]})
    overrides = spark.createDataFrame([("book.xlsx", "Fixed", "shipment", "seen")], "source_filename string, sheet_name string, sheet_type string, reason string")
    found = {r.sheet: (r.sheet_type, r.confidence) for r in sheets.classify(g, overrides).collect()}
    assert found == {"Any": ("influencer_candidate", "high"), "Report Oct": ("monthly_performance", "medium"), "GMV Ads": ("ads", "medium"), "Misc": ("other_operations", "low"), "Fixed": ("shipment", "high")}


def test_deliverables_from_a_sheet(spark, tmp_path):
    g = grid(spark, tmp_path, {"D": [["Report Oct"], ["No", "Influencer", "วันที่ลงโพสต์", "ลิงค์โพสต์", "VideoView", "Like"], [1, "creator_a", 46125, "https://tiktok.com/x", "12K", 5], [2, "nobody", "TBC", "n/a", None, None], ["", "Total", None, None, 9, 9]]})
    rules = spark.createDataFrame([("book.xlsx", "D", 1, "nov", "c0"), ("book.xlsx", "D", 2, "oct", "c1")], "source_filename string, source_sheet_name string, rule_position int, section_contains string, campaign_id string")
    rows = deliverables.influencer_rows(g, rules).withColumn("influencer_id", F.when(F.col("identity_raw") == "creator_a", "inf_1"))
    delivered, performed, issues = deliverables.deliverables_and_performance(rows)
    assert [(r.row_number, r.campaign_id, r.posted_date, r.post_url) for r in delivered.orderBy("row_number").collect()] == [(3, "c1", "2026-04-13", "https://tiktok.com/x"), (4, "c1", "TBC", "")]
    assert [(r.views, r.likes) for r in performed.collect()] == [(12000.0, 5.0)]
    assert [r.dq_code for r in issues.collect()] == ["IDENTITY_UNRESOLVED_EXACT_ONLY"]


def test_facts_show_conflicts(spark):
    rows = spark.createDataFrame([("c", "i", True, False, 100.0, 1.0, 0.1, "a"), ("c", "i", False, True, 100.0, 2.0, 0.2, "b")], "campaign_id string, influencer_id string, selected boolean, confirmed boolean, fee double, follower double, engagement double, source_filename string")
    f = campaign_facts(rows).first()
    assert (f.selected_status, f.confirmed_status, f.fee_status, f.campaign_history_dq_status) == ("conflict", "conflict", "consistent", "WARN")


def test_resolver_is_exact(spark):
    master = spark.createDataFrame([("inf_1", "creator.one")], "influencer_id string, canonical_handle string")
    alias = spark.createDataFrame([("inf_1", "The One"), ("inf_1", "shared"), ("inf_2", "shared")], "influencer_id string, alias_value string")
    rows = spark.createDataFrame([("@Creator.One",), ("the  ONE",), ("creator.on",), ("shared",), ("",)], "raw string")
    found = {r.raw: r.method for r in identity.resolve(rows, "raw", identity.resolver(master, alias)).collect()}
    assert found == {"@Creator.One": "exact_canonical_handle", "the  ONE": "exact_known_alias", "creator.on": "unresolved_exact_only", "shared": "unresolved_exact_only", "": "missing_identity"}


def test_decision_codes(spark):
    rows = spark.createDataFrame(
        [("r1", None, None, None, "a;b", None, None), ("r2", "same_identity_use_handle", "c", "seen", "a;b", "me", "2026-01-01"), ("r3", "insufficient_evidence", None, "none", "a", "me", "2026-01-01"), ("r4", "maybe", None, "x", "a", "me", "d")],
        "review_id string, decision string, resolved_handle string, decision_evidence string, normalized_handle_candidates string, reviewer string, reviewed_at string",
    )
    wrong, _ = identity.validated_decisions(rows)
    assert sorted((r.review_id, r.error_code) for r in wrong.collect()) == [("r1", "DECISION_MISSING"), ("r2", "RESOLVED_HANDLE_NOT_CANDIDATE"), ("r4", "DECISION_INVALID")]


def test_upsert_keeps_loaded_at_and_counts(spark):
    old = spark.createDataFrame([("a", 1, "t0"), ("b", 2, "t0")], "k string, v int, loaded_at string")
    new = spark.createDataFrame([("a", 9, "t1"), ("b", 2, "t1"), ("c", 3, "t1"), (" ", 4, "t1")], "k string, v int, loaded_at string")
    out = upsert(old, new, ["k"], kept="loaded_at")
    assert sorted(map(tuple, out.collect())) == [("a", 9, "t0", "updated"), ("b", 2, "t0", "unchanged"), ("c", 3, "t1", "inserted")]
    assert tuple(upsert_counts(out).first()) == (1, 1, 3)
    assert upsert_counts(upsert(out.drop("action"), new, ["k"], kept="loaded_at")).first()["inserted"] == 0


def write_batch(folder, extra=""):
    folder.mkdir(exist_ok=True)
    rows = {
        "dim_influencer": ("influencer_id,platform,canonical_handle,observation_count", "inf_1,tiktok,h,3"), "influencer_identity_alias": ("influencer_id,alias_type,alias_value,source_row_hash", "inf_1,raw_primary,H,x"),
        "dim_brand": ("brand_id,canonical_brand_name", f"brd_1,Brand{extra}"), "dim_campaign": ("campaign_id,brand_id,campaign_display_name", "cmp_1,brd_1,Camp"), "campaign_requirement": ("campaign_id,requirement_status,target_age_min", "cmp_1,explicit_source_fields,x"),
        "fact_campaign_influencer": ("campaign_influencer_id,campaign_id,influencer_id,fee_min", "f1,cmp_1,inf_1,1500.50"), "fact_campaign_deliverable": ("deliverable_id,campaign_id,influencer_id,posted_date,posted_raw", "d1,cmp_1,inf_1,2026-2-3,yes"),
        "fact_influencer_performance": ("performance_id,campaign_id,influencer_id,deliverable_id,views", "p1,cmp_1,inf_1,,12"), "fact_campaign_performance": ("campaign_performance_id,campaign_id,revenue", "q1,cmp_1,9"),
    }
    assert set(rows) == set(CONTRACTS)
    for name, (head, line) in rows.items():
        (folder / f"{name}.csv").write_text(f"{head}\n{line}\n", encoding="utf-8-sig")


def test_warehouse_loads_once_updates_and_fails_safely(spark, tmp_path):
    w, batch = Warehouse(spark, str(tmp_path / "wh")), tmp_path / "in"
    write_batch(batch)
    first = w.load(str(batch))
    assert first.status == "SUCCESS" and set(first.counts.values()) == {1}
    assert w.load(str(batch)).status == "SKIPPED"
    d = w.core("fact_campaign_deliverable").first()
    assert (d.posted, d.posted_date, d.posted_date_raw) == (True, None, "2026-2-3")
    loaded = w.core("dim_brand").first()["loaded_at"]
    write_batch(batch, " new")
    assert w.load(str(batch)).status == "SUCCESS"
    assert tuple(w.core("dim_brand").select("brand_name", "loaded_at").first()) == ("Brand new", loaded)
    before = w.state()
    (batch / "dim_campaign.csv").write_text("campaign_id,brand_id,campaign_display_name\ncmp_2,brd_9,Camp\n")
    with pytest.raises(ValueError, match="point nowhere"):
        w.load(str(batch))
    assert w.state() == before


def test_two_phase_commit_and_ledger(spark, tmp_path):
    load, df = reliability.TwoPhase(str(tmp_path), "r1"), spark.range(5)
    load.stage(df)
    assert load.state(spark) == "PARTIAL_LOAD_STAGING_WITHOUT_COMMIT"
    assert load.recover(df) == "COMMIT_NEW_BATCH" and load.state(spark) == "LOAD_STATE_CLEAN" and load.commit(df) == "SKIP_ALREADY_COMMITTED"
    ledger = reliability.Ledger(tmp_path / "ledger.json")
    assert [ledger.register("f"), ledger.register("f")] == ["PROCESS_NEW_BATCH", "SKIP_ALREADY_PROCESSED"]
    assert reliability.state_problem(reliability.new_state("f"), ledger) == "BAD_INCREMENTAL_STATE_UNKNOWN_BATCH"
    ledger.append_run(status="SUCCESS", batch_fingerprint="f")
    assert reliability.state_problem(reliability.new_state("f"), reliability.Ledger(tmp_path / "ledger.json")) == "INCREMENTAL_STATE_VALID"
    assert reliability.state_problem(None, ledger) == "BAD_INCREMENTAL_STATE_VERSION" and reliability.state_problem(reliability.new_state(" "), ledger) == "BAD_INCREMENTAL_STATE_EMPTY_POINTER"


def test_retry_only_what_may_pass():
    calls = iter([reliability.RetryableDependencyError("x"), "done"])

    def operation():
        step = next(calls)
        if isinstance(step, Exception):
            raise step
        return step

    assert [a["status"] for a in reliability.execute_with_retry(operation)[1]] == ["RETRY", "SUCCESS"]
    with pytest.raises(reliability.RetryExhaustedError):
        reliability.execute_with_retry(lambda: (_ for _ in ()).throw(reliability.RetryableDependencyError("x")), 2)
    with pytest.raises(ValueError):
        reliability.execute_with_retry(lambda: int("x"))


def test_sheet_drift(spark):
    kind = "name string, sheet string, sheet_type string, filled_rows int, headers array<string>, signature array<string>"
    c = "influencer_candidate"
    base = spark.createDataFrame([("b", f"s{i}", c, 3, ["a", "b"], ["x"]) for i in range(1, 6)] + [("gone", "s", c, 3, ["a"], ["x"]), ("b", "void", "other", 0, [], [])], kind)
    now = spark.createDataFrame([("b", "s1", c, 3, ["a", "c"], ["y"]), ("b", "s2", "other", 0, [], []), ("b", "s4", "other", 3, ["a", "z"], []), ("b", "s5", c, 9, ["q"], ["x"]), ("b", "void", "other", 0, [], [])], kind)
    found = sorted((r.sheet, r.issue, r.severity) for r in reliability.sheet_drift(base, now).collect())
    assert found == [
        ("s1", "CANDIDATE_HEADER_SIGNATURE_CHANGED", "WARN"),
        ("s2", "CANDIDATE_SCHEMA_DRIFT", "ERROR"),
        ("s2", "EMPTY_SHEET", "ERROR"),
        ("s3", "MISSING_SHEET", "ERROR"),
        ("s4", "CANDIDATE_SCHEMA_DRIFT", "ERROR"),
    ]
    assert [(r.removed, r.added) for r in reliability.sheet_drift(base, now).where("sheet = 's4'").collect()] == [(["b"], ["z"])]


def test_temporal_guards(spark):
    rows = temporal.dated(spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-1-2"), ("c", "soon")], "id string, d string"), "d")
    assert rows.count() == 2
    arrived = temporal.with_arrival(rows, "id", overrides={"a": 5})
    assert [str(r.arrival_date) for r in arrived.orderBy("id").collect()] == ["2026-01-06", "2026-01-03"]
    with pytest.raises(ValueError):
        temporal.late_arrivals(arrived, "2026-01-01", "2026-01-05", "2026-01-04")
    new, counters = temporal.safe_backfill(rows, "2026-01-01", "2026-01-02", rows.where("id = 'a'"), "id", [F.col("d")])
    assert [r.id for r in new.collect()] == ["b"] and counters.first()["already_present"] == 1
    assert temporal.safe_backfill(rows, "2026-01-01", "2026-01-02", rows, "id", [F.col("d")])[0].count() == 0


def test_configuration_is_checked():
    weights = dict.fromkeys(WEIGHTS_V1, 1 / 7)
    assert MatchingConfig(weights, 100.0, neutral_missing_score=0).neutral_missing_score == 50.0
    for bad in ({"weights": {"x": 1.0}}, {"max_fee": 0}, {"guardrails": {"machine_learning": 0, "fuzzy": False}}, {"weights": dict.fromkeys(WEIGHTS_V1, 0.2)}):
        with pytest.raises(ValueError):
            MatchingConfig(**({"weights": weights, "max_fee": 1.0} | bad))
    with pytest.raises(ValueError):
        campaign_map([])


def test_feedback_needs_everything(spark):
    reviews = spark.createDataFrame([("a", 1, 90.0, "selected"), ("b", 2, 80.0, "selected"), ("c", 3, 70.0, "rejected")], "influencer_id string, rank int, total_score double, human_decision string")
    results = spark.createDataFrame([("a", "completed", "yes"), ("b", "completed", "no")], "influencer_id string, execution_status string, business_success string")
    r = feedback.evaluate(reviews, results, "agreed", 2, F.lit(0)).first()
    assert (r.success_rate, r.selected_within_top_k_rate, r.counterfactual_claim_allowed) == (0.5, 1.0, False)
    with pytest.raises(ValueError):
        feedback.evaluate(reviews, results.limit(1), "agreed", 2, F.lit(0))


def test_sinks_guard_personal_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_table(spark.createDataFrame([("x",)], "phone_number string"), str(tmp_path / "t"))
    with pytest.raises(ValueError):
        files.write_table(spark.range(0), str(tmp_path / "t"), when_empty="raise")
    assert files.export_csv(spark.range(3), str(tmp_path / "x.csv")) == 3 and files.count_rows(spark, str(tmp_path / "x.csv")) == 3


def test_ranking_is_deterministic(spark):
    from tidemill.plans.features import features_of

    rows = features_of(spark, "/root/testdata/sf0.001")
    first = matching.rank_candidates(rows, matching.V1).select("influencer_id", "rank").orderBy("influencer_id").collect()
    assert first == matching.rank_candidates(rows.orderBy(F.rand(3)), matching.V1).select("influencer_id", "rank").orderBy("influencer_id").collect()


def test_pii_scan_reads_whole_texts(spark):
    from tidemill.plans.requirements import scanned_texts

    long = "word " * 100 + "call 081-234-5678 now"
    docs = spark.createDataFrame([(k, long, "web") for k in range(12)] + [(12, None, None)], "doc_id long, text string, source string")
    found = {r.doc_id: r.scanned for r in scanned_texts(docs).collect()}
    assert all(found[k].startswith(long) for k in range(12)) and found[12] == " 081-234-5678"


def test_feedback_eval_ranks_more_than_a_million_customers(spark, tmp_path):
    n = 1_000_005
    spark.range(1, n + 1).select(F.col("id").alias("c_custkey"), (F.col("id") % 1000).cast("double").alias("c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    r = feedback.feedback_query(spark, str(tmp_path)).first()
    order = sorted(range(1, n + 1), key=lambda k: (-(k % 1000), k))
    ranks = [i for i, k in enumerate(order, 1) if k % 3 == 0]
    assert (r.review_count, r.selected_count, r.mean_selected_rank) == (n, len(ranks), round(sum(ranks) / len(ranks), 4))


def test_replay_and_audit_take_every_part_of_the_size(spark):
    parts = {r.p_partkey for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_size = 7").collect()}
    suppliers = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    scored = catalog.QUERIES["match_v2_replay"](spark, "/root/testdata/sf0.001").collect()
    audited = catalog.QUERIES["leakage_audit"](spark, "/root/testdata/sf0.001").collect()
    assert parts and {r.target_campaign_id for r in scored} == parts == {r.target_campaign_id for r in audited} and len(scored) == len(parts) * suppliers


def test_tags_of_one_campaign_only(spark):
    from tidemill.plans.matching import only_there

    pairs = spark.createDataFrame([(1, 10, ["a", "b"]), (1, 11, ["b", "c", "d"]), (2, 10, ["a"]), (2, 11, [])], "influencer_id long, campaign_id long, x_tags array<string>")
    got = {(r.target_campaign_id, r.influencer_id): sorted(r["__only"]) for r in only_there(pairs, "x_tags").collect()}
    assert got == {(10, 1): ["a"], (11, 1): ["c", "d"], (10, 2): ["a"]}


def test_xlsx_scan_reads_all_suppliers(spark, tmp_path):
    from tidemill.plans.scans import scan_query

    spark.range(1, 6001).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = scan_query(spark, str(tmp_path)).select("canonical_handle_candidate", "follower_normalized", "fee_model").collect()
    assert sorted(map(tuple, found)) == sorted((f"sup.{k}", 1000.0 + k, "free" if k % 2 else "fixed") for k in range(1, 6001))
