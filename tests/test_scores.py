"""Score, pair and evidence operators on literal rows worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cards, evidence, pairs, review, scores

FIELDS = "symbol long, side string, rsi_d double, obv_d string, bb_d double, vr_d double, rsi_h double, obv_h string, bb_h double, vr_h double, pe double, pb double, roe double, growth double, margin double, sentiment double, evidence string"


def one(spark, **values):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    row = {"symbol": 1, "side": "LONG", "sentiment": 50.0, "evidence": "DIRECT", **values}
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], FIELDS)
    return scores.final_score(scores.component_scores(df)).first()


def test_nothing_known_is_neutral(spark):
    r = one(spark)
    assert (r.slow, r.fast, r.value, r.volume_score, r.catalyst, r.penalty) == (50, 50, 50, 50, 50, 0)
    assert r.final == pytest.approx(50 * 0.95 + 2.5)


def test_points_of_a_long_candidate(spark):
    r = one(spark, rsi_d=50.0, obv_d="UP", bb_d=0.4, vr_d=2.0, rsi_h=85.0, obv_h="DOWN", bb_h=0.05, vr_h=0.5, pe=7.0, pb=0.5, roe=16.0, growth=6.0, margin=11.0)
    assert (r.slow, r.fast, r.value, r.volume_score, r.penalty) == (100, 10, 100, 85, 15)


def test_points_of_a_short_candidate(spark):
    r = one(spark, side="SHORT", rsi_d=72.0, obv_d="DOWN", bb_d=0.9, vr_d=0.7, rsi_h=25.0, obv_h="UP", bb_h=0.3, vr_h=1.4, pe=90.0, pb=9.0, roe=-1.0, growth=-6.0)
    assert (r.slow, r.fast, r.value, r.volume_score, r.penalty) == (100, 45, 100, 60, 20)


def test_evidence_caps_the_final_score(spark):
    good = dict(rsi_d=50.0, obv_d="UP", bb_d=0.4, vr_d=2.0, rsi_h=50.0, obv_h="UP", bb_h=0.5, vr_h=2.0, pe=7.0, pb=0.5, roe=16.0, sentiment=90.0)
    assert [one(spark, evidence=e, **good).final for e in ("REJECT", "WEAK", "SECTOR")] == [59, 69, 74]
    assert one(spark, evidence="DIRECT", **good).final > 74


def test_zones_fall_back_to_percents(spark):
    df = spark.createDataFrame([("LONG", 100.0, 2.0), ("SHORT", 100.0, 2.0), ("LONG", 100.0, 0.0), ("SHORT", 100.0, None)], "side string, close double, atr double")
    assert [(r.invalidation, r.target) for r in scores.atr_zones(df).collect()] == [(98, 103), (102, 97), (96, 105), (103, 95)]


def test_amounts(spark):
    df = spark.createDataFrame([("3조 2,500억",), ("4조",), ("1,200억",), ("50백만",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(evidence.krw_amount(F.col("t"))).collect()] == [32500, 40000, 1200, 0.5, None, None]
    df = spark.createDataFrame([("$1.5 billion deal",), ("USD 300M",), ("2억 달러",), ("7 백만 달러",), (", million",)], "t string")
    assert [r[0] for r in df.select(evidence.usd_amount(F.col("t"))).collect()] == [1500, 300, 200, 7, None]


def test_url_dedupe_keeps_items_without_url(spark):
    df = spark.createDataFrame([(1, 1, "http://a/x?q=1"), (2, 2, "http://A/x/#f"), (3, 1, None), (4, 1, "")], "external_id long, published_at long, url string")
    assert sorted(r.external_id for r in evidence.url_dedupe(df).collect()) == [2, 3, 4]


def test_dollar_tickers(spark):
    df = spark.createDataFrame([(1, "buy $ABC and $ABC not $USD or $toolong"), (2, None)], "external_id long, text string")
    assert [tuple(r) for r in evidence.dollar_tickers(df, ["USD"]).collect()] == [(1, "ABC", 2)]


def test_cosine_and_share_classes(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0], "GOOG", "GOOGL"), ([0.0, 0.0], [1.0, 0.0], "AB", "XB")], "a array<double>, b array<double>, s string, t string")
    assert [tuple(r) for r in df.select(evidence.cosine("a", "b"), evidence.same_product(F.col("s"), F.col("t"))).collect()] == [(1.0, True), (0.0, False)]


def test_quiet_period(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("A", t + datetime.timedelta(minutes=m), i) for i, m in enumerate((0, 60, 180, 310))], "symbol string, ts timestamp, id long")
    assert sorted(r.id for r in pairs.quiet(df).collect()) == [0, 2, 3]


def test_admission_by_book(spark):
    picks = spark.createDataFrame([(i, i, "a", 90.0 + i) for i in range(9)] + [(20, 3, "a", 99.9), (21, 50, "b", 10.0)], "id long, symbol long, sector string, score double")
    held = spark.createDataFrame([("a", 8), ("a", 7)], "sector string, symbol long")
    assert [r.id for r in review.admit(picks, held, "sector").orderBy("rank").collect()] == [20, 6, 5, 4]


def test_theme_sections_keep_one_leader_a_sector(spark):
    df = spark.createDataFrame([(1, "s", 2.5, 1.5, "LEADER", 70.0), (2, "s", 2.5, 1.5, "LEADER", 80.0), (3, "t", -3.0, 1.5, "VICTIM", 20.0)], "symbol long, sector string, return_pct double, volume_ratio double, role string, theme_score double")
    got = {(r.section, r.symbol) for r in scores.sections(df).collect()}
    assert got == {("surge", 1), ("surge", 2), ("beneficiary", 1), ("beneficiary", 2), ("leader", 2), ("crash", 3), ("victim", 3)}


def test_side_needs_evidence_and_agreement(spark):
    fields = "mood string, score double, direct int, rsi double, trend string, obv string, catalysts int, risks int"
    rows = [
        ("positive", 60.0, 1, 50.0, "UP", "UP", 1, 0, "LONG"), ("positive", 60.0, 0, 50.0, "UP", "UP", 1, 0, "WATCH"), ("positive", 60.0, 1, 85.0, "UP", "UP", 1, 0, "WATCH"), ("positive", 44.0, 1, None, None, None, 1, 0, "WATCH"),
        ("negative", 60.0, 1, None, None, None, 0, 1, "SHORT"), ("negative", 60.0, 1, 50.0, "UP", "UP", 0, 1, "WATCH"), ("negative", 10.0, 1, 50.0, "DOWN", "DOWN", 0, 1, "SHORT"),
        ("mixed", 60.0, 1, 50.0, "DOWN", "UP", 2, 1, "LONG"), ("mixed", 60.0, 1, 50.0, "DOWN", "UP", 1, 2, "SHORT"), ("mixed", 60.0, 1, 50.0, "UP", "UP", 1, 2, "WATCH"), ("neutral", 99.0, 1, 50.0, "UP", "UP", 9, 0, "WATCH"),
    ]
    df = spark.createDataFrame(rows, fields + ", want string")
    assert df.withColumn("got", scores.decide_side(df)).where("got <> want").count() == 0


def test_setups_and_levels(spark):
    df = spark.createDataFrame([(50.0, "UP", 0.5, 2.0, True, False, 1.0), (85.0, "DOWN", 0.9, 1.4, False, True, 20.0), (20.0, "DOWN", 0.1, 2.0, False, True, 0.0)],
                               "rsi_h double, obv_h string, bb_h double, vr_h double, strong_reason boolean, weak_reason boolean, return_pct double")
    assert [(r.surge, r.crash) for r in scores.setup_scores(df).collect()] == [(100, 0), (0, 95), (25, 0)]
    df = spark.createDataFrame([(100.0, None, None, None, None, None, None), (100.0, 90.0, 110.0, 5.0, 100.0, 120.0, 80.0)], "close double, support double, resistance double, atr double, bb_mid double, bb_up double, bb_low double")
    a, b = scores.price_levels(df).collect()
    assert (a.entry_low, a.entry_high, a.stop, a.target) == pytest.approx((94.05, 101.0, 93.0, 110.0))
    assert (b.entry_low, b.entry_high, b.stop, b.target) == pytest.approx((80.4, 100.0, 78.8, 120.0))


def test_spillover_follows_the_strongest_source(spark):
    moved = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, -4.0)], "symbol long, return_pct double")
    edges = spark.createDataFrame([("r", 1, 9, "BENEFICIARY"), ("r", 2, 9, "BENEFICIARY"), ("r", 3, 9, "BENEFICIARY"), ("r", 3, 8, "VICTIM"), ("r", 2, 2, "BENEFICIARY")], "rule string, source long, target long, relation string")
    assert sorted(map(tuple, pairs.spillover_targets(moved, edges).select("target", "source").collect())) == [(8, 3), (9, 2)]


def test_spillover_scores_are_compared_at_nine_places(spark):
    """The parts of both add up to 45; as doubles, to a little less."""
    fields = "symbol long, source long, side string, source_return double, market string, reason string, confidence string, relation string, sentiment int, value int, fast int, slow int, volume_score int, penalty int, backlog double"
    rows = [(1, 1, "LONG", -5.0, "KR", "rumour", "MEDIUM", "PEER_MOMENTUM", 18, 60, 90, 39, 71, 13, 0.0), (2, 2, "LONG", -5.5, "US", "guidance_down", "HIGH", "LAGGING_BENEFICIARY", 18, 60, 90, 39, 25, 17, 0.0)]
    got = cards.spillover_score(spark.createDataFrame(rows, fields), 45.0).select("symbol", "source", F.round("score", 5)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 45.0), (2, 2, 45.0)]
