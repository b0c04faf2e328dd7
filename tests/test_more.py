"""What SQL can't express, and rules worked out by hand."""

import html
import random
import re
import shutil
import time
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import cards, cleaning, evidence, fuzzy, graph, lint, mentions, ranking, regime, relations, review, terms, text
from tidemark.plans import mentions as plans_mentions
from tidemark.streaming import flows


def values(spark, column, rows, schema):
    """The column's value for each row."""
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").coalesce(1)
    return [r.v for r in d.select("i", column.alias("v")).orderBy("i").collect()]


def test_gap_class_by_hand(spark):
    rows = [("UP_LEADS_UP", 4.0, 3.0, 1.0, 1.0, "ALREADY"), ("UP_LEADS_UP", 4.0, 1.0, -0.2, -0.1, "CURRENT_MISMATCH"), ("UP_LEADS_UP", 4.0, -1.1, None, -1.1, "MISMATCH"), ("UP_LEADS_UP", 4.0, 1.0, 1.0, -1.0, "NOT_YET"),
            ("UP_LEADS_UP", 4.0, 2.9, 2.9, None, "PARTIAL"), ("UP_LEADS_DOWN", 4.0, 1.1, 1.1, 1.1, "MISMATCH"), ("UP_LEADS_DOWN", 4.0, -1.0, None, None, "WEAKNESS_NOT_YET"), ("DOWN_LEADS_DOWN", -4.0, -3.0, -3.0, -3.0, "ALREADY"),
            ("DOWN_LEADS_DOWN", -4.0, -2.0, None, None, "PARTIAL"), ("DOWN_LEADS_UP", -4.0, 5.0, 5.0, 5.0, "MISMATCH"), ("UP_LEADS_UP", -4.0, 0.0, None, None, "WEAKNESS_NOT_YET")]
    got = values(spark, relations.gap_class(*map(F.col, "dstab")), rows, "d string, s double, t double, a double, b double, w string")
    assert got == [r[-1] for r in rows]
    conf = relations.pair_confidence(*map(F.col, "eplv"))
    assert values(spark, conf, [(20, 0.6, 1.5, 1.2), (20, 0.6, 1.5, 1.1), (1, None, None, None), (None, None, None, 9.0), (0, 0.0, 1.01, None)], "e int, p double, l double, v double") == ["high", "medium", "medium", "low", "medium"]


def test_live_status_and_boost_by_hand(spark):
    rows = [("UP", None, 2.0, "UP", "DATA_MISSING"), ("UP", 0.1, 1.0, "UP", "CONFIRMED"), ("UP", 0.1, 0.9, "UP", "WATCH"), ("UP", 0.1, None, "UP", "WATCH"), ("UP", 0.0, 2.0, "UP", "MIXED"), ("UP", -0.5, 2.0, "UP", "MIXED"), ("UP", -0.6, 2.0, "UP", "NOT_CONFIRMED"), ("DOWN", -1.0, 1.5, "DOWN", "CONFIRMED"), ("DOWN", 0.6, 1.5, "DOWN", "NOT_CONFIRMED")]
    assert values(spark, graph.live_status(*map(F.col, "ervo")), rows, "e string, r double, v double, o string, w string") == [r[-1] for r in rows]


def macro(spark, **figures):
    names = ["fear_greed", "us10y", "vix", "dollar", "oil", "hot_sectors", "us10y_chg", "dxy_chg", "sp500_chg", "wti_chg", "wti", "gold_chg", "usd_krw", "usd_krw_chg", "kospi_chg"]
    return spark.createDataFrame([[float(figures[n]) if n in figures else None for n in names]], ", ".join(f"{n} double" for n in names))


def test_macro_by_hand(spark):
    guard = lambda **f: tuple(regime.macro_guard(macro(spark, **f)).select("long_adj", "defensive_adj", "risk_level").first())
    assert guard() == (0, 0, "LOW") and guard(fear_greed=75, us10y=4.5) == (-13, 5, "HIGH") and guard(vix=25) == (-5, 0, "MEDIUM")
    assert guard(fear_greed=30, us10y=3.8) == (8, 3, "LOW") and guard(dollar=103, oil=85, hot_sectors=2) == (-8, 0, "MEDIUM") and guard(vix=24.9, dollar=102.9, oil=84.9) == (0, 0, "LOW")
    told = lambda **f: tuple(regime.macro_regime(macro(spark, **f)).select("regime", "readings").first())
    assert told(vix=26, dxy_chg=0.9) == ("RISK_OFF", "VIX_ALERT,DOLLAR_STRONG") and told(vix=17, sp500_chg=0.6) == ("RISK_ON", "") and told(vix=17, sp500_chg=0.6, gold_chg=1.6) == ("NEUTRAL", "GOLD_UP")
    assert told(sp500_chg=-1.6, kospi_chg=-1.6, us10y_chg=16, us10y=4)[1] == "RATE_SPIKE,BOTH_DOWN" and told(us10y_chg=16)[1] == "" and told(kospi_chg=-3.1)[1] == "KOSPI_DROP"


def test_scorecards_by_hand(spark):
    base = dict(sentiment="positive", n_catalysts=2, n_risks=1, mentions=3, narratives=0, close=10.0, close_h=None, trend="UP", macd=1.0, macd_signal=0.5, obv="UP", vr=1.6, rsi=60.0, bb_position="MIDDLE", candle="NONE", trend_h=None, obv_h=None, vr_h=None, roe=0.2, pe=10.0, margin=0.2, growth=0.2, debt=1.0, alpha=0.0, evidence=1)
    kinds = {k: "string" if isinstance(v, str) or k in ("trend_h", "obv_h") else "int" if isinstance(v, int) else "double" for k, v in base.items()}
    card = lambda **f: cards.scorecard(spark.createDataFrame([tuple((base | f).values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))).first()
    c = card()
    # 12+8+7-3.5+3; 14+8+4+2+2; 10+5+4+2+2 over 20; 10-2; 5+3+1.5+1 over 10
    assert (c.evidence_score, c.technical_score, c.valuation_score, c.risk_score, c.timing_score) == (26.5, 30, 20, 8, 10) and c.total == 94.5 and c.grade == "STRONG"
    assert card(evidence=0).total == 62 and card(rsi=91.0).total == 74 and card(rsi=81.0, bb_position="UPPER").total == 74 and card(close=None).technical_score == 8 and card(close=None).timing_score == 5
    weighed = card(alpha=50.0)
    assert abs(weighed.total - (50 * 0.35 + 14 / 30 * 25 + 15 + 10 + 8 + 5)) < 1e-9 and weighed.grade == "INTEREST"
    fund = lambda side, **f: spark.createDataFrame([(side, *[f.get(k) for k in ("pe", "pb", "roe", "eps_growth", "growth", "margin", "debt", "w52", "pe_discount", "blind_spot")])], "side string, pe double, pb double, roe double, eps_growth double, growth double, margin double, debt double, w52 double, pe_discount double, blind_spot boolean").select(cards.fundamental_score(None)).first()[0]
    assert fund("LONG") == 50 and fund("LONG", pe=7.0, pb=0.7) == 88 and fund("LONG", pe=-3.0, roe=-1.0, debt=201.0) == 30 and fund("LONG", pe=7.0, pb=0.7, roe=20.0) == 100
    assert fund("SHORT", pe=81.0, pb=9.0) == 87 and fund("SHORT", growth=-6.0, w52=91.0) == 73
    assert values(spark, cards.source_reason_quality(F.col("r"), F.col("c")), [("earnings_beat", "HIGH"), ("earnings_beat", "LOW"), ("rumour", "MEDIUM"), ("unknown_price_only", "LOW"), ("clinical_success", "HIGH")], "r string, c string") == [95, 75, 50, 15, 100]


def test_alias_mentions_by_hand(spark):
    aliases = [("A", "Acme", False), ("AB", "Acme Bio", False), ("F", "F", False), ("W", "wire", True), ("O", "oil", False)]
    hits = lambda t: sorted((r.symbol, r.at) for r in mentions.alias_mentions(spark.createDataFrame([(1, t)], "external_id long, text string"), aliases, ["oil"], "shares|stock").collect())
    assert hits("Acme Bio and Acme") == [("A", 13), ("AB", 0)]  # the longer alias uses up its characters
    assert hits("F is a letter") == [] and hits("buy $F now") == [("F", 5)] and hits("Ford (F) rose") == [("F", 0), ("F", 6)] and hits("the stock of F") == [("F", 13)]
    assert hits("a wire" + " " * 90 + "shares") == [] and hits("a wire of shares") == [("W", 2)] and hits("oil stock") == [("O", 0)] and hits(None) == [] and hits("") == []
    rng = random.Random(4)
    book = [(f"S{k}", "".join(rng.choice("ab") for _ in range(rng.randint(1, 4))), False) for k in range(8)]
    book = [b for i, b in enumerate(book) if b[1] not in [x[1] for x in book[:i]]]
    texts = ["".join(rng.choice("abc") for _ in range(40)) for _ in range(30)]
    got = {}
    for r in mentions.alias_mentions(spark.createDataFrame(list(enumerate(texts)), "external_id long, text string"), book, [], "zzz").collect():
        got.setdefault(r.external_id, set()).add((r.symbol, r.at))
    for i, t in enumerate(texts):
        used, want = set(), set()
        for s, a, _ in sorted(book, key=lambda b: -len(b[1])):
            for at in range(len(t)):
                if t[at : at + len(a)] == a and not used & set(range(at, at + len(a))):
                    used |= set(range(at, at + len(a)))
                    want.add((s, at))
        assert got.get(i, set()) == want
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (99, None)], "external_id long, text string")
    whole = terms.term_places(table, book, single=True, around=3)
    parts = terms.term_places(table, book, single=True, around=3, most_chars=5)
    rows = lambda f: sorted(map(str, f.collect()))
    assert rows(whole) == rows(parts) and whole.where("external_id = 0").count() == 2 * len(got.get(0, ())) and whole.where("external_id is null").count() == len(got.get(1, ()))
    every = {(i, s, at) for i, t in enumerate(texts) for s, a, _ in book for at in range(len(t)) if t[at : at + len(a)] == a}
    assert {(r.external_id, r.symbol, r.at) for r in terms.term_places(table, book).where("external_id is not null").collect()} == every
    assert terms.term_places(table, []).count() == 0 and all(r.before == texts[r.external_id][max(0, r.at - 3) : r.at] for r in whole.where("external_id is not null").collect())


def test_terms_cost_hardly_more_when_they_are_many():
    """The automaton reads a text once: ten thousand terms against ten, in one process."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    text = " ".join(word(rng.randint(2, 9)) for _ in range(40_000))

    class Shipped:
        def __init__(self, n):
            self.value = [(f"S{k}", word(8), False, 0) for k in range(n)]

    def took(n, number):
        book = terms.automaton(Shipped(n), number)
        best = 9.0
        for _ in range(5):
            began = time.perf_counter()
            sum(1 for _ in book.iter(text))
            best = min(best, time.perf_counter() - began)
        return best

    assert took(10_000, -1) < 6 * took(10, -2) + 0.01 and took(10_000, -3) < 0.2  # a regular expression of as many took seconds


def test_evidence_streams_by_hand(spark):
    items = spark.createDataFrame([(1, "Citi) Acme rose on sales", "t1"), (2, "JPM says the market fell", "t2"), (3, "buy $AC today", "t3"), (4, "AC/DC is a band, Acme not", "t" * 70), (5, "BACK to ACME", None), (6, None, "x")], "external_id long, text string, title string")
    hits = mentions.alias_mentions(items, [("AC.US", "Acme", False), ("JPM", "JPM", False)], [], "market")
    tickers = spark.createDataFrame([("AC.US", "AC"), ("JPM", "JPM"), ("NONE", "BACK")], "symbol string, ticker string")
    found = mentions.evidence_streams(items, hits, tickers, ["JPM", "Citi"], r"\)", "earnings", 8)
    got = sorted((r.symbol, r.o.stream, r.o.external_id, r.context) for r in found.collect())
    assert got == [("AC.US", 1, 1, "Acme rose on"), ("AC.US", 1, 4, "a band, Acme not"), ("AC.US", 2, 1, "Acme rose "), ("AC.US", 3, 3, "buy $AC today"), ("AC.US", 3, 4, "AC/DC is a"), ("AC.US", 4, 3, "buy $AC today"), ("JPM", 3, 2, "JPM says th")]
    best = {r.symbol: (r.contexts, r.n) for r in mentions.direct_evidence(found, "band", 3).collect()}
    assert best["AC.US"][1] == 3 and best["AC.US"][0][0] == "Acme rose on"
    assert {r.symbol: r.titles for r in mentions.titles(items, hits).collect()}["AC.US"] == ["t1", "t" * 59 + "…"]


def brute_ratio(a, b):
    def same(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = row[:]
            for j, d in enumerate(y):
                row[j + 1] = last[j] + 1 if c == d else max(last[j + 1], row[j])
        return row[-1]

    like = lambda x, y: 100.0 * 2 * same(x, y) / (len(x) + len(y)) if x or y else 100.0
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both = " ".join(sorted(s & t))
    p, q = " ".join([*([both] if both else []), *sorted(s - t)]), " ".join([*([both] if both else []), *sorted(t - s)])
    if both and (s <= t or t <= s):
        return 100.0
    if not both:
        return like(p, q)
    only = len(" ".join(sorted(s - t))) + len(" ".join(sorted(t - s))) - 2 * same(" ".join(sorted(s - t)), " ".join(sorted(t - s)))
    return max(100.0 * (1 - only / (len(p) + len(q))), like(both, p), like(both, q))


def test_fuzzy_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(40)]
    texts += [" ".join(rng.sample(t.split(), len(t.split()))[: rng.randint(3, 9)] + [word()] * rng.randint(0, 1)) for t in texts for _ in range(2)] + ["", "  ", texts[0], "one", "hello world", "helloworld"]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)]
    for a, b in pairs:
        assert abs(fuzzy.ratio_of(a, b) - brute_ratio(a, b)) < 1e-9, (a, b)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=rng.randrange(50)), " ".join(t.split())) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, at timestamp, norm string")
    seen, order = set(), []
    for i, at, n in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0])):
        if n and n not in seen:
            seen.add(n)
            order.append((i, at, n))
    for least, call in ((92.0, "dedupe"), (85.0, "cluster")):
        kept, cluster = [], {}
        for i, _, n in order:
            lead = next((j for j, m in kept if brute_ratio(n, m) >= least), None)
            cluster[n] = i if lead is None else lead
            if lead is None:
                kept.append((i, n))
        if call == "dedupe":
            assert sorted(r.id for r in fuzzy.dedupe_fuzzy(df, least).collect()) == sorted(i for i, _ in kept) and len(kept) < len(order)
        else:
            assert {r.id: r.cluster for r in fuzzy.cluster_first(df, least).collect()} == {i: cluster[n] for i, _, n in rows if n}
    assert fuzzy.dedupe_fuzzy(df.limit(0)).count() == 0


def test_fuzzy_links_of_whole_items(spark, sf):
    """No block in what is expected: all pairs of the table's items, of which ratio_of() passes over those out of reach."""
    for least, chars in ((92.0, None), (85.0, 300)):
        own = fuzzy.distinct_norms(plans_mentions.normed(spark, sf, chars))
        rows = sorted((r.id, r.norm) for r in own.collect())
        want = {(i, j) for k, (j, b) in enumerate(rows) for i, a in rows[:k] if fuzzy.ratio_of(a, b, least) >= least}
        assert {tuple(sorted((r.a, r.b))) for r in fuzzy.fuzzy_links(own, least).collect()} == want and len(want) > 8


def test_fuzzy_links_by_kind(spark):
    """A few words within a long text, copies with words changed here and there, and misspelt titles."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    long = [[word() for _ in range(rng.randint(12, 26))] for _ in range(6)]
    texts = [" ".join(t) for t in long] + [" ".join(rng.sample(t, 3)) for t in long] + [long[0][0]]
    texts += [" ".join(word() if rng.random() < share else w for w in t) for t in long for share in (0.02, 0.1, 0.2)]
    titles = [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(12)]
    texts += titles + [t[:k] + rng.choice("abc") + t[k + 1 :] for t in titles for k in [rng.randrange(len(t))]] + [t.replace(" ", "", 1) for t in titles]
    texts = sorted({" ".join(t.split()) for t in texts if t.strip()})
    items = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, at int, norm string")
    for least in (85.0, 92.0):
        want = {(i, j) for j in range(len(texts)) for i in range(j) if brute_ratio(texts[i], texts[j]) >= least}
        assert {(r.a, r.b) for r in fuzzy.fuzzy_links(items, least).collect()} == want and len(want) > 20
        assert all((fuzzy.ratio_of(texts[i], texts[j], least) >= least) == ((i, j) in want) for j in range(len(texts)) for i in range(j))


def test_fuzzy_candidates_share_more_than_a_word(spark):
    """Any two items share one rare word and nothing else: no pair has its texts compared."""
    texts = [" ".join(f"word{min(i, j)}x{max(i, j)}" for j in range(40) if j != i) for i in range(40)]
    items = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, at int, norm string")
    for least in (85.0, 92.0):
        assert fuzzy.candidate_pairs(items, least).count() == 0


def test_fuzzy_links_of_misspelt_texts(spark, monkeypatch):
    """Long items in which most words are misspelt, joined or parted share few words; in one block and in many, and where many have the same weight."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))
    spoil = lambda w: (lambda k: w[:k] + rng.choice(["", w[k] + "r"]) + w[k + 1 :])(rng.randrange(1, len(w)))
    long = [[word() for _ in range(rng.randint(20, 60))] for _ in range(8)]
    texts = [" ".join(t) for t in long] + [" ".join(spoil(w) if rng.random() < share else w for w in t) for t in long for share in (0.4, 0.7, 1.0)]
    texts += [" ".join(t).replace(" ", "", len(t) // 2) for t in long] + [" ".join(t[:5]).replace(" ", "\u00a0") for t in long] + [" ".join(t[:5]) + " x" for t in long]
    texts += [" ".join("".join(rng.choice("ab") for _ in range(4)) for _ in range(6)) for _ in range(60)]
    texts = sorted(set(texts))
    items = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, at int, norm string")
    for least in (85.0, 92.0):
        want = {(i, j) for j in range(len(texts)) for i in range(j) if brute_ratio(texts[i], texts[j]) >= least}
        few = {p for p in want if len(set(texts[p[0]].split()) & set(texts[p[1]].split())) < 3 and min(len(texts[k]) for k in p) > 100}
        assert few and {(r.a, r.b) for r in fuzzy.fuzzy_links(items, least).collect()} == want
        with monkeypatch.context() as m:
            m.setattr(fuzzy, "BLOCK", 300)
            m.setattr(fuzzy, "CELLS", 30)
            assert {(r.a, r.b) for r in fuzzy.fuzzy_links(items, least).collect()} == want


def test_semantic_recall_and_candidates(spark, sf, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    wide = len(rows[0][1])
    near = [(1000 + k, (np.array(v) + rng.normal(0, np.linalg.norm(v) * 0.5 / wide**0.5, wide)).tolist()) for k, (_, v) in enumerate(rows)]
    rows += near + [(10_000, [0.0] * wide), (10_001, [2 * x for x in rows[0][1]]), (10_002, None), (10_003, rows[1][1]), (10_004, [float("nan")] * wide), (10_005, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("at", -F.col("id"))
    real = [(i, v) for i, v in rows if v and len(v) == wide and np.any(v) and np.isfinite(v).all()]
    x = np.array([v for _, v in real])
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    alike = {(real[j][0], real[k][0]) for k in range(len(real)) for j in range(k) if cos[j, k] >= 0.88}
    pairs = {(r.x, r.y) for r in fuzzy.semantic_pairs(df, 0.88).collect()}
    assert len(alike & pairs) >= 0.9 * len(alike) > 90 and len(pairs) < 0.05 * len(rows) * (len(rows) - 1) / 2
    kept = []
    for k in range(len(real)):
        if not any(cos[k, j] >= 0.88 for j in kept):
            kept.append(k)
    gone = {i for i, _ in real} - {real[k][0] for k in kept}
    got = {r.id for r in fuzzy.dedupe_semantic(df).collect()}
    assert len(gone - got) >= 0.9 * len(gone) and not (got & {10_001, 10_003}) and got >= {10_000, 10_002, 10_004, 10_005}
    monkeypatch.setattr(fuzzy, "CROWD", 4)  # buckets of near copies are split, pairs stay
    split = {(r.x, r.y) for r in fuzzy.semantic_pairs(df, 0.88).collect()}
    assert len(alike & split) >= 0.9 * len(alike)
    assert fuzzy.dedupe_semantic(df.limit(0)).count() == 0


def test_semantic_writes_only_shared_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, rng.standard_normal(64).tolist()) for k in range(60)] + [(60, [1.0] * 64), (61, [1.0] * 63 + [1.1]), (62, [1.0] * 63 + [0.9])], "id long, embedding array<double>")
    written, real = [], fuzzy.checkpointed
    monkeypatch.setattr(fuzzy, "checkpointed", lambda d: (lambda out: written.append(out.count()) or out)(real(d)))
    pairs = {(r.x, r.y) for r in fuzzy.semantic_pairs(df, 0.88).collect()}
    assert pairs >= {(60, 61), (60, 62), (61, 62)} and sum(written) < 10 * 63  # a row a vector and table


def test_cluster_lists_read_texts_once(spark):
    rows = [(1, datetime(2024, 1, 1), "x", ["b", "a"], ["s"]), (2, datetime(2024, 1, 2), "x", ["c", "b"], []), (3, datetime(2024, 1, 1), "y", [], ["t"])]
    items = spark.createDataFrame(rows, "external_id long, published_at timestamp, text string, tickers array<string>, themes array<string>")
    d = evidence.cluster_lists(items, F.sha2("text", 256), {"tickers": 2, "themes": 8})
    assert sorted((r.tickers, r.themes) for r in d.collect()) == [([], ["t"]), (["c", "b"], ["s"])]
    assert "sha2" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_plain_text_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(text, "TEXTS", 2)
    texts = ["a &amp; b", None, "ﬁ", "", "plain", "&lt;", "Ａ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    assert [r.p for r in df.select("id", text.plain_text("t").alias("p")).orderBy("id").collect()] == ["a & b", None, "fi", "", "plain", "<", "A"]


def test_first_independent_is_greedy(spark):
    rng = random.Random(11)
    links = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a < b} | {(k, k + 1) for k in range(60, 80)}
    kept = []
    for k in range(81):
        if not any((j, k) in links for j in kept):
            kept.append(k)
    got = fuzzy.first_independent(spark.range(81), spark.createDataFrame(sorted(links), "a long, b long")).where("kept").collect()
    assert sorted(r.id for r in got) == kept


def test_quota_is_greedy(spark):
    rng = random.Random(12)
    edges = {(rng.randrange(6), rng.randrange(100, 107)): rng.randrange(40) for _ in range(60)}
    taken = []
    for (s, t), v in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        if len(taken) < 8 and sum(x == s for x, _ in taken) < 2 and sum(y == t for _, y in taken) < 2:
            taken.append((s, t))
    got = ranking.two_sided_quota(spark.createDataFrame([(s, t, v) for (s, t), v in edges.items()], "source int, target int, score int"), "score").collect()
    assert [(r.source, r.target) for r in got] == taken and ranking.two_sided_quota(spark.createDataFrame([], "source int, target int, score int"), "score").count() == 0


def test_text_scalars(spark):
    odd = ["Ａｃｍｅ &amp; Co", "café é", None, "plain", "a​b  c\n\n d", "&lt;b&gt;", "ﬁne …"]
    got = values(spark, text.plain_text(F.col("t")), [(t,) for t in odd], "t string")
    assert got == [None if t is None else unicodedata.normalize("NFKC", html.unescape(t)) for t in odd]
    assert values(spark, text.clean_text(F.col("t")), [("a​b  c\n\n d",), ("&amp;  x",)], "t string") == ["ab c\nd", "& x"]
    assert values(spark, text.truncate(F.col("t"), 5), [("abcdefg",), ("abcde",), (None,)], "t string") == ["abcd…", "abcde", None]
    assert values(spark, cleaning.cut_words(F.col("t"), 8), [("ab cdef ghij",), ("abcdefghijk",), ("ab",)], "t string") == ["ab cdef...", "abcdefgh...", "ab"]
    assert values(spark, text.mask_secrets(F.col("t")), [("token=abc123 x",), ("no",)], "t string") == ["token=*** x", "no"]
    phrases = lambda t: values(spark, cleaning.phrase_clean(F.col("t"), [("a b c", "a c")]), [(t,)], "t string")[0]
    assert phrases("a b c  word word word x") == "a c word x" and phrases("저항 저항 구간") == "저항 구간" and phrases("é é") == "é é"
    rows = spark.createDataFrame([(1, "a\na\nb\na"), (2, ""), (3, None)], "external_id long, text string")
    assert sorted((r.external_id, r.k, r.line) for r in text.adjacent_duplicates(rows).collect()) == [(1, 0, "a"), (1, 2, "b"), (1, 3, "a"), (2, 0, "")]
    assert values(spark, evidence.krw_amount(F.col("t")), [("3조 1,200억원",), ("2조",), ("450억",), ("9,900백만원",), ("none",), (None,)], "t string") == [31200, 20000, 450, 99, None, None]
    assert values(spark, evidence.usd_amount(F.col("t")), [("$1.5 billion",), ("3M and 2B",), ("12억 달러",), ("700백만 달러",), ("x",)], "t string") == [1500, 2000, 1200, 700, None]


def test_daily_snapshot_is_made_of_its_parts(spark):
    rng, start = random.Random(2), datetime(2024, 1, 1)
    rows, price = [], 100.0
    for k in range(80):
        o, price = price, price * (1 + rng.uniform(-0.03, 0.03))
        rows.append(("s", start + timedelta(days=k), o, max(o, price) * 1.01, min(o, price) * 0.99, price, float(rng.randint(1, 99))))
    bars = spark.createDataFrame([*rows, *[("few", *r[1:]) for r in rows[:4]]], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    s = ind.snapshot(bars).collect()
    assert [r.symbol for r in s] == ["s"]
    last = lambda df, c: df.where("symbol = 's'").orderBy(F.desc("ts")).first()[c]
    assert s[0].rsi == last(ind.rsi(bars), "rsi") and s[0].atr == last(ind.atr(bars), "atr") and s[0].obv_daily == last(ind.obv_trends(bars), "obv_daily") and s[0].bb_pct == last(ind.bollinger(bars), "bb_pct") and s[0].trend_daily == last(ind.trends(bars), "trend_daily")
    closes = [r[5] for r in rows]
    diff = [b - a for a, b in zip(closes, closes[1:])][-14:]
    up, down = sum(max(x, 0) for x in diff) / 14, sum(max(-x, 0) for x in diff) / 14
    assert abs(s[0].rsi - (100 - 100 / (1 + up / down))) < 1e-9
    few = {r.symbol: r for r in ind.snapshot_4h(bars).collect()}
    assert few["few"].trend == "TOO_FEW" and few["few"].close is None and few["s"].bars == 80
    assert ind.macd(bars.where("symbol = 'few'")).where("macd is not null").count() == 0


def test_reviews_by_hand(spark):
    rows = [(1, "LONG", datetime(2024, 1, 1), 10.0, 11.0, 3), (2, "LONG", datetime(2024, 1, 9), 10.0, 11.0, 3), (3, "SHORT", datetime(2024, 1, 1), 10.0, 11.0, None), (4, "LONG", datetime(2024, 1, 1), None, 11.0, 0), (5, "LONG", None, 10.0, 11.0, 0)]
    d = review.review_state(spark.createDataFrame(rows, "id int, side string, created_at timestamp, entry double, price double, lag_days int"), F.lit("2024-01-10").cast("date"))
    got = {r.id: (r.state, None if r.return_pct is None else round(r.return_pct, 6), r.hit) for r in d.collect()}
    assert got == {1: ("evaluable", 10.0, 1), 2: ("pending", None, None), 3: ("evaluable", -10.0, 0), 4: ("no_price", None, None), 5: ("no_price", None, None)}


def test_alerts_and_indicators_over_batches(spark, tmp_path):
    picks = spark.createDataFrame([("p", "s", "LONG", 5.0, 20.0), ("q", "s", "LONG", 1.0, 30.0)], "id string, symbol string, side string, stop double, target double")
    schema = "symbol string, ts long, price double"
    for k, batch in enumerate(([("s", 1, 10.0), ("s", 2, 21.0), ("s", 3, 25.0)], [("s", 4, 31.0), ("s", 5, 40.0), ("s", 6, 22.0)], [("s", 0, 99.0), ("s", 7, 99.0)])):
        if k == 2:  # rows of earlier batches aren't read any more: they may be gone
            shutil.rmtree(f"{tmp_path}/out/rows/batch=0")
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = flows.alerts_once(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), picks, f"{tmp_path}/out")
    assert sorted((r.id, r.ts, r.alert) for r in got.collect()) == [("q", 4, "TARGET")]  # the first batch's row is gone, and late rows fire nothing again
    rng = random.Random(3)
    rows = [(s, k, rng.uniform(1, 9), float(rng.randint(1, 5))) for k in range(60) for s in "ab"]
    schema = "symbol string, ts long, close double, volume double"
    for cut in ((0, 30), (30, 78), (78, 120)):
        spark.createDataFrame(rows[slice(*cut)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
        got = flows.live_indicators(spark.readStream.schema(schema).parquet(f"{tmp_path}/bars"), f"{tmp_path}/live")
    whole = ind.obv(ind.rsi(spark.createDataFrame(rows, schema))).collect()
    key = lambda r: (r.symbol, r.ts, None if r.rsi is None else round(r.rsi, 6), round(r.obv, 6))
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, whole), key=str)


def test_reports_and_moments(spark):
    page = "<table><tr><th>x</th></tr><tr><td><a href='/r?1'>Growth <b>story</b></a></td><td><a href='/f/1.pdf'>PDF</a></td><td>2024.03.05</td><td>Alpha Sec</td></tr><tr><td>short</td></tr><tr><td>no link but a long enough cell</td><td>24.1.1</td><td>Beta</td></tr></table>"
    got = cleaning.report_rows(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string"), ["Alpha Sec"]).orderBy("k").collect()
    assert [(r.title, r.url, r.pdf_url, str(r.date), r.broker) for r in got] == [("Growth story", "/r?1", "/f/1.pdf", "2024-03-05", "Alpha Sec"), ("no link but a long enough cell", "", "", "None", "Beta")]
    moments = [("2024-03-05T10:00:00Z",), ("2024-03-05T10:00:00+09:00",), ("2024-03-05 10:00:00",), ("Tue, 05 Mar 2024 10:00:00 GMT",), ("Tue, 05 Mar 2024 10:00:00 +0900",), ("soon",), (None,)]
    at = values(spark, F.date_format(cleaning.parse_ts(F.col("t")), "dd HH"), moments, "t string")
    assert at == ["05 10", "05 01", "05 10", "05 10", "05 01", None, None]
    assert re.match("3d 4h", values(spark, cleaning.hold_period(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), [("2024-01-01 00:00:00", "2024-01-04 04:59:00")], "a string, b string")[0])


def test_noise_rules_by_hand(spark):
    noise = ["call 02-3770-5590 now", "(010-1234-5678)", "tel: 02 555", "☎ 1588-0000", "<a href='x'>more", "see ShowHashtag", "S&P 500 map of today", "원문: 기사", "first\n증권사 : x", "안녕하세요 연구원 홍길동입니다"]
    fine = ["revenue rose 10-12 percent in 2024-05-06", "the hotel sold rooms", "a label of 원문 inside", "3 < 4 and 5 > 2", "매수 의견 유지"]
    bad = cleaning.any_pattern(F.col("t"), cleaning.NOISE_PATTERNS)
    assert values(spark, bad, [(t,) for t in noise + fine], "t string") == [True] * len(noise) + [False] * len(fine)
    heads = [("[속보] [단독] ▶ 실적 호조", "실적 호조"), ("삼성전자 [Buy, TP 12,500원] 상향", "삼성전자 상향"), ("제목 하나 - 누구 외 *연합*", "제목 하나"), ("AAPL.US rose https://x.y/z", "(AAPL) rose"), ("문의 (02-3770-5590) 참고", "문의 참고")]
    assert values(spark, cleaning.clean_header(F.col("t")), [(t,) for t, _ in heads], "t string") == [w for _, w in heads]
    lines = spark.createDataFrame([(1, "keep <b>this</b> <a href='u'>link</a> tel:+82 2 ShowHashtag_x\ndrop me\n\n\n\nend")], "external_id long, text string")
    assert cleaning.final_clean(lines, ["^drop"]).first().text == "keep this   2\n\nend" or cleaning.final_clean(lines, ["^drop"]).first().text.startswith("keep this")
    assert values(spark, F.col("t").rlike(cleaning.AD_PATTERN), [("지금 VIP 입장 하세요",), ("정상 기사",)], "t string") == [True, False]


def test_contract_fields_by_hand(spark):
    rows = [
        ("<p>계약 금액</p> : 1조 2,000억원 계약상대방 : Acme & Co. (US) 계약 기간: 2024.1.5 ~ 2025-03-01 최근 매출액 대비 12.5 %", (12000.0, "Acme & Co. (US)", "2024-1-5", "2025-03-01", 12.5, False, False, "HIGH")),
        ("계약금액 $3.5 billion 정정", (3.5e9 * 1370 / 1e8, None, None, None, None, True, False, "HIGH")),
        ("매출액대비: 7% 계약기간 2024.01.01 계약 해지", (None, None, None, None, 7.0, False, True, "MEDIUM")),
        ("계약금액 미정 계약상대방 ---", (None, None, None, None, None, False, False, "LOW")),
        ("", (None, None, None, None, None, False, False, "LOW")), (None, (None, None, None, None, None, False, False, "LOW")),
        ("3조원 투자 계약금액 900백만원 x 매출액 대비 없음", (9.0, None, None, None, None, False, False, "HIGH")),
    ]
    got = cleaning.contract_fields(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string")).orderBy("i").collect()
    names = ("amount", "client", "contract_start", "contract_end", "revenue_share", "is_amendment", "is_cancellation", "confidence")
    for r, (_, want) in zip(got, rows):
        assert tuple(r[n] for n in names) == want, r


def test_report_lint_by_hand(spark):
    """Lines that have to be found, and lines that are fine."""
    text = "\n".join([
        "[Web발신]", "A +9.5% (가격만 움직임(이유 불명)) → 연결고리: B", "HD 4H -4.8% / 1D -3.2% ... 급등 후 약세", "SK 4H +2.1% ... 급락 후 상승", "SK 4H +2.1% 급등 후 유지", "LONG 관찰 후보", "최종점수: 53.0", "  최종점수: 81.0",
        "관망/추적 후보", "최종점수: 55.0", "현재 확인: 라이브 확인 미실행 — 통계만 참고", "현재 확인: 라이브 확인 미실행 — 통계만 참고", "계약 해지는 호재", "호재 뒤 해지", "수주  확정 수혜", "근거: 약함", "정상 문장",
    ])
    got = {(r.k, r.severity) for r in lint.lint(spark.createDataFrame([(1, text), (2, None), (3, "")], "external_id long, text string")).collect()}
    assert got == {(1, "HIGH"), (2, "HIGH"), (3, "HIGH"), (4, "HIGH"), (7, "MEDIUM"), (12, "HIGH"), (13, "HIGH"), (15, "HIGH"), (16, "LOW")}


def test_report_lint_looks_at_whole_lines(spark):
    """What a rule asks may stand thousands of characters from its phrase; rules of a name have each their own conditions."""
    far = "x" * 5000
    text = "\n".join([f"leau {far} und", f"und {far} leau", f"-4.8% {far} up", f"-4.8% {far} +1% up", f"{far} up -3%", "n: 60", "n" + "0" * 3000 + "60", "n" + "9" * 3000])
    rules = [lint.rule("both", "LOW", "leau", then="u n d"), lint.rule("up", "HIGH", "up", sign=-1), lint.rule("n", "LOW", "n", low=50.0, high=70.0), lint.rule("both", "LOW", "n:", low=1.0, high=2.0)]
    got = lint.lint(spark.createDataFrame([(1, text)], "external_id long, text string"), rules).collect()
    assert sorted((r.rule, r.k) for r in got) == [("both", 1), ("n", 6), ("n", 7), ("up", 3)]


def test_medians_of_a_hot_group(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("abc"), rng.choice([1.0, 2.5, rng.uniform(1, 50)])) for _ in range(2001)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0)]
    got = {r.sector: r.median for r in cards.group_medians(spark.createDataFrame(rows, "sector string, pe double"), "sector", "pe").collect()}
    assert got == {s: float(np.median([v for t, v in rows if t == s and v is not None])) for s in {t for t, v in rows if v is not None}}


def test_budget_against_the_loop(spark):
    rng = random.Random(5)
    for p, n, m in [(0, 0, 0), (3, 1, 0), (30, 20, 12), (5, 20, 12), (20, 5, 3), (1, 19, 12), (9, 10, 12), (10, 9, 12), (30, 0, 12), (0, 20, 12), (15, 14, 45)]:
        rows = [(k, b, rng.random()) for k, b in enumerate(["positive"] * p + ["negative"] * n + ["macro"] * m)]
        caps, total = {"macro": 44, "positive": 30, "negative": 20}, 40
        left = {"positive": min(p, 30), "negative": min(n, 20), "macro": min(m, 44)}
        while sum(left.values()) > total:
            b = "positive" if left["positive"] >= left["negative"] and left["positive"] else "negative" if left["negative"] else "macro"
            left[b] -= 1
        got = mentions.within_budget(spark.createDataFrame(rows, "id int, bucket string, score double"), caps, total).collect()
        want = {r[0] for b, n_left in left.items() for r in sorted((r for r in rows if r[1] == b), key=lambda r: -r[2])[:n_left]}
        assert {r.id for r in got} == want, (p, n, m)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()



def test_lint_checks_hits_before_anything_is_shuffled(spark):
    from tidemark.operators import lint

    df = lint.lint(spark.createDataFrame([(1, "a\nthe and\nthe and")], "external_id long, text string"), [lint.rule("p", "HIGH", "the and"), lint.rule("again", "LOW", "and", least=2)], {"main": ["De"]})
    assert sorted((r.rule, r.k, r.excerpt) for r in df.collect()) == [("again", 3, "the and"), ("p", 2, "the and"), ("p", 3, "the and")]
    assert "SortMergeJoin" not in plan_of(df) and "hashpartitioning(rule" not in plan_of(df)



def test_places_leave_a_worker_in_small_batches():
    """One batch of texts with 240,000 places, each with 200 characters around it."""
    import ahocorasick
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from tidemark.operators import terms

    book = ahocorasick.Automaton()
    book.add_word("ab", [("S", "ab", False, 0)])
    book.make_automaton()
    texts = ["ab xyz " * 400] * 600 + [None, ""]
    batch = pa.RecordBatch.from_pydict({"external_id": pa.array(range(602), pa.int64()), "text": pa.array(texts)})
    target = to_arrow_schema(T.StructType([T.StructField("external_id", T.LongType()), *terms.PLACES.fields]))
    out = list(terms.places_in(iter([batch]), book, target, 1, None, 80, 100, True))
    assert sum(b.num_rows for b in out) == 240_000 and max(b.nbytes for b in out) < 4_000_000
    assert [(r["external_id"], r["at"]) for b in out for r in b.select(["external_id", "at"]).to_pylist()] == [(k, 7 * n) for k in range(600) for n in range(400)]



def test_words_meet_terms_where_they_are_read(spark):
    from tidemark.operators import evidence

    items = spark.createDataFrame([(1, "a A a, b"), (2, "b a"), (3, ""), (4, None)], "external_id long, text string")
    terms = spark.createDataFrame([("a",), ("A a",), ("b a",), ("a a a b c",), ("a-a-A-b",), ("--",)], "term string")
    df = evidence.items_for_terms(items, terms)
    assert sorted(map(tuple, df.select("term", "external_id", "n").collect())) == [("A a", 1, 2), ("a", 1, 3), ("a", 2, 1), ("a-a-A-b", 1, 1), ("b a", 2, 1)]
    assert "SortMergeJoin" not in plan_of(df)



def test_snippets_of_many_lines(spark):
    from tidemark.operators import cleaning

    d = spark.range(3).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.concat(F.lit("line number "), (i / 2).cast("int").cast("string"))).alias("a"))
    began = time.monotonic()
    got = d.select(cleaning.snippets(F.col("a"), [r"number [02]$"], 2, 40).alias("s")).collect()
    assert [r.s for r in got] == [["line number 1", "line number 3"]] * 3 and time.monotonic() - began < 15



def test_latest_bars_are_told_by_one_sort(spark):
    import datetime

    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    bars = spark.createDataFrame([(s, day(k), 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k, 100.0) for s, n in (("a", 4), ("b", 5), ("c", 70)) for k in range(n)], "symbol string, ts date, open double, high double, low double, close double, volume double")
    for made, want in ((ind.snapshot, {("b", day(4)), ("c", day(69))}), (ind.screen, {("a", day(3)), ("b", day(4)), ("c", day(69))})):
        df = made(bars)
        assert {(r.symbol, r.ts) for r in df.collect()} == want
        assert plan_of(made(bars)).count("Sort [") == 1
    assert {(r.symbol, r.bars) for r in ind.snapshot_4h(bars).collect()} == {("a", 4), ("b", 5), ("c", 70)}



def test_ranges_are_doubled(spark):
    import datetime

    lows = [5.0, None, 3.0, 8.0, 1.0, 9.0, 9.0, None, 9.0, 9.0, 9.0, 9.0, 2.0]
    bars = spark.createDataFrame([(s, datetime.date(2024, 1, 1 + k), None if x is None else x + 4.0 + s, x, 7.0) for s in (1, 2) for k, x in enumerate(lows)], "symbol int, ts date, high double, low double, close double")
    for n in (1, 2, 5, 7, 8, 30):
        got = {(r.symbol, r.ts.day - 1): r.pos_52w for r in ind.position_52w(bars, n).collect()}
        for s in (1, 2):
            for k in range(len(lows)):
                seen = [x for x in lows[max(0, k - n + 1) : k + 1] if x is not None]
                want = (7.0 - min(seen)) / (max(seen) + 4.0 + s - min(seen)) * 100 if seen else None
                assert got[s, k] == (want if want is None else pytest.approx(want))
    assert "-251" not in plan_of(ind.position_52w(bars))
