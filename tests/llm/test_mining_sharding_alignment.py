"""Hard negatives, shards and alignment against brute force, on unusual rows and on the smallest tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import alignment, hard_negatives, kd_shards, queries  # noqa: E402

BYTE, PIECE = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


# hard negatives


def brute_negatives(rows, anchors, positives, negatives, low, high):
    out = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        score = [(sum(x * y for x, y in zip(va, v)), i, lab == la) for i, lab, v in rows if i != a and len(v) == len(va)]
        best = sorted((-s, i) for s, i, own in score if own)[:positives]
        for s, p in best:
            window = sorted((-n, i) for n, i, own in score if not own and low * -s <= 100 * n <= high * -s)
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(window[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [(1 << 20, 1 << 18), (600, 64)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, cells):
    """Groups of equal vectors (ties), a label of nearly all rows, one of a single row, and few rows a block."""
    monkeypatch.setattr(hard_negatives, "ROW_CELLS", cells[0]), monkeypatch.setattr(hard_negatives, "ANCHOR_CELLS", cells[1])
    monkeypatch.setattr(hard_negatives, "SAMPLE", 40 if cells[0] == 600 else 4096)
    gen = np.random.default_rng(5)
    rows = [(i, "lone" if i == 7 else "hot" if gen.random() < 0.6 else str(gen.integers(3)), gen.integers(-90, 90, 20).tolist()) for i in range(300)]
    rows = [(i, lab, rows[3][2] if i % 6 == 1 else v) for i, lab, v in rows]
    rows += [(400 + k, "short", [5, k]) for k in range(6)] + [(450, "other", [4, 4]), (451, "x", []), (452, "y", [])]
    frame = spark.createDataFrame(rows, "vec_id long, label string, v array<long>").repartition(5)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 4 == 0, positives=3, negatives=2, low=40, high=97)
    want = brute_negatives(rows, {i for i, _, _ in rows if i % 4 == 0}, 3, 2, 40, 97)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_rows_that_take_no_part(spark):
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.3, 0.4], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 1), (8, [1.0, 1.0], None), (9, [1e30, 1.0], 2), (10, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash")).withColumn("rank", F.lit(1))
    taken = hard_negatives.quantised(frame, 256)
    assert {r.vec_id for r in taken.collect()} == {0, 1, 2, 10}
    got = hard_negatives.hard_negatives(taken, F.col("vec_id") % 50 == 0)
    # 0 and 1: 128 * 128 + 128 * 102 = 29440; 0 and 2: 128 * 76 + 128 * 102 = 22784, that is 77 percent
    assert list(map(tuple, got.collect())) == [(0, 1, 1, 2, 29440, 22784)]
    assert hard_negatives.hard_negatives(taken.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_large_components_are_exact(spark):
    rows = [(0, "a", [1 << 29, 3]), (1, "a", [(1 << 29) + 1, 1]), (2, "b", [(1 << 28) + 1, 7]), (3, "b", [(1 << 28) + 1, 8])]
    frame = spark.createDataFrame(rows, "vec_id long, label string, v array<long>")
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, {0}, 5, 3, 50, 95)


@pytest.mark.parametrize("least", [-1.0, 0.0, 50.0, 120.0, 1e9])
def test_index_loses_no_row(least):
    gen = np.random.default_rng(2)
    x = (gen.normal(0, 30, (500, 37)) * gen.gamma(1, 1, 37)).astype(np.int64).astype(np.float64)
    index = hard_negatives.BlockIndex(x, least)
    for q in x[:20]:
        bar = max(least, 1.0) * np.sqrt((q * q).sum())
        if least < 0:
            bar = -2000
        rows, score = index.find(q, int(bar) + 1)
        want = np.flatnonzero(x @ q >= int(bar) + 1)
        assert sorted(rows.tolist()) == want.tolist() and (score == (x @ q)[rows]).all()
    assert least != 50.0 or index.left_out.max() > 0


# shards


def held(placed, docs, shards, law=1.02):
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()), key=str)
    got = placed.collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    slots, loads = {}, [0] * shards
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads) <= law * sum(loads) / shards, loads
    return got


def test_shards_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = held(kd_shards.shard_documents(docs, 16), docs, 16, 1.1)
    of = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        of.setdefault(texts[r.doc_id], []).append(r)
    quarter = sum(r.size for r in got) / 16 / 4
    whole = [own for own in of.values() if len(own) > 1 and sum(r.size for r in own) <= quarter]
    assert all(len({r.shard for r in own}) == 1 for own in whole) and len(whole) > 20


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_hot_group_and_constant_metadata(spark, shards, monkeypatch):
    """A third of the rows are one text, another third are empty, all metadata are equal but for nulls."""
    monkeypatch.setattr(kd_shards, "NUMBERED", 500)
    random.seed(3)
    rows = [(i % 2500, "the same text everywhere" if i % 3 == 0 else None if i % 6 == 1 else "" if i % 3 == 1 else "w" * random.randrange(60) + str(i), "en" if i % 5 else None, None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("shard", "slot", "size", "hash", "at", "node", "rid", "weight", "__piece")}).repartition(6)
    held(kd_shards.shard_documents(docs, shards), docs, shards, 1.03)


def test_shards_cut_what_is_widest(spark):
    """Two clusters along one dimension: no shard holds rows of both."""
    rows = [(i, f"text {i:05}", 0 if i % 2 else 1000, i % 7) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, far long, near long")
    got = {r.doc_id: r.shard for r in kd_shards.shard_documents(docs, 4, dims=("far", "near")).collect()}
    assert not {got[i] for i in range(0, 800, 2)} & {got[i] for i in range(1, 800, 2)}


def test_shards_of_few_rows_and_dimensions_of_all_kinds(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a" * 5000), (None, "b"), (2, None)], "doc_id long, text string")
    docs = docs.withColumns({"d": F.to_date(F.lit("2024-01-01")), "m": F.to_timestamp(F.lit("2024-01-01")), "x": F.lit(float("nan")), "flag": F.lit(True)})
    placed = kd_shards.shard_documents(docs, 3, dims=("d", "m", "x", "flag", "missing"), carry=("text", "d"))
    assert {r.row.text for r in placed.collect()} == {"a" * 5000, "b", None} and len({r.shard for r in placed.collect()}) > 1
    assert kd_shards.shard_documents(docs.limit(0), 4).collect() == []
    with pytest.raises(ValueError):
        kd_shards.coordinate("v", docs.withColumn("v", F.array()).schema["v"].dataType)
    kd_shards.write_shards(docs, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3 and set(back.columns) == {"slot", "size", "row", "shard"}


def test_loads_are_filled_up():
    assert kd_shards.room([5, 0, 0], 7) == [0, 3.5, 3.5]
    assert kd_shards.room([1, 2, 3], 6) == [3, 2, 1]
    placed, loads = kd_shards.place_large([(100, 10), (30, 1)], 2, 160)
    assert sum(loads) == 130 and len(placed[0]) == 5 and len(placed[1]) == 1


# alignment


def brute_alignment(texts):
    first = Tokenizer.from_file(BYTE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    names = alignment.aligner(BYTE, PIECE)
    rows, count = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        x, y = [names.a.bytes_of[i] for i in a], [names.b_bytes[i] for i in b]
        if not text or b"".join(x) != raw or b"".join(y) != raw:
            rows.append((0, 0, 0, "", Counter()))
            continue
        ends = [np.cumsum(list(map(len, t))).tolist() for t in (x, y)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        begin = [[0, *e[:-1]] for e in ends]
        links = Counter((p, q) for p, s, t in zip(a, begin[0], ends[0]) for q, u, v in zip(b, begin[1], ends[1]) if s < v and u < t)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
        count.update(links.keys())
    most = {}
    for (p, _), n in count.items():
        most[p] = max(n, most.get(p, 0))
    return [(a, b, g, sum(links.values()), sum(k for p, k in links.items() if count[p] == most[p[0]]), sum(count[p] * k for p, k in links.items()), sha) for a, b, g, sha, links in rows]


ODD = [
    None, "", " ", "  ", "a", "a  b", "a\n\nb c\nd", "\ttab x", " lead", "trail ", "x ▁ y", "<|endoftext|> a <s> b </s>", "nul \x00 b", "é ǆ é İ", "日本語 のテキスト", "😀 a😀", "don't 's a's",
    "a \x1c b", "x\u0085y z w", "\r\n a\r\nb", "   many    spaces  here   ", "a" * 300 + " " + "é" * 300, "<0x0A> ​ ﻿ bom", "copy of a text", "copy of a text", "copy of a text", "word " * 4000,
]


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE_PAIRS, 20])
def test_alignment_of_odd_texts(spark, slice_pairs):
    rows = [(None if i == 4 else i // 2, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "pairs", "copies", "n_a")}).repartition(3)
    got, counts = alignment.alignments(docs, BYTE, PIECE, slice_pairs)
    want = [(k, *m) for (k, _), m in zip(rows, brute_alignment(ODD))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert slice_pairs > 20 or counts.count() > 2 * slice_pairs
    assert alignment.alignments(docs.limit(0), BYTE, PIECE)[0].collect() == []


def test_alignment_of_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(alignment, "GATHER", 5000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("n_chars < 3000").collect()]
    got, _ = alignment.alignments(docs.where("n_chars < 3000"), BYTE, PIECE)
    assert sorted(map(tuple, got.collect())) == sorted((k, *m) for (k, _), m in zip(rows, brute_alignment([t for _, t in rows])))


def test_forgetting_changes_nothing(monkeypatch):
    texts = [t for t in ODD if t and len(t) < 1000]
    whole = alignment.Aligner(BYTE, PIECE)
    want = [whole.measure([t]) for t in texts]
    monkeypatch.setattr(alignment, "PIECES", 8)
    few = alignment.Aligner(BYTE, PIECE)
    assert [few.measure([t]) for t in texts] == want
    assert few.measure(texts)["groups_sha256"] == [w["groups_sha256"][0] for w in want]
    monkeypatch.setattr(alignment, "MEMO_BYTES", 5000)  # few pieces that are long are forgotten too
    long = alignment.Aligner(BYTE, PIECE)
    for k in range(40):
        long.measure(["  ".join(f"{k} word{j}" for j in range(200))])
    assert long.chars < 30_000 and len(long.number) == len(long.groups) == len(long.figures) == len(long.uses)
