"""Findings in written reports by a table of rules.

A rule begins with a phrase.  Which lines hold one is found by one automaton for all
rules; what else a rule asks is checked there and then on the whole line.  White space doesn't count.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.terms import HELD_CHARS, ROW_CHARS, automaton, dealt
from tidemark.sources.shared import checkpointed

#: What a rule may ask: ``then`` has to follow the phrase; ``sign`` of a percentage before it; the line stands in ``section``; the number
#: that follows lies from ``low`` to below ``high``; so many lines of the report have it (``least``, of which that one is reported).
SCHEMA = "rule string, severity string, phrase string, then string, sign int, section string, low double, high double, least int"


def rule(name: str, severity: str, phrase: str, then: str | None = None, sign: int | None = None, section: str | None = None, low: float | None = None, high: float | None = None, least: int = 1) -> tuple:
    return name, severity, phrase, then, sign, section, low, high, least


# Headings that open and close the section of candidates, and phrases that no report may hold.
SECTIONS = {"candidates": ["LONG 관찰 후보", "SHORT 관찰 후보"], "": ["관망/추적 후보", "⚠"]}
BANNED = ["Web발신", "보고서링크:", "국장 마이너리티 리포트", "안녕하세요", "IB 투자의견", "글로벌 투자 구루 일일 브리핑", "월가 주요 뉴스", "숏/매도 경계", "현재가 확인 불가", "수주 확정 수혜", "계약=매출 확정"]
CONTRADICTIONS = [("가격만 움직임(이유 불명)", "연결고리"), ("수주잔고", "반드시 상승"), ("정적 레지스트리", "신규 수주"), ("해지", "호재"), ("취소", "호재"), ("해지", "긍정"), ("취소", "긍정")]
WEAK = ["근거: 약함", "근거: 제거"]
ONCE = [("라이브 확인 미실행 — 통계만 참고", "HIGH"), ("원/달러", "MEDIUM")]
RULES = [
    *(rule(f"banned {p}", "HIGH", p) for p in BANNED),
    *(rule(f"{a} then {b}", "HIGH", a, then=b) for a, b in CONTRADICTIONS),
    rule("rise after a loss", "HIGH", "급등 후", sign=-1), rule("fall after a gain", "HIGH", "급락 후", sign=1),
    rule("low score among candidates", "MEDIUM", "최종점수:", section="candidates", low=50.0, high=70.0), rule("price scale", "MEDIUM", "기술데이터 스케일 불일치"),
    *(rule(f"weak {p}", "LOW", p) for p in WEAK), *(rule(f"repeated {p}", severity, p, least=2) for p, severity in ONCE),
]


def numbered_lines(reports: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """external_id, k (from 1), excerpt (the first 80 characters of the line), text (the line without white space) and section, that of the last heading up to it."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    lines = reports.select("external_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("k", "line"))
    lines = lines.select("external_id", (F.col("k") + 1).alias("k"), F.substring(F.trim("line"), 1, 80).alias("excerpt"), bare("line").alias("text"))
    opened = F.lit(None).cast("string")
    for name, headings in sections.items():
        for h in headings:
            opened = F.when(F.contains("text", F.lit("".join(h.split()))), name).otherwise(opened)
    within = Window.partitionBy("external_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(opened, ignorenulls=True).over(within))


PERCENT = re.compile(r"([+-]?)(?<![0-9])[0-9]+(?:\.[0-9]+)?%")
NUMBER = re.compile(r":?(-?[0-9]+(?:\.[0-9]+)?)")


def rules_met(text: str, section: str | None, book: ahocorasick.Automaton) -> list[tuple[str, str, int]]:
    """rule, severity and least of the rules that a line without white space meets, each rule of the table once.

    What follows a phrase may stand anywhere behind it, and the percentage is the last one anywhere before it."""
    met, last, ends, signs = {}, {}, None, []
    for end, rules in book.iter(text):
        for row in rules:
            name, phrase, severity, then, sign, wanted, low, high, least = row
            if row in met or wanted is not None and (section or "") != wanted:
                continue
            if then is not None:
                if then not in last:
                    last[then] = text.rfind(then)
                if last[then] <= end:
                    continue
            if sign is not None:
                if ends is None:
                    found = [(m.end(), -1 if m[1] == "-" else 1) for m in PERCENT.finditer(text)]
                    ends, signs = [e for e, _ in found], [v for _, v in found]
                before = bisect_right(ends, end + 1 - len(phrase))
                if not before or signs[before - 1] != sign:
                    continue
            if low is not None or high is not None:
                number = NUMBER.match(text, end + 1)
                value = float(number[1]) if number else None
                if value is None or low is not None and not value >= low or high is not None and value >= high:
                    continue
            met[row] = name, severity, least
    return list(met.values())


def lint(reports: DataFrame, rules: DataFrame | list[tuple] | None = None, sections: dict[str, list[str]] | None = None) -> DataFrame:
    """external_id, rule, severity, k and excerpt: what the rules find in reports (external_id, text).

    A line is reported once a rule; a rule of several lines once a report.  Null texts have no
    findings.  The headings that come later in ``sections`` win where a line has several.

    Hits are checked where they are found: only findings are shuffled."""
    spark = reports.sparkSession
    rules = RULES if rules is None else rules
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, SCHEMA)
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    table = table.select("rule", bare("phrase").alias("alias"), "severity", bare("then").alias("then"), "sign", "section", "low", "high", "least").where("alias <> '' and rule is not null")
    lines = numbered_lines(reports, SECTIONS if sections is None else sections)
    keys = ["external_id", "k", "excerpt"]
    schema = T.StructType([*(lines.schema[c] for c in keys), T.StructField("rule", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("least", T.IntegerType())])
    target, found = to_arrow_schema(schema), None
    for shipped in dealt(checkpointed(table)):

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, number=shipped._jbroadcast.id()) -> Iterator[pa.RecordBatch]:
            book = automaton(shipped, number)
            for batch in batches:
                at, rows = [], []

                def made(batch=batch, at=at, rows=rows) -> pa.RecordBatch:
                    own = [batch.column(c).take(pa.array(at, pa.int64())) for c in keys]
                    return pa.RecordBatch.from_arrays([*own, *(pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, list(target)[len(keys) :]))], schema=target)

                for i, (value, section) in enumerate(zip(batch.column("text"), batch.column("section"))):
                    text = value.as_py()
                    if not text or not len(book):
                        continue
                    new = rules_met(text, section.as_py(), book)
                    at.extend([i] * len(new)), rows.extend(new)
                    if len(rows) >= HELD_CHARS // ROW_CHARS:
                        yield made()
                        at.clear(), rows.clear()
                yield made()

        more = lines.mapInArrow(run, schema)
        found = more if found is None else found.unionByName(more)
    found = found.select("external_id", "rule", "severity", "least", "k", "excerpt").distinct()
    place = F.row_number().over(Window.partitionBy("external_id", "rule").orderBy("k"))
    return found.withColumn("place", place).where((F.col("least") <= 1) | (F.col("place") == F.col("least"))).select("external_id", "rule", "severity", "k", "excerpt")
