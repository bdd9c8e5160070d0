"""Match positions against re.finditer, speeches, and time expressions on fixtures."""

import re
from datetime import datetime

import pytest

from spanweave.operators import patterns, timex


def test_positions_equal_finditer(spark):
    texts = {1: "Ä1 b22 ccc333\nÜ4", 2: None, 3: "", 4: "none", 5: "😀7 " * 50}
    pattern = r"(?P<word>\w*?)(?P<num>\d+)(?P<not>!)?"
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id int, text string, `a.b` string")
    got = {(r.doc_id, r.n): (r.begin, r.end, r.match, r.groups) for r in patterns.positions(docs, pattern).collect()}
    want = {(i, n): (m.start(), m.end(), m[0], {k: v for k, v in m.groupdict().items() if v is not None}) for i, t in texts.items() for n, m in enumerate(re.finditer(pattern, t or ""))}
    assert got == want
    patterns.register(spark)
    docs.createOrReplaceTempView("some_docs")
    assert {(r.doc_id, r.n) for r in spark.sql(r"SELECT doc_id, n FROM some_docs, LATERAL find_all(text, '[0-9]+')").collect()} == set(want)
    with pytest.raises(re.error):
        patterns.positions(docs, "(")


def test_speeches(spark):
    text = "Beginn der Sitzung.\nPräsident: Guten Tag.\nWir fangen an.\nDr. Müller (SPD), Abgeordneter: Danke, Herr Präsident.\nMeyer: Nein!"
    docs = spark.createDataFrame([(1, text), (2, "nobody speaks here"), (3, None)], "doc_id int, text string")
    got = [(r.doc_id, text[r.begin : r.end].strip(), r.label, r.title, r["name"], r.party, r.role) for r in patterns.speeches(docs).orderBy("n").collect()]
    assert got == [
        (1, "Guten Tag.\nWir fangen an.", "Präsident", None, "Präsident", None, None), (1, "Danke, Herr Präsident.", "Müller, Abgeordneter", "Dr.", "Müller", "SPD", "Abgeordneter"), (1, "Nein!", "Meyer", None, "Meyer", None, None),
    ]
    assert len(text) == max(r.end for r in patterns.speeches(docs).collect())


#: Reference: Tuesday, 12 March 2024, 23:30 UTC; in Berlin it is already Wednesday.
CASES = [
    ("It was on 2024-02-29.", "UTC", [("2024-02-29", "DATE", "2024-02-29")]), ("on 2023-02-29", "UTC", [("2023-02-29", "DATE", None)]), ("am 3.10.1990 und am 24.12.", "UTC", [("3.10.1990", "DATE", "1990-10-03"), ("24.12.", "DATE", "2024-12-24")]),
    ("12. März 2021", "UTC", [("12. März 2021", "DATE", "2021-03-12")]), ("the 4th of July, 1776", "UTC", [("4th of July, 1776", "DATE", "1776-07-04")]), ("March 5, 2020 and May 7", "UTC", [("March 5, 2020", "DATE", "2020-03-05"), ("May 7", "DATE", "2024-05-07")]),
    ("You may go in June 1999 or in Oktober", "UTC", [("June 1999", "DATE", "1999-06"), ("Oktober", "DATE", "2024-10")]), ("today, tomorrow, vorgestern", "UTC", [("today", "DATE", "2024-03-12"), ("tomorrow", "DATE", "2024-03-13"), ("vorgestern", "DATE", "2024-03-10")]),
    ("heute", "Europe/Berlin", [("heute", "DATE", "2024-03-13")]), ("next Tuesday, last Monday, Friday", "UTC", [("next Tuesday", "DATE", "2024-03-19"), ("last Monday", "DATE", "2024-03-11"), ("Friday", "DATE", "2024-03-15")]),
    ("nächsten Mittwoch", "Europe/Berlin", [("nächsten Mittwoch", "DATE", "2024-03-20")]), ("last week, next month, letztes Jahr", "UTC", [("last week", "DATE", "2024-W10"), ("next month", "DATE", "2024-04"), ("letztes Jahr", "DATE", "2023")]),
    ("3 days ago and in two weeks", "UTC", [("3 days ago", "DATE", "2024-03-09"), ("in two weeks", "DATE", "2024-03-26")]), ("vor zwei Monaten, in 1 Stunde", "UTC", [("vor zwei Monaten", "DATE", "2024-01-12"), ("in 1 Stunde", "TIME", "2024-03-13T00:30")]),
    ("for three weeks, 2 Stunden lang", "UTC", [("for three weeks", "DURATION", "P3W"), ("2 Stunden lang", "DURATION", "PT2H")]), ("every Monday, jeden Tag, täglich, every 2 weeks", "UTC", [("every Monday", "SET", "XXXX-WXX-1"), ("jeden Tag", "SET", "P1D"), ("täglich", "SET", "P1D"), ("every 2 weeks", "SET", "P2W")]),
    ("um 14:30 Uhr, at 3 pm, um 8 Uhr, 12:15 am", "UTC", [("14:30 Uhr", "TIME", "2024-03-12T14:30"), ("3 pm", "TIME", "2024-03-12T15:00"), ("8 Uhr", "TIME", "2024-03-12T08:00"), ("12:15 am", "TIME", "2024-03-12T00:15")]),
    ("since 1999", "UTC", [("1999", "DATE", "1999")]), ("at 99:99", "UTC", [("99:99", "TIME", None)]), ("nothing of it, 123456", "UTC", []),
]


def test_time_expressions(spark):
    for zone in ("UTC", "Europe/Berlin"):
        mine = [(i, t, datetime(2024, 3, 12, 23, 30), w) for i, (t, z, w) in enumerate(CASES) if z == zone]
        docs = spark.createDataFrame([m[:3] for m in mine] + [(-1, None, None)], "doc_id int, text string, reference_time timestamp_ntz").selectExpr("doc_id", "text", "cast(reference_time AS timestamp) AS reference_time")
        got = {}
        for r in timex.expressions(docs, zone=zone).orderBy("begin").collect():
            got.setdefault(r.doc_id, []).append((r.text, r.type, r.value))
        for i, text, _, want in mine:
            assert got.get(i, []) == want, text


def test_time_expressions_of_a_text_are_found_in_its_row(spark):
    """Texts that share a doc_id are not read as one, and nothing is shuffled."""
    now = datetime(2024, 3, 12)
    docs = spark.createDataFrame([(1, "in 1999 on 3", now), (1, "May 2020; 14:30 Uhr", now), (None, "heute", now)], "doc_id int, text string, reference_time timestamp")
    found = timex.expressions(docs)
    got = sorted((r.doc_id or 0, r.begin, r.end, r.text, r.rule, r.value) for r in found.collect())
    assert got == [(0, 0, 5, "heute", "day", "2024-03-12"), (1, 0, 8, "May 2020", "month_year", "2020-05"), (1, 3, 7, "1999", "year", "1999"), (1, 10, 19, "14:30 Uhr", "clock", "2024-03-12T14:30")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
