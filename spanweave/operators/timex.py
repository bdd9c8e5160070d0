"""Time expressions of English and German texts: found by a finite-state matcher over classes of tokens, with a type and a value.

Each token becomes one letter, its class, by a look into a word list; the rules are regular expressions over a text's string of classes. A text's
expressions are found in its own row, so nothing is shuffled and texts that share a doc_id stay apart. Values
are dates reckoned from the document's reference time in its zone, by Spark's own date functions: DATE 2024-03-12, 2024-W11, 2024-03 or
2024; TIME 2024-03-12T14:30; DURATION P3D, PT2H; SET P1W or XXXX-WXX-1.

A date without a year takes the reference's; a bare weekday is the coming one, the reference's own day included; `next` and `last` go by whole weeks,
months and years, and to the weekday after or before the reference day. A day that no month has gives a null value. A null text has no row; a null
reference gives null values where one is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.session import ship_package

TOKEN = r"\d+|[^\W\d_]+|[^\w\s]"
_UNITS = "second seconds sekunde sekunden|minute minutes minuten|hour hours stunde stunden|day days tag tage tagen|week weeks woche wochen|month months monat monate monaten|year years jahr jahre jahren"
#: class letter: groups of words, of which the k-th has the value k + the number.
WORDS = {
    "M": ("january januar jan|february februar feb|märz maerz march mrz|april apr|mai|june juni jun|july juli jul|august aug|september sep|october oktober okt oct|november nov|december dezember dez dec", 1),
    "W": ("monday montag|tuesday dienstag|wednesday mittwoch|thursday donnerstag|friday freitag|saturday samstag sonnabend|sunday sonntag", 1),
    "D": ("vorgestern|yesterday gestern|today heute|tomorrow morgen|übermorgen uebermorgen", -2),
    "U": (_UNITS, 0),
    "n": ("one ein eine einer einem einen|two zwei|three drei|four vier|five fünf|six sechs|seven sieben|eight acht|nine neun|ten zehn|eleven elf|twelve zwölf", 1),
    "L": ("last letzten letzte letzter letztes vorigen vorige|this diesen diese dieser dieses|next nächsten nächste nächster nächstes kommenden kommende", -1),
    "V": ("vor||in", -1),
    "Q": ("daily täglich taeglich|weekly wöchentlich woechentlich|monthly monatlich|yearly annually jährlich jaehrlich", 3),
    "E": ("every each jeden jede jeder jedes", 0), "A": ("ago", 0), "F": ("for during seit lang", 0), "O": ("uhr clock", 0), "P": ("am|pm", 0), "T": ("st nd rd th", 0), "o": ("of", 0), "m": ("may", 5),
}
#: rule: classes. N is a number of one or two digits, Y one of four, x any other token; marks stand for themselves. The first that fits wins.
RULES = {
    "iso": r"Y-N-N", "dotted": r"N\.N\.Y?", "day_month": r"N[.T]?o?[Mm](?:,?Y)?", "month_day": r"[Mm]N(?![:.])T?(?:,?Y)?", "month_year": r"[Mm],?Y", "clock": r"N:N(?::N)?[PO]?|N[PO]",
    "every": r"E[Nn]?[UW]|Q", "shift": r"[Nn]UA|V[Nn]U", "lasting": r"F?[Nn]UF?", "next": r"L[WU]", "weekday": r"W", "day": r"D", "month": r"M", "year": r"Y",
}
TYPES = {"clock": "TIME", "every": "SET", "lasting": "DURATION"}


def word_classes() -> list[tuple[str, str, int]]:
    """(word, class, value)."""
    return [(w, c, first + k) for c, (groups, first) in WORDS.items() for k, group in enumerate(groups.split("|")) for w in group.split()]


_TOKENS = re.compile(TOKEN)
_RULES = re.compile("|".join(f"(?P<{k}>{v})" for k, v in RULES.items()))
_KNOWN = {w: (c, v) for w, c, v in word_classes()}
#: Values that the rules take from an expression's tokens: the first of one or two classes, N2 the second number.
VALUES = ("N", "N2", "Nn", "U", "W", "Mm", "Y", "V", "L", "D", "P", "Q", "colon")
_NAMES = {"N": ("N", "Nn"), "n": ("Nn",), "M": ("Mm",), "m": ("Mm",), ":": ("colon",)}
#: Rows given on at once.
CHUNK = 10_000


def _classed(token: str) -> tuple[str, int | None]:
    if token.isascii() and token.isdigit():
        return {1: "N", 2: "N", 4: "Y"}.get(len(token), "x"), int(token) if len(token) <= 4 else None
    return (token, None) if token in ".,:-/" else _KNOWN.get(token.lower(), ("x", None))


def _found(text: str) -> Iterator[tuple]:
    """(begin, end, text, rule, VALUES) of each expression."""
    tokens = list(_TOKENS.finditer(text))
    classed = [_classed(m[0]) for m in tokens]
    for m in _RULES.finditer("".join(c for c, _ in classed)):
        values: dict[str, int | None] = {}
        for c, v in classed[m.start() : m.end()]:
            if c == "N" and "N" in values:
                values.setdefault("N2", v)
            for name in _NAMES.get(c, (c,)):
                values.setdefault(name, v)
        begin, end = tokens[m.start()].start(), tokens[m.end() - 1].end()
        yield begin, end, text[begin:end], m.lastgroup, *[1 if k == "colon" and k in values else values.get(k) for k in VALUES]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expressions of docs (doc_id, now, text), with doc_id and now of their row."""
    types = [pa.int32(), pa.int32(), pa.string(), pa.string()] + [pa.int32()] * len(VALUES)
    names = ["doc_id", "now", "begin", "end", "text", "rule", *VALUES]

    def told(given: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*given.columns, *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]], names)

    for batch in batches:
        kept, at, rows = batch.select(["doc_id", "now"]), [], []
        column = batch.column("text")
        for i in range(len(column)):
            text = column[i].as_py()
            for row in _found(text) if text else ():
                at.append(i)
                rows.append(row)
            if rows and (len(rows) >= CHUNK or i == len(column) - 1):
                yield told(kept.take(pa.array(at)), rows)
                at, rows = [], []


def expressions(docs: DataFrame, reference: str = "reference_time", zone: str = "UTC") -> DataFrame:
    """(doc_id, begin, end, text, rule, type, value) of docs (doc_id, text, reference time: a timestamp)."""
    ship_package(docs.sparkSession)
    given = docs.select("doc_id", F.from_utc_timestamp(F.col(reference), zone).alias("now"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, now timestamp, begin int, end int, text string, rule string, " + ", ".join(f"{k} int" for k in VALUES)
    told = given.mapInArrow(_rows, schema)
    kind = F.when((F.col("rule") == "shift") & (_value("U") < 3), "TIME")
    for rule, name in TYPES.items():
        kind = kind.when(F.col("rule") == rule, name)
    return told.select("doc_id", "begin", "end", "text", "rule", kind.otherwise("DATE").alias("type"), _normalised().alias("value"))


def _value(classes: str, nth: int = 0) -> Column:
    """The value of the nth token of some classes, null if there is none."""
    return F.col(classes if nth == 0 else f"{classes}{nth + 1}")


def _date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd, null for a day that doesn't exist."""
    return F.date_format(F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), F.lit("yyyy-M-d")), "yyyy-MM-dd")


def _moved(now: Column, unit: Column, n: Column) -> Column:
    """A date some days, weeks, months or years on; a time some hours, minutes or seconds on."""
    day = now.cast("date")
    date = F.when(unit == 3, F.date_add(day, n)).when(unit == 4, F.date_add(day, n * 7)).when(unit == 5, F.add_months(day, n)).when(unit == 6, F.add_months(day, n * 12))
    seconds = F.element_at(F.array(F.lit(1), F.lit(60), F.lit(3600)), F.least(unit, F.lit(2)) + 1) * n
    time = F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + seconds), "yyyy-MM-dd'T'HH:mm")
    return F.when(unit < 3, time).otherwise(F.date_format(date, "yyyy-MM-dd"))


def _normalised() -> Column:
    now, day = F.col("now"), F.col("now").cast("date")
    number, unit, weekday, month, year = F.coalesce(_value("Nn"), F.lit(1)), _value("U"), _value("W"), _value("Mm"), F.coalesce(_value("Y"), F.year("now"))
    ahead = F.pmod(weekday - 1 - F.weekday(day), F.lit(7))
    week = lambda d: F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    period = lambda u, n: F.concat(F.when(u < 3, "PT").otherwise("P"), n.cast("string"), F.element_at(F.array(*[F.lit(x) for x in "SMHDWMY"]), u + 1))
    turn = _value("L")
    there = F.when(turn > 0, F.date_add(day, F.when(ahead == 0, 7).otherwise(ahead))).when(turn < 0, F.date_add(day, F.when(ahead == 0, -7).otherwise(ahead - 7))).otherwise(F.date_add(day, ahead))
    whole = F.when(unit == 4, week(F.date_add(day, turn * 7))).when(unit == 5, F.date_format(F.add_months(day, turn), "yyyy-MM")).when(unit == 6, F.date_format(F.add_months(day, turn * 12), "yyyy")).when(unit == 3, F.date_format(F.date_add(day, turn), "yyyy-MM-dd"))
    hour, minute, half = _value("N"), F.coalesce(F.when(F.col("colon").isNotNull(), _value("N", 1)), F.lit(0)), _value("P")
    hour = F.when(half.isNull(), hour).otherwise(hour % 12 + 12 * half)
    clock = F.when((hour <= 24) & (minute < 60), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))
    month_of = F.when(month.between(1, 12), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))
    every = F.when(weekday.isNotNull(), F.concat(F.lit("XXXX-WXX-"), weekday.cast("string"))).otherwise(period(F.coalesce(unit, _value("Q")), number))
    values = {
        "iso": _date(_value("Y"), _value("N"), _value("N", 1)), "dotted": _date(year, _value("N", 1), _value("N")), "day_month": _date(year, month, _value("N")), "month_day": _date(year, month, _value("N")),
        "month_year": month_of, "month": month_of, "clock": clock, "every": every, "shift": _moved(now, unit, number * F.coalesce(_value("V"), F.lit(-1))), "lasting": period(unit, number),
        "next": F.when(weekday.isNotNull(), F.date_format(there, "yyyy-MM-dd")).otherwise(whole), "weekday": F.date_format(F.date_add(day, ahead), "yyyy-MM-dd"), "day": F.date_format(F.date_add(day, _value("D")), "yyyy-MM-dd"), "year": F.lpad(year.cast("string"), 4, "0"),
    }
    out = F.lit(None).cast("string")
    for rule, value in values.items():
        out = F.when(F.col("rule") == rule, value).otherwise(out)
    return out
