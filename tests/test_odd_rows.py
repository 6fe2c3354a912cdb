"""Queries against their SQL on rows that the given tables don't have."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from brightmill.plans import registry
from tests.test_oracles import rows

START = datetime(2024, 1, 1)
EVENTS = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])


def events(folder, values):
    """Stores (time, value, key) as the events table of a folder."""
    records = [(i, ts, i % 3, "view", value, f'{{"k": {"null" if k is None else k}}}') for i, (ts, value, k) in enumerate(values)]
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*records), EVENTS)], schema=EVENTS), f"{folder}/events.parquet")


def assert_equals_sql(spark, folder, name, table):
    df = registry.queries()[name](spark, str(folder))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    expected = duck.sql(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_key_limits_round_to_milliseconds(spark, tmp_path):
    at = lambda start, *micros: [(start + timedelta(microseconds=m), 1.0, 1) for m in micros]
    day = 86_400_000_000
    events(tmp_path, at(START, 0, 499, 500, 1499, 1500, day + 400, day + 499, day + 500, day + 1499, day + 1500) + at(datetime(1969, 12, 1), 0, 500, 501, 1500, day + 499, day + 500, day + 1500))
    assert_equals_sql(spark, tmp_path, "t3_key_limits", "events")


CONVERSATIONS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
TITLE_PIECES = (
    "[TITLE]", "[/TITLE]", "[titre]", "[/TITRE]", "<TÍTULO>", "</título>", "[ЗАГОЛОВОК]", "[/заголовок]", "[/ЗАГОЛОᲀОК]", "[TıTLE]", "[TİTLE]", "[/b ", "</", "[a", "]", "<", ">", "#", "*", '"', "'", ".", "..", "\n", "\r", "\v", "\f", "\t",
    "\x85", "\xa0", " ", " ", " ", "  ", "word", "été", "\U0001f600", "a b c d e f g", "x" * 40, "",
)


def conversations(folder, values):
    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values), CONVERSATIONS)], schema=CONVERSATIONS), f"{folder}/conversations.parquet")


def test_titles_of_any_text(spark, tmp_path):
    rng = random.Random(7)
    texts = ["[TITLE] [/TITLE] body", "[TITLE]a [/b [/TITLE]", "[TITLE]a\rb[/TITLE]", "[TITLE]a\nb[/TITLE]", '"a title"\n', "a title.\n", "[TıTLE]x[/TITLE]", None]
    texts += ["".join(rng.choices(TITLE_PIECES, k=rng.randint(0, 9))) for _ in range(3000)]
    values = [(i // 3, 22 * (i % 3), rng.choice(("user", "user", "assistant", None)), t) for i, t in enumerate(texts)]  # conv_id 0 has no phrase
    values += [(2, 66, "user", "later"), (4, 66, "user", None), (4, 88, "user", "first with a text"), (6, None, "user", "x"), (None, 0, "user", "y"), (-1, 0, "user", "z"), (-2, 1, "user", "z"), (-4, 1, "user", "z")]
    conversations(tmp_path, values)
    assert_equals_sql(spark, tmp_path, "x7_x8_x9_titles", "conversations")


def test_an_empty_text_before_the_first_one(spark, tmp_path):
    conversations(tmp_path, [(2, 0, "user", None), (2, 1, "user", "a text"), (2, 2, "assistant", "b")])
    assert_equals_sql(spark, tmp_path, "x7_x8_x9_titles", "conversations")


def test_a_title_that_ends_in_a_line_break(spark, tmp_path):
    conversations(tmp_path, [(2, 0, "user", "a" * 58 + ".\n and more"), (4, 0, "user", "b" * 58 + '"\nmore'), (4, 1, "assistant", '[TITLE]"c."[/TITLE]')])
    assert_equals_sql(spark, tmp_path, "x7_x8_x9_titles", "conversations")


def odd_events():
    """Many at the same moment, at window edges to within a millisecond, without a time, a value or a key, before 1970, and one busy key."""
    rng = random.Random(3)
    lengths = [0, 3_600_000, 43_200_000, 86_400_000, 7 * 86_400_000]
    values = []
    for k in (1, 2, 3, None):
        for start in (START, datetime(1969, 12, 28)):
            base = [rng.randrange(20) * 1_800_000 for _ in range(12)]
            moments = [b + rng.choice(lengths) + rng.choice((-1, 0, 0, 1)) for b in base for _ in range(6)]
            values += [(start + timedelta(milliseconds=m, microseconds=rng.choice((0, 0, 499, 500))), rng.choice((0.0, 1.0, 80.0, -5.0, None)), k) for m in moments]
    values += [(START, 1.0, 4)] * 16 + [(START + timedelta(days=7), 1.0, 4)] * 2 + [(START + timedelta(days=7, milliseconds=1), 1.0, 4)]
    values += [(None, 1.0, k) for k in (1, 1, 1, 2, None, None)] + [(START, 2.0, 5), (None, None, 5)]
    rng.shuffle(values)
    return values


def test_windows_that_a_key_has_reached(spark, tmp_path):
    events(tmp_path, odd_events())
    assert_equals_sql(spark, tmp_path, "t3_key_limits_of_all_windows", "events")


def plan(spark, folder, name):
    return registry.queries()[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString()


def busy_key(folder):
    """Fifty thousand requests of one key in an hour."""
    events(folder, [(START + timedelta(milliseconds=72 * i), 1.0, 1) for i in range(50_000)])


def test_reached_windows_of_a_busy_key(spark, tmp_path):
    busy_key(tmp_path)
    assert not re.search(r"RangeFrame, -\d", plan(spark, tmp_path, "t3_key_limits_of_all_windows"))  # a sliding frame is counted anew for each row
    assert_equals_sql(spark, tmp_path, "t3_key_limits_of_all_windows", "events")


def test_requests_and_tokens_of_a_day(spark, tmp_path):
    events(tmp_path, odd_events())
    assert_equals_sql(spark, tmp_path, "t3_key_limits", "events")


def test_requests_and_tokens_of_a_busy_key(spark, tmp_path):
    busy_key(tmp_path)
    assert not re.search(r"RangeFrame, -\d", plan(spark, tmp_path, "t3_key_limits"))
    assert_equals_sql(spark, tmp_path, "t3_key_limits", "events")
