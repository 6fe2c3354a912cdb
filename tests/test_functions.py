"""Golden scalars and the traps between the engines' defaults."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brightmill.functions import numeric as N
from brightmill.functions import text as T
from brightmill.functions.urls import normalize_url, url_problem
from brightmill.operators.relational import clamp


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("total, system, expected", [(0, None, 1), (5000, None, 5), (1500, None, 2), (5000, 3000, 2), (1000, 5000, 1), (1, None, 1)])
def test_credits_from_tokens(spark, total, system, expected):
    assert value(spark, N.credits_from_tokens(F.lit(total), None if system is None else F.lit(system))) == expected


@pytest.mark.parametrize("minutes, expected", [(0.0, 1), (2.0, 100), (0.5, 25)])
def test_credits_from_minutes(spark, minutes, expected):
    assert value(spark, N.credits_from_minutes(F.lit(minutes), F.lit(0.05))) == expected


def test_rounding(spark):
    assert [value(spark, N.round_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert [value(spark, N.round_up(F.lit(x))) for x in (0.5, 2.5, -2.5)] == [1, 3, -2]


def test_utf16_length(spark):
    assert value(spark, N.utf16_length(F.lit("a\U0001f600"))) == 3


def test_secret_needs_twenty_characters(spark):
    assert value(spark, T.redact_secrets(F.lit("x token_abcdefghijklmnopqrstuvwxyz"))) == "x [REDACTED]"
    assert value(spark, T.redact_secrets(F.lit("token_abcdefghij"))) == "token_abcdefghij"


@pytest.mark.parametrize("header, expected", [("203.0.113.50, 70.41.3.18", "203.0.113.50"), ("::ffff:203.0.113.50", "203.0.113.50"), ("203.0.113.50:8080", "203.0.113.50"), ("[::1]:8080", "::1"), ("", None)])
def test_client_ip(spark, header, expected):
    assert value(spark, T.header_ip(F.element_at(F.split(F.lit(header), ","), 1))) == expected


@pytest.mark.parametrize("remote, trusted, expected", [("10.0.0.1", ["10.0.0.1"], "203.0.113.50"), ("10.0.0.2", ["10.0.0.1"], "10.0.0.2"), ("10.0.0.2", [], "203.0.113.50"), ("", [], None), ("::ffff:10.0.0.1", ["10.0.0.1"], "203.0.113.50")])
def test_client_ip_behind_proxies(spark, remote, trusted, expected):
    assert value(spark, T.client_ip(F.lit(remote), F.lit("203.0.113.50, 1.1.1.1"), F.lit(None).cast("string"), F.array(*map(F.lit, trusted)).cast("array<string>"))) == expected


def test_providers_are_scrubbed_in_any_case(spark):
    assert value(spark, T.scrub_providers(F.lit("OpenAI and GROQ"), "X")) == "X and X"


def test_word_boundaries_are_ascii(spark):
    assert value(spark, T.is_spanish(F.lit("hola"))) and not value(spark, T.is_spanish(F.lit("holanda")))


def test_urls(spark):
    assert value(spark, normalize_url(F.lit("HTTP://A.com/x/?utm_source=a&q=1&ref=z#top"))) == "http://a.com/x/?q=1"
    assert value(spark, url_problem(F.lit("http://10.0.0.1/"))) == "private address"
    assert value(spark, url_problem(F.lit("https://example.com/"))) is None


def test_title_ladder(spark):
    title = lambda text, user: value(spark, T.title_of(F.lit(text), F.lit(user).cast("string")))
    assert title("[TITLE]A b[/TITLE] x", "user") == "A b"
    assert title("no tag here at all, really none", None) == "no tag here at all, really"
    assert title("short", None) == "New chat"


def test_clamp():
    assert clamp("7", 1, 720, 24) == 7 and clamp(None, 1, 720, 24) == 24 and clamp("9999", 1, 720, 24) == 720
