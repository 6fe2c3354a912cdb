"""The registered queries of the corpus operators on small tables with nulls, and their SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brightmill.llm import queries
from tests.llm.test_operators import brute_components, prose
from tests.llm.test_tokens import plain_scores


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(61)
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose(rng, 40)
    lines = "\n".join(prose(rng, 6) for _ in range(12))
    texts = [None, "", "\n", "a", f"{prose(rng, 30)} {item} {prose(rng, 30)}", item.upper(), lines, f"{prose(rng, 9)}\n{lines}\n{prose(rng, 9)}", prose(rng, 60), 'password = "Abcdefgh123"', "0123456789abcdef" * 2, prose(rng, 5000)]
    texts += [prose(rng, 40) for _ in range(40)] + ["!!! " * 40 for _ in range(20)] + [lines, texts[8]]
    langs = ["en", None, "de"]
    spark.createDataFrame([(i, t, langs[i % 3], "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("!" not in (t or "")), 0) for i, t in enumerate(texts) if i > 11] + [(0, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "a b c")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", "x"), (3, 0, "assistant", "</s>")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(0, None, None), (1, "", ""), (2, "http://A.example.com/en/x", "h"), (3, "x://b.net/es/?q", None), (4, "http://c.org/a.exe#z", None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, texts


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, folder, name):
    connection = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "pages"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    df, expected = queries.queries()[name](spark, folder[0]), connection.sql(queries.oracle_sql()[name])
    order = [df.columns.index(c) for c in expected.columns]
    assert sorted(df.columns) == sorted(expected.columns)
    assert sorted(repr(tuple(r[i] for i in order)) for r in df.collect()) == sorted(map(repr, expected.fetchall()))


def test_contracts(spark, folder):
    path, texts = folder
    got = {name: [r.asDict() for r in run(spark, path).collect()] for name, run in queries.queries().items()}
    crc = lambda i: zlib.crc32(str(i).encode())
    for name in ("op3_media_audio", "op5_quality", "op7_language_id", "op8_secret_scan", "op10_jaccard_join", "op11_bpe_automaton", "op13_tokenizer_alignment"):
        assert sorted(r["doc_id"] for r in got[name]) == list(range(len(texts))), name
    for r in got["op3_media_audio"]:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r["seek_offsets"]) == r["n_frames"]
    assert {r["conv_id"] for r in got["op4_chat_tree"]} == {1, 2, 3, -7}
    own = next(r for r in got["op4_chat_tree"] if r["conv_id"] == -7)
    said = "</s>[INST] ok [/INST]"
    assert (own["n_turns"], own["loss_chars"], own["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    for r in got["op5_quality"]:
        assert r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    for r in got["op7_language_id"]:
        assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))
    spans = {r["doc_id"]: r for r in got["op8_secret_scan"]}
    assert (spans[9]["n_assign"], spans[10]["n_hex"], spans[0]["spans"]) == (1, 1, "")
    assert spans[9]["base_sha256"] == hashlib.sha256(f"assign:0:{len(texts[9]) - 1}".encode()).hexdigest()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got["op10_jaccard_join"]), key=repr) == brute_components(list(enumerate(texts)), 3, 90)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got["op11_bpe_automaton"]:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        sha = lambda data: hashlib.sha256(data).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    expected, _, _ = plain_scores(texts)
    assert {tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got["op13_tokenizer_alignment"]} == {(i, *e) for i, e in enumerate(expected)}
    packed = got["op6_packing"]
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    assert all(r["doc_tokens"] == 1 for r in packed if not (texts[r["doc_id"]] or "").strip())


def test_training_rows_stay_out_of_held_out_ones(spark, folder, tmp_path):
    """Labels and languages of held-out documents may be anything."""
    from pyspark.sql import functions as F

    path, _ = folder
    for name in ("documents", "labels", "benchmark", "conversations", "pages"):
        df = spark.read.parquet(f"{path}/{name}.parquet")
        held = lambda n, x: F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == x
        if name == "labels":
            df = df.withColumn("quality", F.when(held(5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
        if name == "documents":
            df = df.withColumn("lang", F.when(held(4, 2), "zz").otherwise(F.col("lang")))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, columns in (("op5_quality", ("doc_id", "score")), ("op7_language_id", ("doc_id", "lang_pred", "score"))):
        run = queries.queries()[name]
        assert sorted(map(tuple, run(spark, str(tmp_path)).select(*columns).collect())) == sorted(map(tuple, run(spark, path).select(*columns).collect()))
