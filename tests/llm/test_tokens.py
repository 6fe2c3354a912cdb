"""Encoding by automaton, source audit and tokenizer alignment against the libraries and plain counting."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brightmill.llm import bpe_automaton, source_audit, tokenizer_alignment
from tests.llm.test_operators import DOCS, prose

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "aa", "the", " ", "  ", "\n", "\t", "\r\n", "é", "'s", "'", "’", "1", "23", "😀", "中文", "<|endoftext|>", "<|", "<s>", "　", "\x1c", "\x85", "\xa0", "\x00", "ab", "ing", "ation", "\U0003fc3b", "ա", "՘", "!", "--", "ﬁ", "한국"]


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(n)]
    return out + ["a" * k for k in range(1, 70)] + ["".join(rng.choice("abt ") for _ in range(k)) for k in range(150)] + [" ", "  ", "\n \n", "a ", " a", "a  b   c "]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash with added ones."""
    rng = random.Random(8)
    texts = [None, "", *odd_texts(60, 4), "▁a b", "x ▁", prose(rng, 30_000), "ab" * 30_000, "the same", "the same"]
    rows = [(i, t, ("en", None, "de")[i % 3], ("s", None, "t", "u")[i % 4], None, 1.0, "p", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[7], (None, "no id", None, None, None, None, None, None), (None, None, "en", "z", None, None, None, None)], DOCS)


# --- automaton -------------------------------------------------------------------------------------------------------
def test_automaton_reads_what_merges_give():
    """All sequences of a small vocabulary, with merges of a token with itself and useless ones."""
    rng = random.Random(3)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        number = {b"a": 97, b"b": 98, b"c": 99}
        for _ in range(rng.randrange(1, 9)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in number:
                number[u + v] = 256 + len(merges)
                merges.append((number[u], number[v]))
                tokens.append(u + v)
        machine = bpe_automaton.Automaton(merges)
        assert machine.states <= len(merges) + 1
        of = {n: t for t, n in number.items()}
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
            expected = [bytes((b,)) for b in word]
            for u, v in merges:  # each merge in turn, from the left
                i, out = 0, []
                while i < len(expected):
                    both = i + 1 < len(expected) and (expected[i], expected[i + 1]) == (of[u], of[v])
                    out.append(expected[i] + expected[i + 1] if both else expected[i])
                    i += 1 + both
                expected = out
            paths = [(0, 0, ())]  # every accepted sequence that spells the word
            found = []
            while paths:
                at, state, path = paths.pop()
                if at == len(word):
                    found.append(list(path))
                for token, n in number.items():
                    if word.startswith(token, at) and at < len(word) and machine.arc(state, n):
                        paths.append((at + len(token), machine.after[n], (*path, token)))
            assert found == [expected]


def test_encoding_equals_the_library():
    ours, library = bpe_automaton.ByteBpe(BYTES, capacity=50), Tokenizer.from_file(BYTES)
    plain = bpe_automaton.ByteBpe(BYTES, added=False)
    for text in odd_texts(4000, 5):
        ids = library.encode(text, add_special_tokens=False).ids
        packed = ours.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert ours.decode(packed) == library.decode(ids, skip_special_tokens=False) == text
    library.encode_special_tokens = True
    for text in ("<|endoftext|>", "a <|endoftext|> b"):
        assert np.frombuffer(plain.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    some = [3, 50256, 187, 49_000, 70_000]  # bytes that aren't UTF-8, and an unknown id
    assert ours.decode(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_encoded_columns(spark, odd):
    clash = odd.withColumn("tokens", F.lit("clash"))
    out = bpe_automaton.decode_tokens(bpe_automaton.encode_texts(clash, BYTES), BYTES, text="parity")
    assert sorted(out.columns) == sorted(clash.columns)
    library = Tokenizer.from_file(BYTES)
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert np.frombuffer(r.tokens, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.parity == (r.text or "")
    assert bpe_automaton.encode_texts(clash.limit(0), BYTES).count() == 0
    nothing = spark.createDataFrame([(None,), (b"",)], "tokens binary")
    assert [r.text for r in bpe_automaton.decode_tokens(nothing, BYTES, text="text").collect()] == ["", ""]
    with pytest.raises(ValueError, match="reserved"):
        bpe_automaton.encode_texts(odd.withColumn("__x", F.lit(1)), BYTES)
    with pytest.raises(ValueError, match="byte-level"):
        bpe_automaton.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


# --- source audit ----------------------------------------------------------------------------------------------------
def plain_audit(rows, least=3, most=200):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    counts, docs, groups = {}, {}, {}
    for text, lang, source in rows:
        lang, found = lang or "", Counter(term.findall((text or "").translate(lower)))
        groups.setdefault(lang, set()).add(source or "")
        counts.setdefault((lang, source or ""), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())

        def shares(own, kept=kept):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 1) // (total + len(kept)) for t in kept}

        of = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((of[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and of[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


@pytest.mark.parametrize("broadcast_groups", [20_000, 0])
def test_source_audit(spark, odd, broadcast_groups, monkeypatch):
    monkeypatch.setattr(source_audit, "CELLS", 40)  # blocks of few vectors
    rng = random.Random(7)
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    words = [w.upper() if rng.random() < 0.2 else w for w in "red green blue ä Äb ö zeta eta 中 é x".split()]
    rows += [(" ".join(rng.choices(words, range(1, 12), k=rng.randrange(20))), rng.choice(["en", "de", "fr", None]), rng.choice(["s", "t", "hot", "hot", "hot", None])) for _ in range(300)]
    rows += [("1 2 3", "zz", "only"), ("", "zz", "other"), (None, "yy", "alone"), ("unique words here", "xx", "a"), ("others there", "xx", "b")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "text string, lang string, source string, rank double").repartition(5)
    for top in (200, 3):
        got = source_audit.audit(df, top_terms=top, broadcast_groups=broadcast_groups)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == plain_audit(rows, most=top)
    assert source_audit.audit(df.limit(0), broadcast_groups=broadcast_groups).count() == 0


# --- alignment -------------------------------------------------------------------------------------------------------
def plain_alignment(texts):
    """For each text (n_a, n_b, n_groups, links, groups) by whole encodings."""
    a_lib, b_lib = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    labels = bpe_automaton.labels_of(BYTES)
    out = []
    for text in texts:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        b_bytes = [bytes((int(p[3:5], 16),)) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, b_lib.id_to_piece(b), strict=True)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(labels[i] for i in a) != whole or b"".join(b_bytes) != whole:
            out.append((0, 0, 0, [], ""))
            continue
        a_at = {e: (i, n) for n, (e, i) in enumerate(zip(np.cumsum([len(labels[i]) for i in a]).tolist(), a, strict=True), 1)}
        b_at = {e: (i, n) for n, (e, i) in enumerate(zip(np.cumsum([len(x) for x in b_bytes]).tolist(), b, strict=True), 1)}
        groups, x, y = [], 0, 0
        for e in sorted(a_at.keys() & b_at.keys()):
            groups.append(",".join(map(str, a[x : a_at[e][1]])) + "|" + ",".join(map(str, b[y : b_at[e][1]])))
            x, y = a_at[e][1], b_at[e][1]
        links = [(a_at[e][0], b_at[e][0]) for e in sorted(a_at.keys() & b_at.keys())]
        out.append((len(a), len(b), len(groups), links, ";".join(groups)))
    return out


def plain_scores(texts):
    aligned = plain_alignment(texts)
    counts = Counter(link for x in aligned for link in x[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    scores = [(*x[:3], len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(x[4].encode()).hexdigest() if x[0] else "") for x in aligned]
    return scores, counts, [x[4] for x in aligned]


@pytest.mark.parametrize("chunk, capacity", [(20_000, 300_000), (7, 40)])
def test_alignment(spark, odd, chunk, capacity, monkeypatch):
    """Also with a table that is full every few units, in the driver's process."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    expected, counts, groups = plain_scores([t for _, t in rows])
    if capacity == 40:
        monkeypatch.setattr(tokenizer_alignment, "_CHUNK", chunk)
        aligner = tokenizer_alignment.Aligner(BYTES, PIECES, capacity)
        found = Counter()
        for _, text in rows:
            keys = aligner.keys(text) if text and "▁" not in text else []
            for i in range(0, len(keys), chunk):
                if aligner.full:
                    aligner.clear()
                for n in aligner.numbers(keys[i : i + chunk]):
                    found.update(np.frombuffer(aligner.links[n], np.int64).tolist())
        assert found == {(b << 32) + a: n for (a, b), n in counts.items()}
        return
    got = tokenizer_alignment.audit(odd, BYTES, PIECES)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((d, *e) for (d, _), e in zip(rows, expected, strict=True)), key=repr)
    assert {(r.a_id, r.b_id): r.n for r in tokenizer_alignment.pair_table(odd, BYTES, PIECES).collect()} == counts
    texts = tokenizer_alignment.group_texts(odd, BYTES, PIECES, groups="parity").select("text", "parity").collect()
    assert sorted((r.text or "", r.parity) for r in texts) == sorted((t or "", g) for (_, t), g in zip(rows, groups, strict=True))
    assert tokenizer_alignment.audit(odd.limit(0), BYTES, PIECES).count() == 0
    with pytest.raises(TypeError):
        tokenizer_alignment.audit(odd, BYTES, PIECES, doc_id="text")


def test_counts_in_many_shards(spark):
    """Partial counts of many partitions, with keys that a third of the rows share."""
    rng = random.Random(2)
    rows = [((rng.choice([5, rng.randrange(300)]) << 32) + rng.randrange(20), rng.randrange(1, 9)) for _ in range(5000)] + [(7 << 32, 1)] * 2500
    counts = tokenizer_alignment.count_pairs(spark.createDataFrame(rows, "key long, n long").repartition(9), 300, rows_a_shard=400)
    expected = Counter()
    for k, n in rows:
        expected[k] += n
    assert len(counts.shards) > 5
    assert {(r.b_id << 32) + r.a_id: r.n for r in counts.table(spark).collect()} == expected
    lookup = tokenizer_alignment.Lookup(counts.folder, counts.shards, most=2)
    keys = np.array(sorted(rng.sample(sorted(expected), 400)))
    assert lookup(keys).tolist() == [expected[k] for k in keys.tolist()]
    best = Counter()
    for k, n in expected.items():
        best[k >> 32] = max(best[k >> 32], n)
    assert {b: n for b, n in enumerate(counts.best.tolist()) if n} == best
