"""Lexical search, sequence packing and phrase collocations against brute force, and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logprism.llm import packing, phrases, search
from logprism.llm.common import prepare

DOCS = "doc_id long, text string, lang string"
UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return prepare(spark)


def documents(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, lang), with columns whose names the operators use themselves."""
    frame = spark.createDataFrame([(*r, "en")[:3] for r in rows], DOCS)
    return frame.withColumns({c: F.lit("x") for c in ("score", "n", "terms", "slot", "ids", "words", "rank", "_part", "group")})


# ---- search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_search(docs, items, k=20):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [c for c in counted if c[2]]
    n_docs, n_terms = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    found = []
    for item, text in sorted(set(items), key=str):
        hits = []
        for i, c, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                for t, q in Counter(terms(text)).items() if c[t])
            if score > 0:
                hits.append((-score, i is None, i or 0, i))
        found += [(item, r, h[3], -h[0]) for r, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(found, key=str)


def search_rows(spark, seed=3, n=200):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É x", "ÄB", "a1", "İ"]
    docs = [(i * 5 - 100, " ".join(draw.choice(words).title() + draw.choice(["", ".", "_", "\x7f"]) for _ in range(draw.randrange(0, 40))))
            for i in range(n)]
    docs += [(7777, docs[3][1]), (7776, docs[3][1]), (7776, docs[3][1]), (None, docs[3][1]), (None, docs[4][1])]
    docs += [(9000, None), (9001, ""), (9002, "?! \x00"), (9003, "w1 w2 " * 40_000)]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 15)))) for k in range(9)]
    items += [(0, "w3 w4"), (0, "w3 w4"), (None, docs[3][1]), (50, None), (51, ""), (52, "nowhere"), (53, "w5 w6 " * 30_000)]
    return docs, items


@pytest.mark.parametrize("tile, block, item_bytes", [(2048, 256, 64 << 20), (5, 2, 64 << 20), (7, 3, 200_000)])
def test_search_matches_brute_force(spark, monkeypatch, tile, block, item_bytes):
    """Also with tiles, blocks and passes so small that there are many of each."""
    monkeypatch.setattr(search, "TILE_TERMS", tile)
    monkeypatch.setattr(search, "BLOCK_ITEMS", block)
    docs, items = search_rows(spark)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    got = search.search(documents(spark, docs).repartition(7), bench, item_bytes=item_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = search_rows(spark, n=5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert search.search(documents(spark, []), bench).count() == 0
    assert search.search(documents(spark, docs), bench.limit(0)).count() == 0
    assert search.search(documents(spark, [(1, None), (2, "")]), bench).count() == 0


def test_weights_beyond_one_digit_stay_exact():
    """Weights and impacts at their largest: the products pass 2^53 and are still exact."""
    terms_, weights = 3000, [28_000] * 3000
    items = [Counter({t: 40_000 + t for t in range(terms_)})]
    block = search.ItemBlock(0, items, weights)
    assert all(len(digits) > 1 and max(d.sum(axis=0).max() for _, d in digits) * 1e6 < 2 ** 53 for _, _, digits in block.tiles)
    impacts = np.full(terms_, 999_983, np.int64)
    got = block.scores(np.zeros(terms_, np.int64), np.arange(terms_), impacts, 1)
    assert got[0, 0] == sum((40_000 + t) * 28_000 * 999_983 for t in range(terms_))


def test_long_documents_do_not_overflow():
    n = np.array([10 ** 9, 5], np.int64)
    got = search.impacts_of(np.array([7, 1], np.int64), n, 10 ** 12, 10 ** 13)
    wanted = [(10 ** 9 * c) // (1000 * c + 12 * (75 + 25 * x * 10 ** 12 // 10 ** 13)) for c, x in ((7, 10 ** 9), (1, 5))]
    assert got.tolist() == wanted


# ---- packing

@pytest.fixture(scope="module")
def tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


ODD_TEXTS = [
    None, "", " ", "Hello, World! it's 'S rock'n.", "a.,b ... e.! x'. 'll'. 12.5, 7;", "<|endoftext|>. A<|STARTOFTEXT|>b <|startoftext|>x,",
    "H̱ello İstanbul K.", "é ́x É,", "a\x1cb\x85c d e　f\x00g", "漢字かな交じり文。", "ß STRASSE straße,", "x" * 5000 + ".",
    "Ω ΑΣ ΟΔΟΣ.", "\U0001F600‍\U0001F525!?", "tab\there\vthere\fend\r\n",
]


def test_pieces_are_those_of_the_tokenizer(spark, sf_dir, tokenizer):
    plain = Tokenizer.from_str(tokenizer)
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    docs = documents(spark, list(enumerate(texts)) + [(None, "one two"), (3, texts[3])])
    for size in (4096, 7):
        pieces = packing.token_pieces(docs, tokenizer, size).collect()
        assert len({r.slot for r in pieces}) == len(pieces)
        read = {}
        for r in sorted(pieces, key=lambda r: r.slot):
            ids = np.frombuffer(r.ids, "<u4")
            assert r.length == len(ids) <= size and r.start == r.piece * size
            read.setdefault((r.doc_id, r.slot - r.piece), []).extend(ids.tolist())
        wanted = [(i, plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in enumerate(texts)]
        wanted += [(None, plain.encode("one two", add_special_tokens=False).ids + [1]), wanted[3]]
        assert sorted(((i, ids) for (i, _), ids in read.items()), key=str) == sorted(wanted, key=str)


def test_forgotten_chunks_are_learnt_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing.ChunkIds, "LIMIT", 12)
    monkeypatch.setattr(packing.ChunkIds, "LONG", 5)
    plain, chunks, draw = Tokenizer.from_str(tokenizer), packing.ChunkIds(tokenizer), random.Random(1)
    for _ in range(60):
        texts = [" ".join(draw.choice("ab, Cé. longer words here! x".split()) for _ in range(draw.randrange(9))) for _ in range(3)]
        got = [np.frombuffer(x, "<u4").tolist() for x in chunks.ids([t.encode() for t in texts])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check_places(rows, size):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_places_are_gapless_and_few(spark):
    draw = random.Random(9)
    lengths = [min(4096, 1 + int(draw.expovariate(1 / 900))) for _ in range(3000)] + [4096] * 5
    frame = spark.createDataFrame([(k, n, "x") for k, n in enumerate(lengths)], "slot long, length long, sequence string")
    rows = packing.placed(frame, shard_pieces=16384).collect()
    assert len(rows) == len(lengths) and all(r.sequence == "x" for r in rows)
    least = -(-sum(lengths) // 4096)
    assert check_places(rows, 4096) <= least + 2
    assert check_places(packing.placed(frame, shard_pieces=500).collect(), 4096) <= 1.02 * least
    assert packing.placed(frame.limit(0)).count() == 0


def slow_sum_of_squares(lengths, size):
    """The rule word for word: try every open gap and a new sequence, take the least sum of squares."""
    gaps, used, least, gap_of = Counter(), 0, -(-sum(lengths) // size), []
    for length in sorted(lengths, reverse=True):
        best = None
        for gap in sorted(g for g in gaps if gaps[g] and g >= length):
            after = Counter(gaps)
            after[gap] -= 1
            after[gap - length] += gap > length
            value = sum(n * n for n in after.values())
            if best is None or value < best[0]:
                best = (value, gap)
        after = Counter(gaps)
        after[size - length] += size > length
        fresh = sum(n * n for n in after.values())
        if best is None or (used < least and fresh < best[0]):
            best, used = (fresh, size), used + 1
        else:
            gaps[best[1]] -= 1
        if best[1] > length:
            gaps[best[1] - length] += 1
        gap_of.append(best[1])
    return gap_of


def test_sum_of_squares_rule():
    draw = random.Random(4)
    for _ in range(40):
        size = draw.choice([10, 30])
        lengths = np.array([draw.randrange(1, size + 1) for _ in range(draw.randrange(0, 60))], np.int64)
        _, offset = packing.sum_of_squares(lengths, size)
        order = np.argsort(-lengths, kind="stable")
        assert [size - int(offset[k]) for k in order] == slow_sum_of_squares(lengths.tolist(), size)


def test_packed_sequences_hold_all_ids(spark, sf_dir, tokenizer):
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    docs = documents(spark, list(enumerate(texts)) + [(1, "x"), (1, "x")])
    rows = packing.packed_sequences(docs, tokenizer, size=512).collect()
    plain = Tokenizer.from_str(tokenizer)
    wanted = Counter()
    for text in texts + ["x", "x"]:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        wanted.update(ids)
    read = Counter()
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 4 * 512
        read.update(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert read == wanted
    assert packing.packed_sequences(docs.limit(0), tokenizer).count() == 0


def test_packing_query_digests(spark, sf_dir, tokenizer):
    from logprism.llm.queries import op12_packing

    plain = Tokenizer.from_str(tokenizer)
    rows = op12_packing(spark, sf_dir).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert set(by_doc) == {d.doc_id for d in docs}
    total = 0
    for d in docs:
        ids = plain.encode(d.text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        wanted = [(k, low, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
                  for k, low in enumerate(range(0, len(ids), 4096)) for part in [ids[low:low + 4096]]]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d.doc_id]) == wanted
    assert check_places(rows, 4096) <= 1.02 * -(-total // 4096) + 1


# ---- phrases

def brute_phrases(rows, depth, least, top, percent=50):
    counts, n = {}, Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, depth + 1):
                for i in range(len(words) - size + 1):
                    key = (lang, tuple(words[i:i + size]))
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    for (lang, words), a in counts.items():
        if len(words) > 1 and a >= least:
            cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[lang, words] = (a, counts[lang, words[:k]], counts[lang, words[k:]], score)
    rows = {}
    for (lang, words), (a, left, right, score) in found.items():
        inside = any(
            l2 == lang and len(w2) > len(words) and 100 * v[0] >= percent * a
            and any(w2[i:i + len(words)] == words for i in range(len(w2) - len(words) + 1)) for (l2, w2), v in found.items())
        if not inside:
            rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, some in rows.items()
                  for r, (s, a, p, left, right) in enumerate(sorted(some)[:top], 1))


def phrase_rows():
    draw = random.Random(8)
    words = ["a", "b", "c", "É", "d\x1fe", "x-y", "ü", "the", "the", "the", "Of"]
    rows = []
    for i in range(120):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ", ", ".", "\n", " ! "]) for _ in range(draw.randrange(0, 60)))
        rows.append((i, text, draw.choice(["en", "en", "de", None, "und"])))
    return rows + [(1, None, "en"), (2, "", None), (3, " .,;", "fr"), (None, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]),
                   (9, "hot spot " * 30_000, "en")]


@pytest.mark.parametrize("depth, least, top, budget, gathered", [
    (3, 10, 2000, 1 << 21, 1 << 21), (3, 2, 40, 50, 100), (4, 3, 25, 20, 1000), (2, 3, 2000, 1 << 21, 50)])
def test_phrases_match_brute_force(spark, monkeypatch, depth, least, top, budget, gathered):
    """Also with groups and gatherings so small that prefixes are split and parts are many."""
    monkeypatch.setattr(phrases, "GATHERED", gathered)
    rows = phrase_rows()
    got = phrases.collocations(documents(spark, rows).repartition(3), depth, least, top, budget=budget).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, depth, least, top)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [(1, None, None), (2, " . ", "en"), (3, "one two", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9 * 10 ** 13
    found = spark.createDataFrame([([1, 2], big)], "words array<long>, n long")
    single = spark.createDataFrame([("en", b"a", 1, big + 1), ("en", b"b", 2, big + 3)], "lang string, word binary, symbol long, n long")
    assert phrases.scored(found, single).first().score == 1000000 * big * big // ((big + 1) * (big + 3))


def test_prefix_groups_keep_the_budget(spark):
    words = spark.createDataFrame([((b << 48) - (1 << 64 if b >= 1 << 15 else 0), n) for b, n in ((0, 30), (1, 30), (2, 50), (40000, 950), (65535, 10))],
                                  "symbol long, n long")
    first, width = phrases.prefix_groups(words, 100)
    assert [int(first[b]) for b in (0, 1, 2, 40000, 65535)] == [0, 0, 1, 2, 12] and int(width[40000]) == 10
