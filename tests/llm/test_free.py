"""Operators with Python in their tasks: brute force, round trips, held-out accuracy and odd rows."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logprism.llm import decontaminate, jaccard, language, tokens, warc
from logprism.llm.common import prepare, table
from logprism.session import run_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return prepare(spark)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)


# ---- WARC

def test_warc_round_trip(spark):
    long = "".join(random.Random(1).choice("abcdefgh<>é") for _ in range(300_000))
    rows = [(1, "u", "x"), (2, "u\r\nEvil: 1", "x"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", "WARC/1.1\r\n\r\n"),
            (7, "u", "x"), (7, "u", "x"), (None, "u", "x"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    for split in (97, 5000, 1 << 20):
        got = sorted(map(tuple, warc.pages_read_back(pages, range_bytes=split).collect()), key=str)
        wanted = []
        for page, _, html in rows:
            body = (html or "").encode()
            same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
            keep = max(same, default=None)
            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
            other = keep is not None and page != keep
            wanted.append((page, len(body), digest, "revisit" if other else "response", keep if other else None))
        assert got == sorted(wanted, key=str)
    only_long = warc.pages_read_back(pages, revisit_bytes=2).filter("payload_bytes = 1")
    assert {r.record_type for r in only_long.collect()} == {"response"}
    assert warc.pages_read_back(pages.limit(0)).count() == 0


def test_warc_reader_passes_over_what_is_no_record(spark, tmp_path):
    """Noise with the gzip magic, members of other kinds and a broken record; foreign archives are listed."""
    records = [warc.member(f"<urn:x-page:{i}>", "u", bytes([65 + i]) * 5000, None) for i in range(20)]
    noise = warc.MAGIC * 3 + gzip.compress(b"no record") + b"\0" * 100
    data = noise + b"".join(records[:10]) + noise + records[10][:50] + b"".join(records[11:]) + records[0][:40]
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    archives = warc.list_archives(spark, str(tmp_path))
    for split in (50, 333, 1 << 20):
        got = [r for r in warc.read_archives(archives, split).collect()]
        assert sorted(r.payload[0] - 65 for r in got) == [i for i in range(20) if i != 10]
        assert all(r.digest_ok and len(r.payload) == 5000 for r in got)


# ---- tokens

def greedy(word, first, inner):
    at, count = 0, 0
    while at < len(word):
        pieces = first if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, count = end, count + 1
    return count


def test_automaton_is_greedy_longest_match():
    draw = random.Random(2)
    for _ in range(60):
        letters = b"abc"[:draw.choice([2, 3])]

        def piece():
            return bytes(draw.choice(letters) for _ in range(draw.randrange(1, 6)))

        first, inner = {piece() for _ in range(draw.randrange(1, 12))}, {piece() for _ in range(draw.randrange(1, 12))}
        automaton = tokens.Automaton(first, inner)
        for _ in range(200):
            word = b"" if draw.random() < 0.02 else bytes(draw.choice(b"abcd") for _ in range(draw.randrange(1, 14)))
            assert automaton.count(word) == greedy(word, first, inner), (word, first, inner)


def test_token_counts_of_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(40)
    docs = docs.unionByName(documents(spark, [(-1, None), (-2, ""), (-3, " \n "), (-4, "é<|endoftext|>x" * 50_000), (None, "a")]))
    first, inner = tokens.word_pieces()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.token_counts(docs.withColumn("n_tokens", F.lit(0))).collect():
        words = tokens.UNITS.findall(texts[r.doc_id] or "")
        assert r.n_words == len(words)
        counts = {w: greedy(w.encode(), first, inner) for w in set(words)}
        assert r.n_tokens == sum(counts[w] for w in words)


# ---- language

def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.documents_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame(
        [("der die das und nicht ein " * 9, "de"), ("the and of with that is " * 9, "en"), ("x", None), (None, "en")],
        "text string, lang string")
    filters = language.train(train, min_share=1e-6)
    odd = [(1, None), (2, ""), (3, "12 34 !?\x00"), (4, "the and of " * 500_000), (5, "und nicht"), (6, "Ж"), (None, "the")]
    frame = documents(spark, odd).withColumn("score", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(frame, filters).collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["und"] * 3 and got[3][1] == 0
    assert got[4][0] == "en" and got[4][1] > 0.9 and got[5][0] == "de" and got[None][0] == "en"
    assert got[6][1] == 0
    empty = language.train(train.limit(0))
    assert {r.lang_pred for r in language.predict(frame, empty).collect()} == {"und"}
    assert language.predict(frame.limit(0), filters).count() == 0


def test_many_languages_take_more_planes():
    rng = np.random.default_rng(1)
    members = {f"l{k:03}": rng.integers(0, 2 ** 62, 50) for k in range(130)}
    assert language.Filters.build(members).planes.shape[0] == 3


# ---- Jaccard join

def brute_components(rows, percent=80):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b >= a or label[a] == label[b] or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("block", [256, 5])
def test_jaccard_matches_brute_force(spark, monkeypatch, block):
    """Families of copies at all distances, a passage that many share, and blocks small enough to be many."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    draw = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    passage = [draw.choice(words) for _ in range(40)]
    rows = []
    for family in range(6):
        base = [draw.choice(words) for _ in range(draw.choice([8, 40, 200]))]
        for _ in range(25):
            text = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 30))):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append(" ".join(text + (draw.sample(words, 2) if draw.random() < 0.3 else [])))
    rows += [" ".join(passage + [draw.choice(words) for _ in range(draw.randrange(3, 30))]) for _ in range(40)]
    rows += ["a b c", "A  b\tc", "", None, " ", "one", "One", "zwei é", "x " * 2000, "x " * 2001]
    rows = list(enumerate(rows))
    docs = documents(spark, rows).withColumn("class", F.lit(1)).withColumn("component", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_of_repeated_rows_and_nothing(spark):
    text = "a b c d e f g"
    got = sorted(map(str, (tuple(r) for r in jaccard.jaccard_groups(
        documents(spark, [(4, text), (4, text), (None, text), (2, text), (9, None)])).collect())))
    assert got == sorted(map(str, [(4, 3, 2), (4, 3, 2), (None, 3, 2), (2, 3, 2), (9, 0, 9)]))
    assert jaccard.jaccard_groups(documents(spark, [])).count() == 0
    kept = jaccard.one_of_each_group(documents(spark, [(4, text), (2, text), (9, None)])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 9]


# ---- decontamination

def test_decontamination_matches_brute_force(spark):
    draw = random.Random(13)
    words = [f"w{k}" for k in range(500)]
    items = [[draw.choice(words) for _ in range(draw.randrange(5, 60))] for _ in range(25)]
    rows, benchmark = [], [(k, " ".join(item)) for k, item in enumerate(items)]
    for i in range(120):
        text = [draw.choice(words) for _ in range(draw.randrange(0, 200))]
        if i % 2:
            passage = list(draw.choice(items))
            for _ in range(draw.randrange(0, 1 + len(passage) // 4)):
                at, kind = draw.randrange(len(passage)), draw.random()
                passage[at:at + 1] = [draw.choice(words)] if kind < 0.6 else [] if kind < 0.8 else [passage[at], "new"]
            at = draw.randrange(len(text) + 1)
            text[at:at] = passage
        rows.append((i, " ".join(text).title() + "."))
    rows += [(500, None), (501, ""), (None, " ".join(items[0]))]
    wanted = set()
    for i, text in rows:
        for k, item in enumerate(items):
            found, _ = decontaminate.distance_within(
                decontaminate.words_of(" ".join(item).encode()), decontaminate.words_of((text or "").encode()))
            if found <= decontaminate.edits_allowed(len(item), 0.8):
                wanted.add((i, k, found))
    bench = spark.createDataFrame(benchmark + [(90, None), (91, "a b"), (92, "")], "item_id long, text string")
    docs = documents(spark, rows).withColumn("distance", F.lit(0))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got <= wanted and len(got) >= 0.99 * len(wanted) and len(wanted) > 40
    assert {(i, k) for i, k, d in wanted if d == 0} <= {(i, k) for i, k, _ in got}
    kept = {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _, _ in got}  # also the one without an id
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("length, tries", [(60, 40), (150, 30), (400, 15), (1000, 8)])
def test_recall_at_the_edit_limit_by_length(spark, length, tries):
    draw = random.Random(length)
    words = [f"w{k}" for k in range(5000)]
    items = [[draw.choice(words) for _ in range(length)] for _ in range(tries)]
    rows = []
    for k, item in enumerate(items):
        passage = list(item)
        for at in draw.sample(range(length), length // 5):
            passage[at] = "changed"
        rows.append((k, " ".join([draw.choice(words) for _ in range(50)] + passage)))
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {(k, k) for k in range(tries)}


def test_items_and_documents_without_id(spark):
    """An item without id counts; a contaminated row goes by id and text, so a clean text with the same id stays."""
    item = "one two three four five six seven eight"
    bench = spark.createDataFrame([(None, item), (None, None)], "item_id long, text string")
    docs = documents(spark, [(1, "x " + item), (1, "clean"), (None, item + " y"), (None, "clean"), (3, None)]).withColumns(
        {"text_key": F.lit(1), "item_id": F.lit(2)})
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, None), (None, None)}
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [(1, "clean"), (None, "clean"), (3, None)]))


def test_one_row_of_each_group_stays(spark):
    a, b = "a b c d e f g", "other words that are like no text of the first group"
    rows = [(3, a), (5, a), (5, b), (None, a), (None, None), (7, None), (8, "q r s t u v w"), (8, "q r s t u v w"), (None, "x y z 1 2 3"), (None, "x y z 1 2 3")]
    docs = documents(spark, rows).withColumns({"component": F.lit(1), "stays": F.lit(True), "text_key": F.lit(0)})
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [
        (3, a), (5, b), (None, None), (7, None), (8, "q r s t u v w"), (None, "x y z 1 2 3")]))
    assert jaccard.one_of_each_group(docs.limit(0)).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 2)
    bench = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(4)], "item_id long, text string")
    docs = documents(spark, [(k, f"x a{k} b{k} c{k} d{k} e{k} f{k} y") for k in range(4)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(k, k) for k in range(4)}


def test_edit_distance_to_a_part():
    item, text = np.array([1, 2, 3, 4], np.uint64), np.array([9, 9, 1, 2, 7, 4, 9], np.uint64)
    assert decontaminate.distance_within(item, text)[0] == 1
    assert decontaminate.distance_within(item, text[:0])[0] == 4


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    """Each stage's decision on planted documents; the clean ones stay to the end."""
    draw = random.Random(17)
    en = "the of and to in is that it was for with as his on be at by".split()

    def prose(n):
        return " ".join(draw.choice(en) + draw.choice(["", "ing", "ed"]) + str(draw.randrange(50)) * (draw.random() < 0.1)
                        for _ in range(n))

    clean = {i: "\n".join(prose(30) for _ in range(4)) for i in range(1, 30)}
    item = prose(25)
    rows = {**clean, 100: "1234 5678", 101: None, 102: clean[3], 103: item + "\n" + prose(60), 104: clean[4] + "\n" + prose(90)}
    frame = spark.createDataFrame(
        [(i, t, "en", f"s{i % 3}", len(t) if t else None) for i, t in rows.items()], DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = run_dir(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert left[0] == set(rows) - {100, 101}
    assert left[1] == left[0] - {102}
    assert left[2] == left[1]
    assert left[3] == left[2] - {103}
    assert left[4] == left[3] >= set(clean)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, docs.collect()))
