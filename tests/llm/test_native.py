"""Operators that use DataFrame functions only: brute force, round trips and odd rows."""

import hashlib
import re
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from logprism.llm import chat, fingerprints, licenses, lines, mixing, queries
from logprism.llm.common import connected_components, prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the cat sat on the mat and looked at the dog for a while".split()


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return prepare(spark)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (5, 5), (3, 9), (9, 20), (20, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 20: 1, 30: 1, 11: 10, 12: 10}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- mixing

def brute_targets(sizes, share, cap, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= cap * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mixing_meets_targets(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.randrange(0, 300)), draw.choice(["a", "b", "c", "ä", None, "hot", "hot", "hot"]))
            for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "empty"), (5, "w w w", "a"), (5, "w w w", "a"), (None, "w w", "b")]
    docs = documents(spark, rows)
    got = mixing.documents_mix(docs).collect()
    again = mixing.documents_mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = brute_targets(sizes, 1.5, 2.0)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - targets[source]) <= 2 * mixing.BLOCK_WORDS


def test_sainte_lague_is_highest_quotients(spark):
    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 7, "e": 0}
    for seats in (1, 7, 10, 101):
        ranked = sorted(((v / (2 * k + 1), s) for s, v in votes.items() for k in range(seats)), key=lambda x: (-x[0], x[1]))
        wanted = {s: sum(1 for _, t in ranked[:seats] if t == s) for s in votes}
        parties = spark.createDataFrame([(s, float(v), seats, 0) for s, v in votes.items()], "s string, v double, seats long, g int")
        got = {r.s: r.won for r in mixing.sainte_lague(parties, ["g"], "v", "seats", F.col("s"), "won").collect()}
        assert got == wanted


def test_mixing_of_nothing(spark):
    assert mixing.documents_mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.documents_mix(documents(spark, [(1, None, None)])).collect()] == [0]


# ---- chat

CHATS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", r"\</s>\\[INST]<<s><</SYS>>"),
    (3, 0, "assistant", "first"), (3, 1, None, "who\nam I"), (3, 2, "tool", "<turn></turn>\\"),
    (4, 0, "user", None), (4, 1, "assistant", ""), (5, 0, "user", "no answer"),
    (None, 0, "user", "x"), (None, 0, "user", "x"), (None, None, "assistant", "é\U0001F600<"),
]


def test_chat_round_trip(spark):
    frame = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    made = chat.format_conversations(frame.drop("segments"))
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in {c[0] for c in CHATS}:
        turns = sorted((c for c in CHATS if c[0] == conv), key=lambda c: (c[1] is not None, c[1] or 0, c[2] or "", c[3] or ""))
        whole = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in turns)
        loss = "".join(text or "" for _, _, role, text in turns if role == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns)
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert row.loss_chars == len(loss) and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: (r.valid, r.bad_turn) for c, r in got.items()} == {
        1: (True, None), 2: (True, None), 3: (False, 0), 4: (True, None), 5: (False, None), None: (False, 0)}
    text = {r.conv_id: r.formatted for r in made.collect()}[2]
    assert text.count("</s>") == 1 and text.count("[INST]") == 1
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


# ---- fingerprints

def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_fingerprints(spark):
    draw = random.Random(5)
    vocabulary = [f"w{k}é" for k in range(400)]
    rows = [(i * 7 - 50, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 3, 8, 60, 900])))) for i in range(60)]
    rows += [(900, None), (901, " \t\n"), (902, "one"), (903, rows[5][1]), (904, rows[5][1])]
    got = {r.doc_id: r for r in fingerprints.compared_with_next(documents(spark, [(i, t, "s") for i, t in rows])).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    errors = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        row = got[i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, value in ((edited, row.near_edited), (after, row.near_next)):
            a, b = shingles(text), shingles(other)
            errors.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
    assert max(map(abs, errors)) < 0.25, errors
    assert abs(sum(errors) / len(errors)) < 0.02
    assert got[903].fingerprint == got[904].fingerprint and got[904].near_next == 1.0


def test_fingerprint_of_one_or_no_document(spark):
    row = fingerprints.compared_with_next(documents(spark, [(3, "a b c d e f g h i", "s")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"a b c d e a b c d").hexdigest() or row.n_chars == 17
    assert row.near_next == 1.0
    assert fingerprints.compared_with_next(documents(spark, [])).count() == 0


# ---- lines

def brute_normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip(" ")


def brute_simhash(norm):
    hashes = {xxhash.xxh64_intdigest(w, seed=42) for w in norm.split(" ")}
    return sum(1 << b for b in range(lines.BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows):
    """Ids and numbers of the lines that go."""
    places = {}
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            norm = brute_normal(line)
            if norm:
                places.setdefault(norm, []).append((i, pos))
    names = list(places)
    sims = [brute_simhash(n) for n in names]
    label = list(range(len(names)))
    for a in range(len(names)):
        for b in range(a):
            if min(len(names[a].split(" ")), len(names[b].split(" "))) >= lines.MIN_WORDS and label[a] != label[b] and (sims[a] ^ sims[b]).bit_count() <= lines.MAX_BITS:
                x, y = names[a].split(" "), names[b].split(" ")
                if edit_distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9):
                    old, new = label[a], label[b]
                    label = [new if x == old else x for x in label]
    gone = set()
    for group in set(label):
        all_places = [p for k, n in enumerate(names) if label[k] == group for p in places[n]]
        gone |= set(all_places) - {min(all_places)}
    return gone


def test_line_dedup_matches_brute_force(spark):
    draw = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "bcdfgklm" for b in ("ar", "el", "in", "ou", "ut")]
    base = [[draw.choice(vocabulary) for _ in range(draw.randrange(5, 60))] for _ in range(30)]

    def variant(words):
        words = list(words)
        for _ in range(draw.randrange(0, 3)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        return " ".join(words).upper() + draw.choice(["", ".", " 7", "!!"])

    rows = [(i, "\n".join([variant(draw.choice(base)) for _ in range(draw.randrange(1, 6))] + ["short line", ""])) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "x " * 1200)]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    got = {(r.doc_id, pos) for r in lines.line_report(docs).collect() for pos in r.dropped}
    assert got == brute_lines(rows)
    assert len(got) > 100
    kept = {r.doc_id: r.text for r in lines.deduplicate_lines(docs).collect()}
    for i, text in rows:
        wanted = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in got)
        assert kept[i] == wanted


@pytest.mark.parametrize("words", [60, 260])
def test_no_pair_of_lines_at_the_edit_limit_is_lost(spark, words):
    """Every fifth word differs, so that only runs of four are left, one in each five."""
    pairs = []
    for k in range(60):
        line = [f"w{k}x{i}" for i in range(words)]
        pairs += [" ".join(line), " ".join("other" if i % 5 == 4 else w for i, w in enumerate(line))]
    docs = documents(spark, [(i, text, "s") for i, text in enumerate(pairs)])
    got = {r.doc_id for r in lines.line_report(docs).collect() if r.n_dropped}
    assert got == set(range(1, 120, 2))


def test_wide_lanes_count_the_same(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(700)), lambda i: F.xxhash64(i))
    for size in (300, 700):
        frame = spark.range(1).select(F.slice(words, 1, size).alias("h"))
        a, b = frame.select(lines.lane_hash(F.col("h"), 21), lines.lane_hash(F.col("h"), 63)).first()
        assert a == b == lines.with_simhash(frame, "h").first().sim


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    line = " ".join(COMMON)
    rows = [(1, line, "s"), (1, line, "s"), (None, line, "s"), (2, "other\n" + line, "s")]
    report = sorted((str(r.doc_id), r.n_dropped) for r in lines.line_report(documents(spark, rows)).collect())
    assert report == [("1", 0), ("1", 0), ("2", 1), ("None", 1)]
    assert lines.line_report(documents(spark, [])).count() == 0


def test_line_dedup_with_columns_of_its_own_names(spark):
    line = " ".join(COMMON)
    names = ["dropped", "_id", "_key", "_doc_id", "_text_key", "_dropped", "__dropped", "class", "norm", "pos", "text_key"]
    docs = documents(spark, [(1, line, "s"), (2, line + "\nother", "s"), (None, None, "s")]).withColumns({c: F.lit(c) for c in names})
    assert {r.doc_id: r.dropped for r in lines.line_report(docs).collect()} == {1: [], 2: [0], None: []}
    got = {r.doc_id: r for r in lines.deduplicate_lines(docs).collect()}
    assert {i: (r.text, r._dropped) for i, r in got.items()} == {1: (line, 0), 2: ("other", 1), None: (None, 0)}
    assert all(r[c] == c for r in got.values() for c in names if c != "_dropped")
    assert lines.deduplicate_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_a_very_long_line(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, long, "s"), (2, long.replace("w7 ", "x7 ", 1), "s"), (3, "a b c d e", "s")]
    assert {r.doc_id for r in lines.line_report(documents(spark, rows)).collect() if r.n_dropped} == {2}


def test_line_dedup_finds_lines_at_the_edit_limit(spark):
    draw = random.Random(5)
    rows, copies = [], set()
    for n in (5, 10, 20, 40, 100):
        for _ in range(30):
            words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)]
            rows.append((len(rows), " ".join(words), "s"))
            for at in draw.sample(range(n), n // 5):
                words[at] = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=8))
            copies.add(len(rows))
            rows.append((len(rows), " ".join(words), "s"))
    got = {r.doc_id for r in lines.line_report(documents(spark, rows)).collect() if r.n_dropped}
    assert got <= copies
    assert len(got) >= 0.97 * len(copies)


def test_line_dedup_keeps_lines_that_differ_in_numbers_or_marks(spark, tmp_path):
    texts = [
        "on 3 May 2021 pump 17 ran 250 hours at 90 bar", "on 4 June 2022 pump 18 ran 310 hours at 75 bar",
        "कि मि दि नि पि", "की मु दे नो पा",
        "On 3 May 2021, pump 17 ran 250 hours at 90 bar.", "on 3 May 2021 pump 17 ran 251 hours at 90 bar"]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in queries.op10_line_dedup(spark, str(tmp_path)).collect() if r.n_dropped}
    assert got == {4, 5}  # an exact copy, and one changed word of eleven
    left = corpus_pipeline.stage_line_dedup(spark, docs, str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {0, 1, 2, 3}


def test_line_dedup_of_short_lines_and_scripts_without_spaces(spark, tmp_path):
    texts = [
        "All rights reserved.\n\n***", "all rights reserved\n\n***", "Some rights reserved.\n\n***",
        "我们今天去公园看花", "我们今天去公园看花。", "我们明天去公园看花", "他昨天在家里写了很多信", "ที่นี่ดี\n谢谢", "ที่นี่ดี\n谢谢"]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.dropped for r in queries.op10_line_dedup(spark, str(tmp_path)).collect() if r.n_dropped}
    assert got == {1: [0], 4: [0], 5: [0], 8: [0, 1]}


# ---- licences

def test_license_scan(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x/main.c", "int x;"), (3, "a/x/y/z.c", "// " + licenses.TEMPLATES[0][1] + "\nint y;"),
        (4, "b/main.c", "int"), (5, "b/LICENSE.txt", "nothing here"), (6, "a/b/COPYING", licenses.TEMPLATES[7][1]),
        (7, "a/b/c/d.c", None), (8, None, mit), (9, "top.c", ""), (10, "a/x/main.c", "int x;"),
        (11, "a/q.c", "copyright " + "of many words that no licence has at all " * 20),
    ]
    frame = spark.createDataFrame(rows, "file long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r.file: (r.license, r.origin) for r in licenses.license_scan(frame).collect()}
    assert got == {
        1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: (None, None), 5: (None, None),
        6: ("GPL-3.0", "own"), 7: ("GPL-3.0", "inherited"), 8: ("MIT", "own"), 9: (None, None), 10: ("MIT", "inherited"),
        11: ("MIT", "inherited")}
    assert licenses.license_scan(frame.limit(0)).count() == 0


def test_line_keys_are_packed_and_lose_no_pair(spark):
    """Lines within the edits share a key; the shuffle has twelve bytes for each, copies of a line next to it none."""
    draw, rows = random.Random(5), []
    for k in range(150):
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(5, 260))]
        other = list(base)
        for _ in range(int(len(base) * 0.2 + 1e-9)):
            other[draw.randrange(len(other))] = f"x{draw.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    frame = spark.createDataFrame(rows, "class long, norm string").coalesce(1)
    packed = lines.keyed_classes(frame, 5, 0.8).collect()
    keys, size = {}, 0
    for r in packed:
        size += len(r.keys) + len(r.classes)
        for key, c in zip(np.frombuffer(r.keys, np.uint32).tolist(), np.frombuffer(r.classes, np.int64).tolist()):
            keys.setdefault(c, set()).add((r.block, key))
    assert all(keys[2 * k] & keys[2 * k + 1] for k in range(150))
    assert size == 12 * sum(map(len, keys.values()))
    found = lines.candidates(spark.createDataFrame(rows, "class long, norm string"), 5, 0.8)[0].collect()
    assert {(r.a, r.b) for r in found} >= {(2 * k + 1, 2 * k) for k in range(150)}


def test_lines_are_normalised_once(spark, monkeypatch):
    """No filter before the explode works the patterns out again."""
    plans = []
    monkeypatch.setattr(lines, "store", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lines.duplicate_lines(documents(spark, [(1, "A line of text.\nAnother", "s")]))
    assert not re.search(r"Filter .*(regexp_replace|lower)", plans[0]) and plans[0].count("lower(") == 1


def long_lines(rng, n, similarity=0.8):
    """A line of n words, and another at the edit limit: words changed, put in and taken out."""
    one = [f"w{rng.randrange(400 + 4 * n)}" for _ in range(n)]
    other, most = list(one), int(n * (1 - similarity) + 1e-9)
    for k in range(most):
        at = rng.randrange(len(other))
        other[at:at + 1] = ([f"x{rng.randrange(400)}"], [], [other[at]])[0 if k % 3 == 0 else 1 if k % 3 == 1 else 2]
    return " ".join(one), " ".join(other)


@pytest.mark.parametrize("n", [64, 66, 129, 140, 270, 600])
def test_bags_rule_no_pair_within_the_edits_out(spark, n):
    """Pairs at the limit stay, also where the two bags differ in size; most pairs of other lines of the same words go."""
    rng, rows = random.Random(n), []
    for k in range(40):
        one, other = long_lines(rng, n)
        rows += [(2 * k, one), (2 * k + 1, other)]
    frame = spark.createDataFrame(rows, "class long, norm string")
    bags = lines.class_bags(frame, frame.select("class"))
    sound = spark.createDataFrame([(2 * k + 1, 2 * k) for k in range(40)], "a long, b long")
    other = spark.createDataFrame([(2 * k + 1, 2 * j) for k in range(40) for j in range(k)], "a long, b long")
    assert sorted(map(tuple, lines.near(sound, bags, 0.8).collect())) == [(2 * k + 1, 2 * k) for k in range(40)]
    assert lines.near(other, bags, 0.8).count() < 0.05 * 780


def test_few_unlike_long_lines_are_compared(spark, monkeypatch):
    """Long lines that share a run, and no more, are not sent to the comparison of texts."""
    rng, sent = random.Random(8), []
    rows = [(k, " ".join(["one run of words", *[f"w{rng.randrange(4000)}" for _ in range(300)], "its end is the same"]), "s") for k in range(40)]
    real = lines.verified

    def spied(pairs, classes, similarity):
        sent.append(pairs.count())
        return real(pairs, classes, similarity)

    monkeypatch.setattr(lines, "verified", spied)
    assert {r.n_dropped for r in lines.line_report(documents(spark, rows)).collect()} == {0}
    assert sum(sent) < 40


def test_wide_bags_fold(spark):
    words, n = np.random.default_rng(1).integers(0, 2**63, 700).astype(np.uint64), np.array([300, 400])
    wide, narrow = lines.parities(words, n, 16), lines.parities(words, n, 4)
    assert (np.bitwise_xor.reduce(wide.reshape(2, -1, 4), axis=1) == narrow).all()
    assert lines.wide_size(np.array([1, 64, 65, 128, 129, 5000])).tolist() == [0, 0, 4, 4, 8, 256]


def test_rounds_of_keys_are_parts_of_them(spark):
    frame = spark.createDataFrame([(k, " ".join(f"w{k % 7}x{i}" for i in range(30))) for k in range(40)], "class long, norm string")

    def keys(*rounds):
        return sorted((r.block, key) for r in lines.keyed_classes(frame, 5, 0.8, *rounds).collect() for key in np.frombuffer(r.keys, np.uint32))

    assert lines.ROUNDS > 1
    parts = [keys(part, lines.ROUNDS) for part in range(lines.ROUNDS)]
    assert all(parts) and sorted(sum(parts, [])) == keys()
