"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowproof.llm import blocks, fingerprints, language, licenses, mixing, neardups, packing, secrets, topk, toxicity, transcripts
from rowproof.llm.common import is_held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, _text int"
LONG = "word " * 30_000 + "under the MIT License"
WORDS = [a + b for a in ("ta", "ke", "lo", "mi", "su", "ra") for b in ("n", "r", "st", "le", "do", "ve")]


def prose(seed, many):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(many))


def rows():
    texts = [None, "", " \n\t ", "!!! ###", "one", "a b c", LONG, prose(1, 80), prose(1, 80), prose(2, 90) + " 日本語 ñandú"]
    found = [(n, text, "en" if n % 3 else None, None if n % 4 == 0 else f"s{n % 3}", None, "x", n, n) for n, text in enumerate(texts)]
    return found + [found[7], (None, prose(3, 40), "de", "s1", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    found = {}
    for row in frame.collect():
        found.setdefault(row[0], []).append(row)
    return found


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


# licenses -------------------------------------------------------------------------------------


def test_license_base_places_equal_brute_force(spark, odd):
    extra = [
        (50, "Released Under The MIT License, under the mit license.", None, None, None, None, None, None),
        (51, "cc by nc cc-by-nc CC BY\nNC! apache license version 2 apache license, version 2.0", None, None, None, None, None, None),
        (52, "under the MITé license by nc", None, None, None, None, None, None),
    ]
    docs = odd.unionByName(spark.createDataFrame(extra, SCHEMA))
    found = by_id(licenses.scan_licenses(docs))
    assert sum(map(len, found.values())) == len(rows()) + 3
    for row in docs.collect():
        words, starts, labels = words_of(row.text), [], set()
        for phrase, label in licenses.BASE:
            parts = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            starts += hits
            labels |= {label} if hits else set()
        candidates = [r for r in found[row.doc_id] if r.n_words == len(words)]
        assert candidates
        assert all(r.n_base == len(starts) for r in candidates)
        assert all(r.first_word == min(starts, default=None) and r.last_word == max(starts, default=None) for r in candidates)
        assert all(r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} for r in candidates)


def test_license_spans_survive_changed_words(spark):
    notice = licenses.NOTICES[1][1].split()
    changed = notice[:20] + ["really"] + notice[20:40] + notice[41:]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, prose(5, 200)), (3, "licensed under cc by nc 4.0")], "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert found[1].labels == "mit" and found[1].n_base == 0 and 0.8 <= found[1].score <= 1
    assert found[2].labels == "" and found[2].score == 0
    assert found[3].labels == "cc-by-nc"  # not also the shorter cc-by


def test_longest_common_subsequence_equals_dynamic_programme():
    pick = random.Random(4)
    for _ in range(50):
        one, other = ([pick.randrange(5) for _ in range(pick.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(other) + 1) for _ in range(len(one) + 1)]
        for i, j in itertools.product(range(len(one)), range(len(other))):
            table[i + 1][j + 1] = table[i][j] + 1 if one[i] == other[j] else max(table[i][j + 1], table[i + 1][j])
        assert licenses.Template("", np.array(one), False).common(other) == table[-1][-1]


# toxicity -------------------------------------------------------------------------------------


def test_toxicity_learns_pairs_and_handles_odd_rows(spark, odd, none):
    pick, documents, labels = random.Random(1), [], []
    for n in range(1200):
        insult, group = pick.random() < 0.5, pick.random() < 0.5
        text = prose(n, 20) + " zork" * insult + " blarg" * group
        documents.append((n, text))
        labels.append((n, int(insult and group)))
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(5, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, ~is_held_out())
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).select("doc_id", "score", "predicted", is_held_out().alias("h")).collect()}
    held = [n for n in scored if scored[n].h]
    assert np.mean([scored[n].predicted == labels[n][1] for n in held]) > 0.97
    result = toxicity.score_toxicity(odd, model)
    assert result.columns.count("score") == 1 and result.count() == odd.count()
    assert result.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.train(none, marks, F.lit(True))
    assert toxicity.score_toxicity(odd, empty).where("score is null").count() == 0


def test_toxicity_learns_a_pair_of_words_that_are_neutral_alone(spark):
    pick, texts, labels = random.Random(3), [], []
    for n in range(4000):
        one, other = pick.random() < 0.5, pick.random() < 0.5
        words = [f"noise{pick.randrange(5000)}" for _ in range(25)] + ["zebra"] * one + ["teapot"] * other
        pick.shuffle(words)
        texts.append((n, " ".join(words)))
        labels.append((n, int(one != other)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~is_held_out())
    scored = toxicity.score_toxicity(docs, model).where(is_held_out()).collect()
    assert np.mean([(r.score >= 0.5) == labels[r.doc_id][1] for r in scored]) > 0.95


def test_toxicity_scores_equal_the_formula(spark):
    texts = ["zork blarg blarg", "insulting words, insulting", "", None, "plain"]
    place = np.arange(toxicity.BUCKETS)
    random_ = np.random.default_rng(5)
    model = toxicity.FactorizationMachine(
        place, -1.0, random_.normal(size=toxicity.BUCKETS), random_.normal(0, 0.3, (toxicity.BUCKETS, toxicity.FACTORS))
    )
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in toxicity.score_toxicity(docs, model).collect():
        counts = Counter()
        for word in re.findall("[0-9a-z]+", (row.text or "").lower()):
            for size, term in [(0, word)] + [(size, word[:size]) for size in toxicity.STEMS if len(word) > size]:
                counts[(int(blocks.phrase_hashes(term)[0]) + size) % toxicity.BUCKETS] += 1
        logit = -1.0 + sum(model.weights[b] * np.log2(1 + n) for b, n in counts.items())
        for (b, n), (c, m) in itertools.combinations(counts.items(), 2):
            logit += model.factors[b] @ model.factors[c] * np.log2(1 + n) * np.log2(1 + m)
        assert row.score == pytest.approx(1 / (1 + np.exp(-logit)))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    seen = []
    fit = toxicity._fit_on

    def spy(chosen, row, bucket, value, y, weight):
        seen.append((len(y), len(bucket), float(weight.sum())))
        return fit(chosen, row, bucket, value, y, weight)

    monkeypatch.setattr(toxicity, "_fit_on", spy)
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = spark.range(3000).select(
        F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")
    )
    toxicity.train(docs.unionByName(docs.withColumn("doc_id", F.lit(2).cast("long"))), marks, F.lit(True), most_rows=100)
    assert 50 <= seen[-1][0] <= 100
    # equal rows are one, with their number as weight
    same = docs.withColumn("text", F.lit("word")).unionByName(docs.limit(10).withColumn("doc_id", F.lit(2).cast("long")))
    toxicity.train(same, marks, F.lit(True))
    assert seen[-1][0] == 11 and seen[-1][2] == 3010
    monkeypatch.setattr(toxicity, "MOST_NUMBERS", 30)
    toxicity.train(same, marks, F.lit(True))
    assert 0 < seen[-1][1] <= 30


# top-k ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [None, 40])
def test_top_k_equals_brute_force(spark, block_rows):
    pick = np.random.default_rng(3)
    table = [(i, [float(x) for x in pick.normal(0, 0.3, 5).astype(np.float32)]) for i in range(300)]
    table += [(i, table[7][1]) for i in range(300, 340)]  # ties
    odd_rows = [(400, None), (420, [None, 1.0, 1.0, 1.0, 1.0]), (440, [float("nan")] * 5), (460, []), (None, [1.0] * 5), (480, [0.0] * 5)]
    frame = spark.createDataFrame(table + odd_rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0, 20, block_rows=block_rows, chunk=9)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = {i: np.floor(64 * np.array(v, np.float64)).astype(int) for i, v in table + [odd_rows[-1]]}
    assert set(got) == {i for i in whole if i % 20 == 0}
    for query in got:
        order = sorted((-int(whole[query] @ v), i) for i, v in whole.items() if i != query)[:20]
        assert [got[query][n + 1] for n in range(20)] == [(i, -s) for s, i in order]
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_threshold_stops_before_the_end():
    pick = np.random.default_rng(1)
    table = (pick.pareto(1.0, (5000, 2)) * 10).astype(np.int64)
    lists = topk.SortedLists(np.arange(5000), table)
    asked = []
    original = lists.products
    lists.products = lambda q, r: asked.append(len(r)) or original(q, r)
    query, row, score = lists.search(np.array([-1]), np.array([[1, 1]]), 3)
    best = sorted((-int(s), i) for i, s in enumerate(table.sum(1)))[:3]
    assert sorted(zip((-score).tolist(), row.tolist())) == best and sum(asked) < 500


def test_threshold_decides_on_clustered_vectors(spark):
    """64 dimensions, 12 clusters: less than half of the pairs is scored, the result is that of brute force."""
    pick = np.random.default_rng(5)
    centres = pick.normal(0, 1, (12, 64))
    table = (centres[pick.integers(0, 12, 2400)] + pick.normal(0, 0.15, (2400, 64))).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(table)], "vec_id long, embedding array<float>")
    scored = spark.sparkContext.accumulator(0)
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0, 20, block_rows=100, scored=scored)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    whole = np.floor(64 * table.astype(np.float64)).astype(int)
    for query in range(0, 2400, 20):
        score = whole @ whole[query]
        order = sorted((-int(s), i) for i, s in enumerate(score) if i != query)[:20]
        assert [got[query, n + 1] for n in range(20)] == [(i, -s) for s, i in order]
    assert 120 * 20 <= scored.value < 120 * 2400 / 2


# language -------------------------------------------------------------------------------------


def naive_kneser_ney(text, query):
    """Straight from the definition, on class codes."""
    def codes(t):
        data, offsets = blocks.raw_texts(pa.array([t]))
        return [0, 0, 0, *language.classes_of(data, offsets)[0].tolist()]

    def grams(c):
        return [tuple(c[i - 3 : i + 1]) for i in range(3, len(c))]

    counts = {4: {}}
    for gram in grams(codes(text)):
        counts[4][gram] = counts[4].get(gram, 0) + 1
    for order in (3, 2, 1):
        counts[order] = {}
        for gram in counts[order + 1]:
            counts[order][gram[1:]] = counts[order].get(gram[1:], 0) + 1

    def p(gram):
        if not gram:
            return 1 / 64
        table = counts[len(gram)]
        mine = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        if not mine:
            return p(gram[1:])
        once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        return max(mine.get(gram, 0) - d, 0) / sum(mine.values()) + d * len(mine) / sum(mine.values()) * p(gram[1:])

    seen = grams(codes(query))
    return -sum(math.log(p(g)) for g in seen) / len(seen)


def test_language_model_equals_definition(spark):
    train = {"aa": prose(1, 60), "bb": prose(2, 40).replace("t", "zü") + " ğ"}
    frame = spark.createDataFrame([(n, t, k) for n, (k, t) in enumerate(train.items())], "doc_id long, text string, lang string")
    model = language.train(frame, F.lit(True))
    for query in ("tan kest xyz", "zü q", prose(9, 15)):
        got = model.entropies(*blocks.raw_texts(pa.array([query])))[0][0]
        assert got == pytest.approx([naive_kneser_ney(train[k], query) for k in ("aa", "bb")], rel=1e-4)


def test_language_odd_rows(spark, odd, none):
    model = language.train(odd, F.lit(True))
    found = by_id(language.identify(odd, model).select("doc_id", "lang_pred", "score", "rejected"))
    assert [r.lang_pred for n in range(4) for r in found[n]] == ["und"] * 4 and all(r.rejected for n in range(4) for r in found[n])
    assert all(0 <= r.score <= 1 for group in found.values() for r in group) and sum(map(len, found.values())) == len(rows())
    empty = language.train(none, F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


# packing --------------------------------------------------------------------------------------


def test_packing_is_whole_and_gapless(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    strange = "It's  the\tdog's café, <|endoftext|>x\x85y ΑΣ ΣΑΣ, İI <|EndOfText|> don't. 'S't, x1.2.3, a̧ «a», #b# ##"
    docs = odd.unionByName(spark.createDataFrame([(77, strange, None, None, None, None, None, None)], SCHEMA))
    pieces = packing.pack(docs).collect()
    expected = []
    for row in docs.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            expected.append((str(row.doc_id), n, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(expected)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_fullest_combination_equals_brute_force():
    pick = random.Random(2)
    for _ in range(60):
        counts = np.zeros(60, dtype=np.int64)
        for _ in range(pick.randrange(1, 6)):
            counts[pick.randrange(1, 25)] += pick.randrange(1, 4)
        room = pick.randrange(0, 50)
        sums = {0}
        for length in np.flatnonzero(counts):
            sums = {s + length * k for s in sums for k in range(counts[length] + 1)}
        used = packing.fullest(counts, [int(x) for x in np.flatnonzero(counts)[::-1]], room)
        assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= room)
        assert all(v <= counts[k] for k, v in used.items())


def test_plan_uses_every_piece():
    pick = random.Random(3)
    histogram = {n: pick.randrange(1, 500) for n in pick.sample(range(1, 2049), 300)}
    plan, used, total = packing.plan_bins(histogram), {}, 0
    for pattern, times in plan:
        assert sum(k * v for k, v in pattern.items()) <= 2048
        total += times
        for k, v in pattern.items():
            used[k] = used.get(k, 0) + v * times
    assert used == histogram
    # a bin holds one length above half a sequence at most; otherwise the sum of lengths decides
    assert total <= 1.02 * max(-(-sum(k * v for k, v in histogram.items()) // 2048), sum(v for k, v in histogram.items() if k > 1024))


# mixing ---------------------------------------------------------------------------------------


def test_mixing_targets_and_rounding(spark, odd, none):
    pick = random.Random(5)
    data = [(n, prose(n, pick.randrange(1, 60)), pick.choice(["a", "a", "a", "b", None])) for n in range(900)]
    data += [(1000, prose(1, 30), "c")] * 50 + [(1001, None, "d"), (1002, "x", "e")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(data) and all(0 <= r.taken <= 2 * r.size for r in found)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    size, names = {}, sorted({s for *_, s in data if s}) + [None]
    for _, text, source in data:
        size[source] = size.get(source, 0) + len((text or "").split())
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    target, open_sources, rest = {}, set(names), 1.5 * sum(size.values())
    while open_sources:
        level = rest / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if level * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_sources}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            rest -= target[s]
        open_sources -= full
    source_of = dict((d, s) for d, _, s in data)
    taken = {}
    for r in found:
        s = source_of[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == size[s]
        taken[s] = taken.get(s, 0) + r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 60
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(none).count() == 0
    assert abs(sum(len((r.text or "").split()) for r in mixed.collect()) - sum(target.values())) <= 60 * len(names)


def test_a_row_repeated_very_often_is_written_out_by_many_tasks(spark, monkeypatch):
    once = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.lit("a b")).alias("text"), F.lit("s").alias("source")
    )
    same = spark.range(100_000).select(
        F.lit(7).cast("long").alias("doc_id"), F.lit("the same three").alias("text"), F.lit("t").alias("source")
    )
    docs = once.unionByName(same)
    plain = {str(r): r["n"] for r in mixing.mix(docs).groupBy("doc_id", "size", "taken").agg(F.count("*").alias("n")).collect()}
    texts = {str(r) for r in mixing.mixed_documents(docs).groupBy("doc_id", "text").count().collect()}
    monkeypatch.setattr(mixing, "AT_ONCE", 2000)
    chunked = mixing.mix(docs)
    assert {str(r): r["n"] for r in chunked.groupBy("doc_id", "size", "taken").agg(F.count("*").alias("n")).collect()} == plain
    assert chunked.count() == 102_000
    mixed = mixing.mixed_documents(docs)
    assert {str(r) for r in mixed.groupBy("doc_id", "text").count().collect()} == texts
    for result in (chunked, mixed):
        largest = result.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest < 0.5 * result.count()


# transcripts ----------------------------------------------------------------------------------


def test_viterbi_equals_enumeration_and_chats_are_recovered(spark):
    turns = []
    for conversation in range(60):
        for turn in range(6):
            role = ("user", "assistant")[turn % 2]
            text = prose(conversation * 10 + turn, 5) + "?" if role == "user" else prose(turn + 7 * conversation, 30) + ".\n" + prose(turn, 20)
            turns.append((conversation, turn, role, text))
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("x"))
    model = transcripts.train(frame, ~is_held_out("conv_id"))
    result = transcripts.format_chats(frame, model).collect()
    assert len(result) == 60 and sum(r.n_right for r in result) / sum(r.n_lines for r in result) > 0.95
    assert all(r.rendered.startswith("<|user|>\n") for r in result)
    seen = transcripts.observe(["User: hi", "there", "", "ok."])
    states, size = model.decode(seen), range(len(transcripts.STATES))

    def value(path):
        total = model.start[path[0]]
        for n, s in enumerate(path):
            total += sum(t[v] for t, v in zip(model.show[s], seen[n])) + (model.step[path[n - 1]][s] if n else 0)
        return total

    assert value(states) == pytest.approx(max(map(value, itertools.product(size, repeat=4))))


def test_chats_odd_rows(spark):
    odd_turns = [(1, None, None, None), (1, 0, "user", None), (None, 1, "tool", "x"), (2, 1, "user", "hello"), (2, 1, "user", "hello")]
    odd_turns += [(3, n, ("user", "assistant")[n % 2], f"line {n}") for n in range(2500)]
    frame = spark.createDataFrame(odd_turns, "conv_id long, turn long, role string, text string")
    model = transcripts.train(frame, F.lit(True))
    result = transcripts.format_chats(frame, model).collect()
    assert {r.conv_id for r in result} == {1, 2, 3, None}
    assert sorted(r.window for r in result if r.conv_id == 3) == [0, 1, 2]
    assert sum(r.rendered.count("line ") for r in result if r.conv_id == 3) == 2500
    assert transcripts.format_chats(frame.limit(0), transcripts.train(frame.limit(0), F.lit(True))).count() == 0


def test_chat_windows_hold_a_bounded_number_of_rows(spark):
    many = 2500
    turns = [(1, None, "user", f"line {n:05}") for n in range(many)]  # null turns
    turns += [(2, 7, "assistant", f"line {n:05}") for n in range(many)]  # tied turns
    turns += [(None, n, "user", f"line {n:05}") for n in range(many)]  # no id
    turns += [(3, n * 10**6, "user", f"line {n:05}") for n in range(5)]  # turns far apart are one conversation
    turns += [(4, n, "user", f"line {n:05}") for n in range(transcripts.WINDOW)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    rows = transcripts._windows(frame, "conv_id").select("_id", "window", F.size("turns").alias("n")).collect()
    full = transcripts.WINDOW + transcripts.OVERLAP
    hot = [(0, full), (1, full + transcripts.OVERLAP), (2, many - 2 * transcripts.WINDOW + transcripts.OVERLAP)]
    for conversation in (1, 2):
        assert sorted((r.window, r.n) for r in rows if r._id == conversation) == hot
    assert [(r.window, r.n) for r in rows if r._id is None] == [(0, 1)] * many
    assert [(r.window, r.n) for r in rows if r._id == 3] == [(0, 5)]
    assert [(r.window, r.n) for r in rows if r._id == 4] == [(0, transcripts.WINDOW)]
    result = transcripts.format_chats(frame, transcripts.train(frame, F.lit(True))).collect()
    for conversation in (1, 2, None):
        found = sorted((r for r in result if r.conv_id == conversation), key=lambda r: r.window)
        lines = re.findall(r"line (\d+)", "".join(r.rendered for r in found))
        assert sorted(map(int, lines)) == list(range(many))
        assert conversation is None or lines == sorted(lines)


# fingerprints ---------------------------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_fingerprints_of_edited_texts(spark, none):
    data = [(n * 7, prose(n % 9, 5 + 3 * n)) for n in range(40)] + [(500, None), (501, ""), (502, "é" * 9), (503, LONG), (503, LONG), (None, "last one here")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    found = by_id(fingerprints.fingerprint_documents(docs))
    assert sum(map(len, found.values())) == len(data)
    order = list(dict.fromkeys(sorted(data, key=lambda d: (d[0] is None, -(d[0] or 0)))))
    prints = {}
    for n, (number, text) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = found[number][0]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = map(shingle_set, (text, edited, following))
        for estimate, one, other in ((row.near_edited, a, b), (row.near_next, a, c)):
            real = len(one & other) / len(one | other) if one | other else 1.0
            small = len(one | other) <= fingerprints.K
            assert estimate == pytest.approx(real, abs=1e-9 if small else 0.25)
        prints.setdefault(text, set()).add(row.fingerprint)
    assert all(len(values) == 1 for values in prints.values())
    assert fingerprints.fingerprint_documents(none).count() == 0


def test_sketches_merge(spark):
    one, other = prose(1, 300), prose(2, 300)
    frame = spark.createDataFrame([(one, other, one + " " + other)], "a string, b string, c string")
    for name in "abc":
        frame = fingerprints.add_sketch(frame, name, f"s{name}", 64)
    row = frame.select(fingerprints.merge_sketches(F.col("sa"), F.col("sb"), k=64).alias("m"), "sc",
                       fingerprints.containment(F.col("sa"), F.col("sc"), 64).alias("inside"),
                       fingerprints.distinct_shingles(F.col("sc"), 64).alias("n")).first()
    assert len(set(row.m) & set(row.sc)) >= 62  # only the four shingles across the seam differ
    assert row.inside > 0.75 and row.n == pytest.approx(len(shingle_set(one + " " + other)), rel=0.35)


# near-duplicates ------------------------------------------------------------------------------


def test_near_duplicate_classes(spark, odd, none):
    pick = random.Random(8)
    data, number = [], 0
    truth = {}
    for family in range(30):
        base = [pick.choice(WORDS) + str(pick.randrange(50)) for _ in range(150)]
        for copy in range(4):
            text = list(base)
            if copy:
                text[pick.randrange(150)] = "changed"
            data.append((number, " ".join(text)))
            truth[number] = family
            number += 1
    data += [(900, prose(1, 3)), (901, prose(1, 3)), (902, None), (903, ""), (904, None), (905, "!!"), (None, data[0][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("class_id", F.lit("x"))
    found = {}
    for r in neardups.near_duplicates(docs).collect():
        found[r.doc_id] = r.class_id
    for number, family in truth.items():
        assert found[number] == family * 4
    assert found[901] == 900 and [found[n] for n in (902, 903, 904, 905)] == [902, 903, 904, 905] and found[None] == 0
    kept = neardups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([f * 4 for f in range(30)] + [900, 902, 903, 904, 905])
    assert neardups.near_duplicates(odd).count() == odd.count()
    kept_odd = [r.doc_id for r in neardups.drop_near_duplicates(odd).collect()]
    assert kept_odd.count(7) == 1 and 8 not in kept_odd
    assert neardups.near_duplicates(none).count() == 0 and neardups.drop_near_duplicates(none).count() == 0


def test_samples_agree_as_often_as_weighted_jaccard():
    pick = np.random.default_rng(2)
    hashes = np.sort(pick.integers(0, 1 << 54, 4000, dtype=np.uint64))
    errors = []
    for part in range(20):
        own = hashes[part * 200 : part * 200 + 200]
        one, other = pick.uniform(0.5, 3, 200), pick.uniform(0.5, 3, 200)
        other[:60] = one[:60]
        both = neardups.samples(np.concatenate([own, own]), np.concatenate([one, other]), np.array([0, 200]))
        errors.append((both[:, 0] == both[:, 1]).mean() - np.minimum(one, other).sum() / np.maximum(one, other).sum())
    assert abs(np.mean(errors)) < 0.03


def test_hot_keys_stay_connected(spark):
    base = [f"w{n}" for n in range(200)]
    data = [(n, " ".join(base[:199] + [f"end{n}"])) for n in range(60)]
    signed = spark.createDataFrame(data, "doc_id long, text string")
    rows_ = neardups._digests(signed, "doc_id", "text")
    rarity = spark.sparkContext.broadcast(neardups.rarities(rows_))
    signed = neardups.signatures(rows_, rarity)
    pairs = neardups.nearest_pairs(signed, neardups.shared_bands(signed), group=8)
    assert neardups.components(pairs).select("root").distinct().count() == 1


def test_no_link_is_lost_to_limits(spark):
    """Classes with tiny groups and limits are those of all close pairs of the same band keys."""
    pick = random.Random(5)
    texts = []
    for family in range(3):
        base = [f"f{family}w{n}" for n in range(200)]
        for copy in range(50):
            text = list(base)
            for place in pick.sample(range(200), pick.choice([1, 2, 3, 4, 5, 6, 8])):
                text[place] = f"edit{family}x{copy}x{place}"
            texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows_ = neardups._digests(docs, "doc_id", "text")
    rarity = spark.sparkContext.broadcast(neardups.rarities(rows_))
    signed = neardups.signatures(rows_, rarity)
    places = {(r.d.x, r.d.y): r._id for r in rows_.collect()}
    keys, drawn = {}, {}
    for r in signed.collect():
        at = places[(r.d.x, r.d.y)]
        keys[at], drawn[at] = set(r.keys), np.frombuffer(r.signature, "<u2")
    pairs = [
        (a, b) for a in keys for b in keys
        if a < b and keys[a] & keys[b] and (drawn[a] == drawn[b]).sum() >= neardups.LEAST_EQUAL
    ]
    near = neardups.similarities(pa.array([texts[a] for a, _ in pairs]), pa.array([texts[b] for _, b in pairs]), rarity.value)
    root = {at: at for at in keys}

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    for (a, b), value in zip(pairs, near):
        if value >= neardups.SIMILAR:
            one, other = sorted((find(a), find(b)))
            root[other] = one
    expected = sorted(find(at) for at in keys)
    assert 3 <= len(set(expected)) < len(texts)
    for limits in ({"group": 8, "nearest": 1}, {"group": 16, "nearest": 2}, {}):
        classes = neardups.linked_texts(signed, rows_, rarity, **limits).collect()
        names = {}
        for r in classes:
            names.setdefault((r.root.x, r.root.y), []).append(places[(r.v.x, r.v.y)])
        found = {at: min(group) for group in names.values() for at in group}
        assert sorted(found.get(at, at) for at in keys) == expected
    # with every text a component of its own, the blocks alone find the same classes, from few links
    members = neardups.shared_bands(signed)
    alone = members.select("d").distinct().withColumn("root", F.col("d"))
    searched = neardups.open_members(members, alone, 16)
    links = neardups.crossing_links(signed, rows_, rarity, searched)
    names = {}
    for r in neardups.components(links).collect():
        names.setdefault((r.root.x, r.root.y), []).append(places[(r.v.x, r.v.y)])
    found = {at: min(group) for group in names.values() for at in group}
    assert sorted(found.get(at, at) for at in keys) == expected
    tasks = searched.select("key", "rows", "columns").distinct().selectExpr("sum(rows * columns)").first()[0]
    texts_in_tasks = searched.selectExpr("sum(rows + columns)").first()[0]
    assert links.count() <= texts_in_tasks - tasks


# secrets --------------------------------------------------------------------------------------


def base_by_definition(text):
    spans = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def test_secret_base_spans_equal_definition(spark, odd, none):
    texts = [
        'é password = "hunter22" Token:abc secret: token: abcdefgh',
        "AKIA" + "X1" * 8 + " AKIASHORT akia" + "0123456789abcdef" * 2 + "g",
        "API_KEY=aaaaaa api-key: zzz apıkey=abcdefg paſſword=abcdefgh tokKen=abcdefgh toKen=abcdefgh",
        "passwd:'" + "x" * 5 + "' PASSWD:'" + "q7Rz9Lm2Kp" + "' pwd=Tr0ub4dor&3xKq9z",
    ]
    docs = odd.unionByName(spark.createDataFrame([(60 + n, t, None, None, None, None, None, None) for n, t in enumerate(texts)], SCHEMA))
    result = secrets.scan_secrets(docs)
    assert result.columns.count("spans") == 1
    found = by_id(result.select("doc_id", "base_sha256", "spans", "n_assign", "n_hex"))
    for row in docs.collect():
        expected = base_by_definition(row.text or "")
        assert any(r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest() for r in found[row.doc_id])
    assert "guess" in found[63][0].spans
    masked = by_id(secrets.mask_secrets(docs, length="n_chars"))
    assert "hunter22" not in masked[60][0].text and masked[60][0].n_chars == len(masked[60][0].text)
    assert sorted(map(str, masked)) == sorted(map(str, found)) and masked[7][0].text == prose(1, 80)
    assert secrets.scan_secrets(none).count() == 0 and secrets.mask_secrets(none).count() == 0


def test_secret_prefilter_lets_every_context_name_through():
    names = ["pass", "password", "passWd", "passphrase", "passCode", "pwd", "secret", "token", "auth", "credential", "credentials", "bearer"]
    names += [a + b + "Key" for a in ("api", "access", "private") for b in ("", "_", "-")]
    texts = [f"{name}{mark}zK39xQw7Lp2m" for name in names for mark in (": ", "=")]
    found = dict(secrets._candidates(pa.array(texts)))
    assert found == {row: secrets.find_secrets(text) for row, text in enumerate(texts)}
    assert all(spans[-1][2] == "guess" for spans in found.values())


def test_a_repeat_of_any_length_is_one_span():
    for group in ("a", "ab", "x7q", "abcd"):
        for many in (65, 260, 5000):
            each = math.log10(secrets._variety(group))
            assert secrets.guess_cost(group * many) <= len(group) * each + math.log10(many) + 1e-9
    assert [span[2] for span in secrets.find_secrets("auth: " + "z" * 260)] == []
    assert secrets.guess_cost("hR7x9Kq2LmPz" + "a" * 300) > secrets.guess_cost("hR7x9Kq2LmPz")
    # against every start and period
    pick = random.Random(5)
    for _ in range(300):
        value = "".join(pick.choice("jv") * pick.choice((1, 1, 2, 5)) if pick.random() < 0.8 else "jvv" * 4 for _ in range(12))
        each, best = math.log10(26), [0.0]
        for end in range(1, len(value) + 1):
            spans = [best[end - 1] + each]
            for period in (1, 2, 3, 4):
                for start in range(end - 3 * period, -1, -period):
                    if value[start : end - period] == value[start + period : end]:
                        spans.append(best[start] + period * each + math.log10((end - start) // period))
            best.append(min(spans))
        assert secrets.guess_cost(value) == pytest.approx(best[-1])


def test_guess_cost_orders_values():
    assert secrets.guess_cost("password") < secrets.guess_cost("p4ssword") < secrets.guess_cost("password1987") < 10
    assert secrets.guess_cost("qwertyuiop") < 6 and secrets.guess_cost("aaaaaaaaaaaa") < 6 and secrets.guess_cost("abcabcabcabc") < 9
    assert secrets.guess_cost("hR7x9Kq2LmPz") > 15
    assert secrets.mask("ab cd ef", [(0, 2, "x"), (1, 4, "y"), (6, 8, "z")]) == "[SECRET]d [SECRET]"
