"""Decontamination, ranked search and periodic runs against brute force and on odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowproof.llm import decontaminate, packing, ranked, repeats, secrets
from rowproof.llm.decontaminate import words_of

SCHEMA = "doc_id long, text string, spans string, row int, n_words string, score int, query string"
ITEMS = "item_id long, text string, text_ string"
PASSAGE = "the quick brown fox jumps over a lazy dog while seven wizards brew jelly"
LONG = "x1 " * 40_000


def docs_of(spark, texts, repeat=1):
    rows = [(None if n == 3 else n, text, "s", n, None, n, "q") for n, text in enumerate(texts)]
    return spark.createDataFrame(rows * repeat, SCHEMA).repartition(3)


# decontamination ------------------------------------------------------------------------------


def hits_of(words, items, limit):
    places, found = set(), set()
    for item_id, item in items:
        size = min(limit, len(item))
        for a in range(len(item) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == item[a : a + size]:
                    places.update(range(i, i + size))
                    found.add(item_id)
    return places, found


def test_automaton_equals_brute_force():
    pick = random.Random(1)
    for _ in range(800):
        limit = pick.choice([2, 3, 4])
        items = [[b"%d" % pick.randrange(3) for _ in range(pick.randrange(9))] for _ in range(pick.randrange(5))]
        words = [b"%d" % pick.randrange(4) for _ in range(pick.randrange(30))]
        index = decontaminate.Index(items, [str(n) for n in range(len(items))], limit)
        places, found = set(), set()
        for _, spans, numbers, _ in index.search([words]):
            found |= set(numbers)
            for start, end in spans:
                places.update(range(start, end))
        assert (places, found) == hits_of(words, list(enumerate(items)), limit)


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 20, "piece_words": 14}])
def test_scan_contamination(spark, sizes):
    texts = [
        PASSAGE.upper() + " end", "before " + " ".join(PASSAGE.split()[2:12]) + ", after", " ".join(PASSAGE.split()[:9]), PASSAGE,
        None, "", "!!", "short item here", "the short item", LONG, "\u00f1and\u00fa x", "tail " + PASSAGE + " " + PASSAGE,
    ]
    docs = docs_of(spark, texts, 2)
    given = [(1, PASSAGE), (2, "Short item"), (2, "\u00d1and\u00fa"), (7, PASSAGE), (None, "tail the quick"), (4, None), (5, "..."), (1, PASSAGE), (8, "a b c " * 9)]
    items = spark.createDataFrame([(*item, "t") for item in given], ITEMS)
    rows = decontaminate.scan_contamination(docs, items, **sizes).collect()
    assert len(rows) == 2 * len(texts)
    by_count = collections.Counter(tuple(row)[:6] for row in rows)
    split = [(None if key is None else str(key), words_of((text or "").encode())) for key, text in given]
    for n, text in enumerate(texts):
        words = words_of((text or "").encode())
        places, found = hits_of(words, split, 10) if n != 9 else (set(), set())
        named = sorted(found - {None})
        sha = hashlib.sha256(",".join(named).encode()).hexdigest()
        key = (None if n == 3 else n, len(words), len(places), len(named), sha, bool(places))
        assert by_count[key] == 2, (n, key, by_count)
    empty = decontaminate.scan_contamination(docs, items.limit(0), **sizes)
    assert empty.where("contaminated").count() == 0 and empty.count() == len(rows)
    assert decontaminate.scan_contamination(docs.limit(0), items, **sizes).count() == 0


def test_decontaminate_removes_spans_and_covered_documents(spark):
    padding = " ".join(f"w{i}" for i in range(40))
    docs = docs_of(spark, [f"{padding} {PASSAGE}, {padding}", PASSAGE, padding, None])
    items = spark.createDataFrame([(1, PASSAGE, "t")], ITEMS)
    found = {row["row"]: row for row in decontaminate.decontaminate(docs, items).collect()}
    assert set(found) == {0, 2, 3} and set(found[0].asDict()) == set(docs.columns)
    assert found[0]["text"] == f"{padding} , {padding}" and found[2]["text"] == padding and found[3]["text"] is None
    assert found[0]["spans"] == "s"


# ranked search --------------------------------------------------------------------------------


def ranking(docs, items, k):
    split = [(key, words_of((text or "").encode())) for key, text in docs]
    split = [(key, words, collections.Counter(words)) for key, words in split if words]
    count, total = len(split), sum(len(words) for _, words, _ in split)
    df = collections.Counter(term for _, _, c in split for term in c)
    out = []
    for item_id, text in items:
        scores = []
        for key, words, c in split:
            m = 50 + 50 * len(words) * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(words_of((text or "").encode())) & c.keys()
            )
            if score > 0:
                scores.append((-score, math.inf if key is None else key, key))
        scores.sort(key=lambda row: row[:2])
        out += [(item_id, rank, key, -score) for rank, (score, _, key) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_pairs", [ranked.PASS_PAIRS, 4])
def test_ranking_equals_brute_force(spark, pass_pairs):
    pick = random.Random(4)
    pool = [f"t{min(int(pick.expovariate(0.08)), 60)}" for _ in range(4000)]
    texts = [" ".join(pick.choice(pool) for _ in range(pick.randrange(1, 40))) for _ in range(300)]
    texts[:3] = [None, "", "T1 t1 T2"]
    texts += [texts[9]] * 5 + [LONG + "t5"]
    docs = docs_of(spark, texts)
    given = [(n, " ".join(pick.choice(pool) for _ in range(pick.randrange(1, 9)))) for n in range(6)]
    given += [(3, None), (4, "zzz"), (5, "t5 t5"), (5, "t5 t5")]
    items = spark.createDataFrame([(*item, "t") for item in given], ITEMS)
    found = sorted(map(tuple, ranked.rank_documents(docs, items, 20, pass_pairs=pass_pairs).collect()), key=str)
    pairs = [(row["doc_id"], row["text"]) for row in docs.select("doc_id", "text").collect()]
    assert found == ranking(pairs, given[:-1], 20)
    assert ranked.rank_documents(docs, items.limit(0)).count() == 0
    assert ranked.rank_documents(docs.limit(0), items).count() == 0


def test_blocks_are_skipped():
    """Topics of their own words plus common ones: most documents of the common lists are never scored."""
    pick = np.random.default_rng(3)
    queries = ranked.Queries([[b"a%d" % (10 * topic + i) for i in range(5)] + [b"common"] for topic in range(8)])
    searcher, n = None, 3000
    topics = pick.integers(0, 8, n)
    rows = [sorted({queries.known[b"common"], *(queries.known[b"a%d" % (10 * t + i)] for i in pick.integers(0, 5, 3))}) for t in topics]
    df = np.bincount(np.concatenate(rows), minlength=len(queries.known))
    searcher = ranked.Searcher(queries, df, n, 50 * n, 10)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    searcher.add(np.arange(n), np.full(n, 50), bounds, np.concatenate(rows), pick.integers(1, 6, bounds[-1]))
    assert searcher.looked < 0.2 * n * len(queries.terms)
    assert (searcher.best.scores > 0).all()


# periodic runs --------------------------------------------------------------------------------


def runs_of(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i + q - start >= max(6, 4 * q):
                    found.setdefault((start, i + q - start), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def test_runs_equal_brute_force(monkeypatch):
    monkeypatch.setattr(repeats, "CANDIDATES", 50)
    pick = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(pick.randrange(1, 6)):
            words = [b"%d" % pick.randrange(pick.choice([1, 2, 3, 50])) for _ in range(pick.randrange(120))]
            if pick.random() < 0.5 and words:
                at, size = pick.randrange(len(words)), pick.randrange(1, 30)
                words = words[:at] + (words[at : at + size] * 300)[: pick.randrange(400)] + words[at:]
            texts.append(words)
        assert repeats._runs_of(texts) == [runs_of(words) for words in texts]


def test_extensions_equal_comparison():
    pick = np.random.default_rng(1)
    words = np.concatenate([np.tile(pick.integers(0, 3, 37), 12), pick.integers(0, 2, 300), [-1]])
    lce = repeats.CoverExtensions(words)
    left, right = pick.integers(0, len(words), (2, 4000))
    left, right = left[left != right], right[left != right]
    for i, j, found in zip(left, right, lce.extend(left, right)):
        size = 0
        while max(i, j) + size < len(words) and words[i + size] == words[j + size]:
            size += 1
        assert found == size


def test_scan_repeats(spark):
    texts = [None, "", " \n\t", "one", "ab " * 5, "ab " * 6, "a b " * 4, "x " + "a b c " * 5 + "a y", LONG, "\u00f1 \u00a0 " * 9, *[f"w{i} v" * 3 for i in range(30)]]
    docs = docs_of(spark, texts, 2)
    rows = repeats.scan_repeats(docs, plant=True).collect()
    assert len(rows) == 2 * len(texts)
    found = {row["doc_id"]: row for row in rows}
    planted = 0
    for n, text in enumerate(texts):
        key = None if n == 3 else n
        words = (text or "").encode().split()
        mark = zlib.crc32(str(key).encode())
        if key is not None and mark % 10 == 0 and words:
            planted += 1
            start = mark // 10 % len(words)
            period = 1 + (len(words) - start) // (3 + mark // 10 % 8)
            words = [w if i < start else words[start + (i - start) % period] for i, w in enumerate(words)]
        runs = [(0, 40_000, 1)] if n == 8 and mark % 10 else runs_of(words) if len(words) < 1000 else None
        row = found[key]
        if runs is None:
            continue
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        assert row["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        best = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=(None, None, None))
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (None if not runs else 1000 * best[1] // best[2])
    assert planted
    assert repeats.scan_repeats(docs.limit(0)).count() == 0
    listed = {row["doc_id"]: row for row in repeats.repeat_runs(docs).collect()}
    assert [tuple(run) for run in listed[7]["runs"]] == [(1, 16, 3)] and listed[0]["n_words"] == 0
    collapsed = {row["row"]: row for row in repeats.collapse_repeats(docs).collect()}
    assert collapsed[7]["text"] == "x a b c y" and collapsed[6]["text"] == "a b" and collapsed[0]["text"] is None
    assert set(collapsed[0].asDict()) == set(docs.columns) and collapsed[2]["text"] == " \n\t"


# repairs --------------------------------------------------------------------------------------


def test_token_ids_after_letters_that_normalise_to_marks():
    encoder = packing.Encoder(packing.tokenizer_path())
    letters = [chr(c) for c in range(0x20000) if chr(c).isalnum()]
    pick = random.Random(5)
    texts = [letter + "?" for letter in letters]
    for mark in packing.MARKS:
        texts += [f"ab{letter}{mark}" for letter in pick.sample(letters, 300)]
    texts += ["".join(pick.choice("aB1 .,\n\t\u00e9\u0130\u0915\u093c\u0301T\u0308\u00bd") for _ in range(pick.randrange(1, 25))) for _ in range(5000)]
    for start in range(0, len(texts), 4000):
        some = texts[start : start + 4000]
        want = [found.ids for found in encoder.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode([text.encode() for text in some])] == want


def test_ordinary_words_are_no_secrets(spark):
    plain = [
        "bearer: certificate", "The auth: authentication is done", "passphrase: remembering", "auth = get_user_model()",
        "compass: northeast", "auth: kubernetes", "auth = environment", "auth: required_field", "bypass = something",
        "credentials: international.organization", "pwd: Summer2024!",
    ]
    secret = ["privateKey=hR7x9Kq2LmPz", "accessKey: zK39xQw7Lp2m", "db_auth = 'q8Zr!x0Pw3Lk'", "userAuth: vB71kQz93LpX"]
    assert [secrets.find_secrets(text) for text in plain] == [[]] * len(plain)
    assert all(secrets.find_secrets(text)[-1][2] == "guess" for text in secret)
    # a word of the corpus that no vocabulary has, and a secret that stands in many copies
    docs = docs_of(spark, ["auth: qvellorianth", *["the qvellorianth came"] * 20, *["privateKey=hR7x9Kq2LmPz"] * 50])
    spans = [row["spans"] for row in secrets.scan_secrets(docs.drop("spans")).collect()]
    assert sorted(set(spans)) == ["", "guess:11:23"] and spans.count("") == 21
    assert "hr" not in secrets.word_ranks(docs) or "lmpz" not in secrets.word_ranks(docs)


def test_clean_documents_of_the_given_tables_keep_their_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = secrets.scan_secrets(docs.select("doc_id", "text")).where("spans <> ''").collect()
    named = [row for row in found if "guess" in row["spans"]]
    # every guessed value stands where a secret was put: no letters-only value is masked
    for row in named:
        for span in row["spans"].split(","):
            kind, start, end = span.split(":")
            if kind == "guess":
                assert not row["text"][int(start) : int(end)].isalpha()


def test_columns_of_documents_survive_the_stages(spark):
    import corpus_pipeline

    names = ["score", "rejected", "lang_pred", "_kept", "_d", "_row", "d", "row", "kept", "document"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(20))
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        wrong = docs.where(" OR ".join(f"{name} <> concat('{name}', doc_id)" for name in names))
        assert wrong.count() == 0 and set(names) <= set(docs.columns)
