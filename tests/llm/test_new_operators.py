"""Phrases, centroids and the archive against brute force, and their odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pixelloom.llm import archive, centroids, phrases
from pixelloom.llm.common import work_folder

DOCS = "doc_id long, text string, lang string, source string, key string, f int, k int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "key", 1, 2) for i, (t, lang) in enumerate(rows)], DOCS)


def brute_phrases(rows, least, top):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in candidates.items():
        longer = [v for v, f in candidates.items() if v[0] == lang and len(v[1]) > len(words) and f >= a]
        if any(v[1][i : i + len(words)] == words for v in longer for i in range(len(v[1]))):
            continue
        cut = min(
            (1000 * a * n[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))
        )
        l, r = counts[lang, words[: cut[1]]], counts[lang, words[cut[1] :]]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(words).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def test_phrases_equal_brute_force(spark):
    draw = random.Random(3)
    words = ["a", "b", "The", "the", "é", "x\u0000y", "\u0001", "\u0001\u0001", "zz", "q" * 50, "\x02t"]
    rows = [
        ("".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(draw.randint(0, 60))),
         draw.choice(["en", "en", None, "und", "", "a\u0000b"]))
        for _ in range(300)
    ]
    rows += [(None, "en"), ("", None), (" \t ", "en"), ("...", "en"), ("x " * 3000, "fr"), ("same words come again here " * 3, "de")] * 3
    for least, top in ((3, 1000), (12, 7), (10_000, 5)):
        got = phrases.collocations(docs_of(spark, rows), least=least, top=top)
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, top)


def test_phrase_runs_across_batches_and_ranges(spark):
    # one very frequent pair with many continuations: its run crosses batches and ranges of the stream
    draw = random.Random(4)
    rows = [(" ".join(f"hot pair w{draw.randint(0, 400)} v{draw.randint(0, 9)}" for _ in range(40)), "en") for _ in range(150)]
    kept = {"spark.sql.shuffle.partitions": "13", "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        got = phrases.collocations(docs_of(spark, rows), least=8, top=5000).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 8, 5000)


def test_phrases_whose_filter_lets_everything_pass(spark, monkeypatch):
    rows = [(f"one two w{i} three four", "en") for i in range(60)]
    monkeypatch.setattr(phrases, "CODES", 2)  # some words coded, some spelled out
    full = phrases.np.full(4096, 255, phrases.np.uint8)
    monkeypatch.setattr(phrases, "_bitmap", lambda frequent: full)
    got = phrases.collocations(docs_of(spark, rows), least=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 5, 2000)


def test_phrases_of_a_long_text_and_of_nothing(spark):
    draw = random.Random(5)
    long = " ".join(draw.choice("abcdefghij") * 9 for _ in range(130_000))  # over one piece of text
    assert len(long) > 1 << 20
    long = long * 4
    rows = [(long, "en"), ("aaaaaaaaa bbbbbbbbb", None)]
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), least=100, top=50).collect()) == brute_phrases(rows, 100, 50)
    assert phrases.collocations(docs_of(spark, []).limit(0)).collect() == []


def test_phrases_have_exact_scores_past_64_bits(spark):
    # counts of a corpus no test can hold: the product of a, n and 1000 has over 100 bits
    cut = spark.createDataFrame([("en", ["a", "b"], 3 * 10**12, 1, 4 * 10**12 + 1, 5 * 10**12)], "lang string, words array<string>, a long, k int, l long, r long")
    totals = spark.createDataFrame([("en", 10**14 + 7)], "lang string, n long")
    row = phrases._ranked(cut, totals, 5).first()
    assert row["score"] == 1000 * 3 * 10**12 * (10**14 + 7) // ((4 * 10**12 + 1) * 5 * 10**12)


VECTORS = "vec_id long, embedding array<float>, label int, cluster int, distance string"


def brute_clusters(rows, k, rounds, dims):
    kept = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1]))
    middles = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        middles = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(middles)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, j, d in placed:
        per[j] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return sorted(((i, j, d, per[j], sum(per.values()), names[j]) for i, j, d in placed), key=str)


@pytest.mark.parametrize("n, k", [(400, 16), (5, 16), (0, 4)])
def test_clusters_equal_brute_force(spark, n, k):
    draw = random.Random(n)
    rows = [(i, [draw.choice([-1.0, -0.5, 0.25, 0.0, draw.gauss(0, 1)]) for _ in range(8)]) for i in range(n)]
    if n > 10:
        rows += [(None, rows[3][1]), rows[4], (7, rows[5][1])] + [rows[9]] * 60
        rows += [(900, None), (901, []), (902, [0.0] * 7), (903, [0.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] * 8)]
    rows = [(i, v if v is None else [x if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, 5, "d") for i, v in rows], VECTORS)
    got = centroids.cluster(df, k=k, rounds=3, dims=8).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_clusters(rows, k, 3, 8)


def test_clusters_refuse_integers_that_would_overflow(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 1, 1, "")], VECTORS)
    with pytest.raises(Exception, match="a scaled component is beyond"):
        centroids.cluster(df, dims=8).collect()


PAGES = "page_id long, url string, html string, payload string, keeper int, n int"


def test_archive_round_trip(spark):
    big, other, odd = "é" * 600, "b" * 1000, "c" * 999
    rows = [
        (1, "u1", big), (2, "u2", big), (3, "u\r\nWARC-Type: x", big), (4, None, other), (4, "u", other), (None, "n", big), (5, "s", odd),
        (6, "s", odd), (7, "s", None), (8, "s", ""), (9, " WARC-Refers-To: <urn:page:1:x>", "x\r\n\r\ny"), (None, "m", "m" * 2000), (-3, "z", "z" * 5000), (-2, "z", "z" * 5000),
    ]
    path = work_folder(spark, "archive-test")
    archive.write_archive(spark.createDataFrame([(*r, "p", 1, 2) for r in rows], PAGES), path)
    got = archive.sound(archive.read_archive(spark, path)).collect()
    assert sorted((r["page_id"] or 0, bytes(r["payload"])) for r in got) == sorted((i or 0, (h or "").encode()) for i, _, h in rows)
    kinds = {(r["page_id"], r["url"]): (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[1, "u1"] == kinds[2, "u2"] == kinds[None, "n"] == ("revisit", 3)
    assert kinds[3, "u%0D%0AWARC-Type: x"] == ("response", None)
    assert kinds[4, None] == kinds[4, "u"] == ("response", None)
    assert {kinds[i, "s"] for i in (5, 6, 7, 8)} == {("response", None)} == {kinds[None, "m"]}
    assert kinds[-3, "z"] == ("revisit", -2)
    for r in got:
        payload, record = bytes(r["payload"]), bytes(r["record"])
        assert r["payload_digest"] == hashlib.sha1(payload).hexdigest() and r["payload_bytes"] == len(payload)
        head, block = record.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert block[length:] == b"\r\n\r\n"
        assert block[:length].endswith(payload if r["record_type"] == "response" else b"\r\n\r\n")
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({h or "" for _, _, h in rows})


def test_archive_finds_damage(spark):
    path = work_folder(spark, "archive-test")
    archive.write_archive(spark.createDataFrame([(i, "u", f"{i}" * 1200, "", 1, 1) for i in range(3)], PAGES), path)
    payloads = spark.read.parquet(f"{path}/payloads").collect()
    worse = [(r[0], bytes(r[1]), r[2], r[3]) for r in payloads if bytes(r[1])[:1] != b"0"]
    worse[0] = (worse[0][0], worse[0][1] + b"!", *worse[0][2:])
    other = work_folder(spark, "archive-test")
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    spark.createDataFrame(worse, archive.PAYLOADS).write.parquet(f"{other}/payloads")
    problems = Counter(r["problem"] for r in archive.read_archive(spark, other).collect())
    assert problems == {None: 1, "payload is missing": 1, "stored payload has another sha256": 1}
    with pytest.raises(Exception, match="damaged record"):
        archive.sound(archive.read_archive(spark, other)).collect()


def test_archive_of_nothing(spark):
    path = work_folder(spark, "archive-test")
    archive.write_archive(spark.createDataFrame([], PAGES), path)
    assert archive.read_archive(spark, path).count() == 0


def test_ranges_of_phrases_follow_key_order():
    import pyarrow as pa

    class Shared:
        value = phrases.np.sort(phrases.np.array([b"en\0b", b"en\0b\0c", b"fr"], "S64"))

    keys = sorted({b"de\0a\0", b"en\0a\0", b"en\0b\0", b"en\0b\0c\0", b"en\0b\0c\0d\0", b"fr\0", b"fr\0" + b"x" * 90, b"fr\0" + b"x" * 99})
    batch = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "f": pa.array([1] * len(keys))})
    (out,) = phrases._placed(Shared)([batch])
    at = out.column("range").to_pylist()
    assert at == sorted(at) and set(at) == {0, 1, 2, 3}
    assert out.column("key").to_pylist() == keys


def test_phrases_take_one_python_worker_a_core(spark, monkeypatch):
    plans, saved = {}, phrases.saved

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return saved(df, name)

    monkeypatch.setattr(phrases, "saved", seen)
    rows = [("a b c d", "en")] * 5
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), least=5).collect()) == brute_phrases(rows, 5, 2000)
    # one step before the exchange of the ranges, one after it
    assert plans["counts"].count("MapInArrow") == 2
    before_exchange = plans["counts"].split("RepartitionByExpression")[1]
    assert before_exchange.count("MapInArrow") == 1
