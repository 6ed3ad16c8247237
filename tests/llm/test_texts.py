import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows

mixing = pytest.importorskip("millrace.llm.mixing")
from millrace.llm import packing, quality, tokens  # noqa: E402

PROSE = "The fix is to let the worker decide what happens to the last page before it goes on. Nobody had thought of that, and it was easy to miss for all of us."
TEXTS = [
    PROSE, PROSE, "", None, " ", "\n\n\t  x\u00a0 y", "don't we'll I'M 'tis x's", "a\x1cb \x1d c", "日本語のテキスト and English", "🙂🙂 ok", "x" * 5000, "1,234.5 + 6e-7\r\n\r\n  done\r\n",
    "  lead and trail   ", "tab\tsep\tcells\n" * 5, "word " * 3000, "\u2028\u2003wide\u3000blanks ", "a" + " " * 300 + "b", "e\u0301 a\u0308", "fi\ufb01 ²³ ⅷ",
]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit("extra")).withColumn("piece", F.lit(1))


def test_counts_equal_whole_encoding(spark):
    rnd = random.Random(3)
    noise = ["".join(rnd.choices("ab 'sT\n\t1é,.\u00a0\x1f漢", k=60)) for _ in range(300)]
    encode = tokens.counter().encoding.encode_ordinary
    want = {i: len(encode(t)) if t else 0 for i, t in enumerate(TEXTS + noise)}
    got = tokens.token_counts(docs(spark, TEXTS + noise).drop("tokens"), "text", ["doc_id"])
    assert {r.doc_id: r.tokens for r in got.collect()} == want
    assert tokens.token_counts(docs(spark, []).drop("tokens"), "text", ["doc_id"]).count() == 0


def corpus(n, seed=5):
    rnd = random.Random(seed)
    topics = [[f"{t}{i}" for i in range(40)] for t in ("alpha", "beta", "gamma", "delta")]
    return [" ".join(rnd.choices(topics[i % 4] + ["the", "of", "and"], k=int(rnd.lognormvariate(3.5, 1)))) for i in range(n)]


@pytest.mark.parametrize("shard", [packing.SHARD, 50])
def test_packing_places_everything_once(spark, shard):
    texts = [*TEXTS, *corpus(500)]
    packs = [("small", 64), ("large", 700), ("tiny", 1)]
    df = docs(spark, texts).drop("tokens", "piece").repartition(3)
    got = packing.packing(df, "text", ["doc_id"], packs, shard=shard).collect()
    size = {r.doc_id: r.tokens for r in tokens.token_counts(df, "text", ["doc_id"]).collect()}
    for name, capacity in packs:
        mine = [r for r in got if r.pack_name == name]
        load, pieces = Counter(), {}
        for r in mine:
            if r.container is not None:
                load[r.container] += r.tokens
            pieces.setdefault(r.doc_id, []).append((r.first_token, r.tokens, r.piece))
        assert max(load.values()) <= capacity
        assert pieces.keys() == size.keys()
        for d, p in pieces.items():
            p.sort()
            assert [x[0] for x in p] == [sum(y[1] for y in p[:i]) for i in range(len(p))] and sum(x[1] for x in p) == size[d]
            assert len(p) == max(1, math.ceil(size[d] / capacity)), "only texts longer than the capacity are split"
        if name != "large" or shard == packing.SHARD:
            assert sum(load.values()) / (len(load) * capacity) > 0.85
    with pytest.raises(ValueError):
        packing.packing(df, "text", ["doc_id"], [("none", 0)])
    assert packing.packing(df.limit(0), "text", ["doc_id"], packs).count() == 0


def test_packing_needs_few_containers():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 400, 2000)
    index = packing.Index([Counter({f"t{i % 50}": 1}) for i in range(2000)])
    got = packing.pack(sizes, 1000, index)
    assert sorted(i for c in got for i, _ in c) == list(range(2000))
    assert len(got) <= 1.02 * math.ceil(sizes.sum() / 1000)


def test_bm25_against_brute_force():
    bags = [Counter(t.split()) for t in corpus(80)]
    index = packing.Index(bags)
    n, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    for seed in (0, 7, 33):
        asked = [t for t in bags[seed] if df[t] > 1]
        want = [sum(idf[t] * b[t] * (packing.K1 + 1) / (b[t] + packing.K1 * (1 - packing.B + packing.B * sum(b.values()) / mean)) for t in asked if t in b) for b in bags]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)


def test_neighbours_share_containers():
    texts = corpus(400)
    bags = [Counter(t.split()) for t in texts]
    sizes = np.array([min(300, max(1, len(t.split()))) for t in texts])
    same = total = 0
    for c in packing.pack(sizes, 300, packing.Index(bags)):
        for a, _ in c[1:]:
            same += a % 4 == c[0][0] % 4
            total += 1
    assert same / total > 0.4, "a quarter would be chance"


def sized(spark, n=3000):
    rnd = random.Random(8)
    data = [(i, rnd.choices(["big", "mid", "tiny", None, "untargeted"], [60, 30, 1, 3, 6])[0], rnd.choice([0, 1, 50, 300, None])) for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id long, source string, tokens long").withColumn("before", F.lit(0)).withColumn("budget", F.lit("x"))


TARGETS = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.1, 4), ("m", "nowhere", 0.1, 3), ("n", "tiny", 0.5, 1), ("n", "mid", 0.25, 1), ("n", "mid", 0.25, 3), ("o", "big", None, 2), ("o", "mid", 1.0, None)]


def test_mix_reaches_its_shares(spark):
    data, df = sized(spark)
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets)
    of = {d: (s, t) for d, s, t in data}
    used, seen = {}, set()
    for r in got.collect():
        assert of[r.doc_id] == (r.source, r.tokens) and (r.mix_name, r.doc_id) not in seen
        seen.add((r.mix_name, r.doc_id))
        used.setdefault(r.mix_name, Counter())[r.source] += r.uses * r.tokens
        assert r.uses <= {"big": 1, "mid": 3 if r.mix_name == "n" else 2, "tiny": 4 if r.mix_name == "m" else 1}[r.source]
    assert used.keys() == {"m", "n"}
    total = sum(used["m"].values())
    # The missing source's share goes to the others; each misses its budget by half a document at most.
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(used["m"][s] - total * share / 0.9) <= 301
    assert abs(used["n"]["mid"] - used["n"]["tiny"]) <= 301
    report = {(r.mix_name, r.source): r for r in mixing.shares(got, df, targets).collect()}
    assert report["m", "nowhere"].share == 0 and report["m", "tiny"].tokens == used["m"]["tiny"] and abs(report["m", "big"].share - 0.5 / 0.9) < 0.02
    assert len(report) == 8
    again = mixing.mix(df.repartition(7), targets)
    assert rows(again) == rows(got), "the same documents, however the rows are spread"


def test_mix_with_a_given_total_and_epochs(spark):
    df = spark.createDataFrame([(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(100)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.9, 2), ("m", "b", 0.1, 9)], "mix_name string, source string, target_share double, max_repeats int")
    got = {r.source: (r.n, r.t) for r in mixing.mix(df, targets, total_tokens=2000).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("uses") * F.col("tokens")).alias("t")).collect()}
    assert got == {"a": (100, 1800), "b": (20, 200)}
    capped = {r.source: r.tokens for r in mixing.shares(mixing.mix(df, targets, total_tokens=10_000), df, targets, 10_000).collect()}
    assert capped == {"a": 2000, "b": 1000}
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def test_prefix_sums_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 40)
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", i % 17) for i in range(900)], "doc_id long, source string, tokens long")
    got = mixing.prefix_sums(df, "source", "doc_id", "tokens").collect()
    for s in ("hot", "cold"):
        mine = sorted((r.before, r.before + r.tokens) for r in got if r.source == s)
        end = 0
        for a, b in mine:
            assert a == end
            end = b
        assert end == sum(t % 17 for t in range(900) if ("hot" if t % 3 else "cold") == s)


def share(*texts):
    inside, every = quality.prose_chars(pa.array(texts))
    return float(inside[-1] / max(every[-1], 1))


@pytest.mark.parametrize(("text", "prose"), [
    (PROSE, True),
    ("commit 50f352ea0c7e1c3404429efd8fdcb76f278ea96b\nAuthor: A B <a@b.example>\nDate:   Sat Jan 4 13:28:47 2025 +0100\n\n    cleanup\n\n    " + PROSE, True),
    ("> " + PROSE[:60] + "\n> " + PROSE[60:], True),
    ("Wir haben lange gesucht, weil der Zähler in der Nacht nichts gemeldet hat. Niemand hatte damit gerechnet, dass er das Schema kennt.", True),
    ("Personne ne pensait que la sortie pouvait demander une page vide une seconde fois, et cela reste surprenant.", True),
    ("NADIE PENSABA QUE LA COLA PUDIERA PEDIR UN ARCHIVO A MEDIAS OTRA VEZ, Y ESO ERA SORPRENDENTE.", True),
    ("TODO\n- " + PROSE + "\n- " + PROSE, False),
    ("1. " + PROSE + "\n2) " + PROSE, False),
    ("- " + PROSE[:70] + "\n  " + PROSE[70:], False),
    ("diff --git a/x b/x\nindex f175d2f..c55f512 100644\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n+" + PROSE + "\n " + PROSE, False),
    ("| a | b |\n|---|---|\n| " + PROSE + " | 2 |", False),
    ("name,runs,p50,comment\nlu_mir,61,4.06,\"wip\"\nwen_mir,67,3.87,\"handle null keys\"", False),
    ("Buffer cached budget step dropped key!\nKey dropped parser limit lamvik queue. Row column header kahal parser.", False),
    ("wip", False),
    ("Merge branch 'x' into y\n# Conflicts:\n#\tsrc/a.cpp\n#\tsrc/b.cpp", False),
    ("c220aecb fix(queue): handle the timeouts\n3a460cb4 test(ledger): tests for the http", False),
    ("test test test test test test test test test test\n=====", False),
    ("QmFzZTY0IGlzIG5vdCBwcm9zZSBhbmQgbmV2ZXIgd2lsbCBiZSBvbmU=" * 8, False),
    ("def f(a):\n    return a.b(c)\nfor x in y:\n    print(x)", False),
    ("", False),
    (None, False),
])
def test_prose(text, prose):
    assert (share(text or "") > 0.5) == prose


def test_statistics_and_reasons(spark):
    got = {r.doc_id: r for r in quality.quality(docs(spark, [PROSE * 3, "# a ... b …", None, "- x\n- y\n* z", "", PROSE * 3]), "text", ["doc_id"]).collect()}
    assert got[0].reasons == [] and got[0].n_words == len((PROSE * 3).split()) and got[0] [1:] == got[5][1:]
    assert got[1].symbol_ratio == 3 / 5 and "symbols" in got[1].reasons
    assert "no_text" in got[2].reasons and got[2].n_words == 0 and got[4].reasons == got[2].reasons
    assert got[3].bullet_lines == 1 and "bullets" in got[3].reasons and "too_few_words" in got[3].reasons
    assert quality.quality(docs(spark, []), "text", ["doc_id"]).count() == 0


def test_very_long_text():
    assert share(PROSE * 5000) > 0.9 and share("x" * 2_000_000) == 0
    # Neighbours in a batch make no difference.
    assert share("diff --git a b\n+x", "- entry", PROSE) == share(PROSE) and share(PROSE, "  " + PROSE[:8]) == 0


def test_queries_over_whole_tables(spark, small):
    from millrace.llm.queries import QUERIES

    for name, q in QUERIES.items():
        assert q(spark, small).count() > 0, name


def test_a_seed_asks_for_all_its_terms():
    rare = [f"rare{i}" for i in range(30)]
    bags = [Counter([*rare, "often"]), *[Counter([r]) for r in rare], *[Counter(["often"])] * 40, Counter(["other"])]
    scores = packing.Index(bags).scores(0)
    assert (scores[:-1] > 0).all() and scores[-1] == 0


def test_neighbours_come_before_any_other_text():
    # 60 related texts of one token, 20 unrelated of two: the seed's container has room for the related ones only.
    bags = [Counter(["a", "b"]), *[Counter(["a"])] * 60, *[Counter([f"x{i}"]) for i in range(20)]]
    first = packing.pack(np.array([40, *[1] * 60, *[2] * 20]), 100, packing.Index(bags))[0]
    assert sorted(i for i, _ in first) == list(range(61)) and [how for _, how in first] == [packing.SEED] + [packing.NEIGHBOUR] * 60


def test_prose_is_found_among_all_statistics(spark, small):
    from millrace.llm.queries import p8_found, p8_quality

    found = p8_found(spark, small)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(f in plan for f in quality.FIELDS) and all(rule[0] in plan for rule in quality.RULES)
    assert rows(found) == rows(p8_quality(spark, small).where("prose_share > 0.5").select("doc_id"))


def test_recall_of_neighbours_on_whole_documents(spark, small):
    """All neighbours of seeds whose id is divisible by 50, over a whole shard of real texts, against BM25 term by term."""
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    bags = [Counter(tokens.counter().chunks(t)) for t in texts]
    index, n = packing.Index(bags), len(bags)
    mean, df = sum(sum(b.values()) for b in bags) / n, Counter(t for b in bags for t in b)
    free = np.arange(n) % 3 > 0
    postings = index.without(free, index.postings)
    for seed in range(0, n, 50):
        want = np.zeros(n)
        for i, b in enumerate(bags):
            norm = packing.K1 * (1 - packing.B + packing.B * sum(b.values()) / mean)
            want[i] = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * (packing.K1 + 1) / (b[t] + norm) for t in bags[seed] if t in b)
        got = index.scores(seed)
        assert np.allclose(got, want, rtol=1e-3, atol=1e-4) and np.allclose(index.scores(seed, postings)[free], want[free], rtol=1e-3, atol=1e-4)
        top = lambda x: set(np.argsort(-x, kind="stable")[:24].tolist())
        assert len(top(got) & top(want)) >= 0.9 * 24


def test_queries_with_sql(spark, small):
    from compare import same
    from millrace.llm.queries import QUERIES, SQL

    for name, sql in SQL.items():
        ok, why = same(QUERIES[name](spark, small), sql, small)
        assert ok, (name, why)
