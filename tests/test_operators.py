import datetime as dt

from pyspark.sql import functions as F

from guestlens.functions import text as tx
from guestlens.operators import dashboard as db
from guestlens.operators import relational as rel
from guestlens.operators import retrieval as rt
from guestlens.operators import stateful as st


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_keep_first_ties_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, None), ("b", 1, "q"), ("b", 1, "q")], "k string, o int, __row string")
    out = rel.keep_first(df.withColumnRenamed("__row", "v"), ["k"], ["o"])
    assert sorted(((r.k or ""), r.o, r.v) for r in out.collect()) == [("", 4, None), ("a", 1, "y"), ("b", 1, "q")]
    assert rel.keep_first(df.limit(0).withColumnRenamed("__row", "v"), ["k"], ["o"]).count() == 0


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", None)], "k string, o int")
    assert rows(rel.keep_last(df, ["k"], ["o"]).fillna(-1), "k", "o") == [("a", 3), ("b", -1)]


def test_upserts(spark):
    a, b = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert rows(rel.insert_ignore(a, b, ["k"]), "k", "v") == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(rel.upsert(a, b, ["k"]), "k", "v") == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(rel.audit_diff(a, b, "k", ["v"]), "k", "action") == [("a", "DELETE"), ("b", "UPDATE"), ("c", "CREATE")]


def test_most_common_breaks_ties_by_first_occurrence(spark):
    df = spark.createDataFrame([("x", 3), ("y", 1), ("x", 4), ("y", 2), ("z", 0), (None, 9)], "w string, p int")
    assert [r.w for r in rel.most_common(df, "w", ["p"], 2).collect()] == ["y", "x"]


def test_round_robin_and_numbering(spark):
    items = spark.range(10).select(F.col("id").cast("string").alias("i"))
    workers = spark.createDataFrame([("u2",), ("u1",), ("u3",)], "w string")
    out = {r.i: r.w for r in rel.round_robin(items, ["i"], workers, "w").collect()}
    assert out["0"] == "u1" and out["1"] == "u2" and out["2"] == "u3" and out["3"] == "u1" and len(out) == 10
    assert rel.round_robin(items, ["i"], workers.limit(0), "w").count() == 0


def test_classification_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    got = {r.label: (r.tp, r.fp, r.fn) for r in rel.classification_report(df, "t", "p").collect()}
    assert got == {"a": (1, 1, 1), "b": (1, 1, 0), "c": (0, 0, 1)}


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [round(r[0], 3) for r in df.select(rel.set_jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.333]


def test_islands(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabbba")], "g int, o int, k string")
    assert [r.island for r in rel.islands(df, ["g"], ["o"], ["k"]).orderBy("o").collect()] == [1, 1, 2, 2, 2, 3]


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([(1, "d")], "hotel_id int, department string")
    seen = lambda *a: db.optional(df, p=db.scope(*a)[0]).count()
    assert seen("SuperAdmin") == 1 and seen("HotelAdmin", 1) == 1 and seen("HotelAdmin", 2) == 0 and seen("HotelAdmin") == 0 and seen("whoever", 1) == 0


def test_bucket_edges(spark):
    df = spark.createDataFrame([(3, 4), (-3, 4), (4, 5), (None, None), (1, 1)], "s int, n int")
    assert [r[0] for r in df.select(db.bucket(F.col("s"), F.col("n"))).collect()] == ["Neutral", "Neutral", "Positive", None, "Positive"]


def test_gaps_are_zero_counts_and_null_averages(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2024, 1, 1), 2, 9), (d(2024, 1, 4), 1, 2)], "day date, reviews long, rating_sum long")
    out = db.moving_average(db.dense_days(df)).orderBy("day").collect()
    assert [(r.reviews, r.average, r.average_7d) for r in out] == [(2, 4.5, 4.5), (0, None, 4.5), (0, None, 4.5), (1, 2.0, 3.67)]


def test_day_counts_add_up(spark, sf):
    from guestlens.plans.dashboard import agg_daily_review_stats

    r = agg_daily_review_stats(spark, sf).collect()
    assert r and all(x.positive + x.negative + x.neutral + x.unanalysed == x.reviews for x in r)


def test_text_functions(spark):
    df = spark.createDataFrame([("IŞIK İyi  çoooook",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.normalize(F.col("t"))).collect()] == ["ışık iyi çook", "", None]
    assert [r[0] for r in df.select(tx.fold(F.col("t"))).collect()][:2] == ["ISIK Iyi  coooook", ""]
    one = spark.createDataFrame([("a b c",), ("a",), ("",)], "t string")
    assert [r[0] for r in one.select(tx.word_ngrams(F.split("t", " "), 2)).collect()] == [["a b", "b c"], [], []]
    assert [r[0] for r in one.select(tx.char_ngrams(F.col("t"))).collect()] == [["a b", " b ", "b c"], [], []]
    r = spark.createDataFrame([("4,5",), ("abc",), ("",), (None,), ("9",), ("2.5",)], "t string")
    assert [x[0] for x in r.select(tx.rating_int(F.col("t"))).collect()] == [4, 3, 3, 3, 5, 2]
    assert [x[0] for x in r.select(tx.rating_half_up(F.col("t"))).collect()] == [5, None, None, None, 5, 3]


def test_issue_states_use_event_time(spark):
    t = dt.datetime
    df = spark.createDataFrame([("k", t(2024, 1, 3), 3, "resolve"), ("k", t(2024, 1, 1), 1, "report"), ("k", t(2024, 1, 2), 2, "report"), ("j", t(2024, 1, 1), 4, "report")], "k string, at timestamp, event_id long, kind string")
    assert rows(st.issue_states(df, ["k"], "at", F.col("kind")), "k", "reports", "status") == [("j", 1, "open"), ("k", 2, "resolved")]


def test_retry_states(spark):
    t = dt.datetime
    df = spark.createDataFrame([(1, t(2024, 1, i), i, i == 3) for i in (1, 2, 3)] + [(2, t(2024, 1, i), i, False) for i in (1, 2, 3)] + [(3, t(2024, 1, 1), 1, False)], "job_id long, at timestamp, attempt_id long, ok boolean")
    assert rows(st.retried(df), "job_id", "failures", "status") == [(1, 2, "Completed"), (2, 3, "Failed"), (3, 1, "Pending")]


def test_nearest_is_exact(spark):
    import numpy as np

    r = np.random.default_rng(0).normal(size=(60, 8)).astype("float32")
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(r)], "k long, e array<float>")
    q = v.where("k % 20 = 0").select(F.col("k").alias("q"), "e")
    got = {}
    for x in rt.nearest(v, q, "k", "q", "e", 3, block=2).orderBy("q", "rank").collect():
        got.setdefault(x.q, []).append(x.k)
    for i in (0, 20, 40):
        s = r @ r[i]
        s[i] = -9e9
        assert got[i] == list(np.argsort(-s)[:3])


def test_streaming_equals_batch(spark, sf):
    from guestlens.registry import core

    a, b = core.queries["st_stream_trend"](spark, sf), core.queries["st_trend_counters"](spark, sf)
    assert rows(a, "key", "day", "n") == rows(b, "key", "day", "n")


def test_readers(spark, tmp_path):
    from guestlens.sources import readers

    p = tmp_path / "a.csv"
    p.write_text('﻿Kullanıcı Adı;Yorum Metni;Puan\nAda;"çok; iyi\nyer";4,5\n', encoding="utf-8")
    r = readers.with_aliases(readers.read_delimited(spark, str(p))).collect()
    assert [(x.guest_name, x.comment, x.rating, x.source) for x in r] == [("Ada", "çok; iyi\nyer", "4,5", "")]
    html = spark.createDataFrame([(1, '<script type="application/ld+json">{"review":[{"reviewBody":"good","reviewRating":{"ratingValue":"4"}}]}</script>'), (2, "<p>none</p>")], "k int, h string")
    assert [(x.k, x.comment, x.rating) for x in readers.json_ld_reviews(html, "k", "h").collect()] == [(1, "good", 4.0)]
    assert html.select(readers.page_text(F.col("h"))).collect()[1][0] == "none"


def test_entry_point(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_similarity_join_is_exact(spark):
    import random

    from guestlens.operators import similarity as sim

    r = random.Random(4)
    base = [" ".join(r.choices("abcdefghij", k=30)) for _ in range(25)]
    texts = base + [" ".join(t.split()[:-1] + ["z"]) for t in base] + base[:5] + ["", None, "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {x.id: (x.class_id, x.n_links) for x in sim.links(df, "id", "t").collect()}
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(max(len(t.split()) - 4, 1))} for i, t in enumerate(texts) if t}
    first = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(t, i)
    reps = sorted(set(first.values()))
    for i, t in enumerate(texts):
        if t:
            c = first[t]
            n = sum(1 for j in reps if j != c and len(shingles[c] & shingles[j]) / len(shingles[c] | shingles[j]) >= 0.8)
            assert got[i] == (c, n)
    assert len(got) == len(texts) - 2


def test_dedupe_hash_and_collapse_over_all_scripts(spark, tmp_path):
    import hashlib
    import re

    from guestlens.plans import relational, text

    comments = ["Great stay", " great STAY\n", "Çok güzel, ŞİRİN otel", "çok güzel, ŞİRİN otel ", "\u00a0Отель хороший", "ОТЕЛЬ ХОРОШИЙ\u3000", "Straße", "STRASSE", "ΟΔΟΣ", "很好", "", None, "a\nb"]
    spark.createDataFrame(list(enumerate(comments)), "row_id long, comment string").write.parquet(f"{tmp_path}/scraped_reviews.parquet")
    expected = {}
    for i, c in enumerate(comments):
        if c:
            expected.setdefault(hashlib.sha256(c.strip().lower().encode()).hexdigest()[:16], i)
    assert {r.hash: r.row_id for r in relational.set_dedupe_hash_all(spark, str(tmp_path)).collect()} == expected

    texts = ["çoook güzeeeel!!!!!", "xxxxx zzzz", "Ураааааа", "a\n\n\n\n\nb", "ıııı üüü", "plain", "😀😀😀😀😀", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    collapsed = [t if t is None else re.sub(r"([aeiouüöıâAEIOUÜÖİ])\1{2,}", r"\1", re.sub(r"(.)\1{3,}", r"\1\1", t)) for t in texts]
    got = {r.doc_id: (r.text, r.n) for r in text.txt_collapse_repeat_all(spark, str(tmp_path)).collect()}
    assert got == {i: (t, t if t is None else len(t)) for i, t in enumerate(collapsed)}


def test_queries_can_be_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_nearest_rows_against_brute_force(spark, monkeypatch):
    import numpy as np

    from guestlens.operators import retrieval as rt

    monkeypatch.setattr(rt, "QUERY_BLOCK", 3)  # several blocks
    r = np.random.default_rng(2)
    v = r.integers(-2, 3, (60, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, vec array<double>").repartition(5)
    got = {(x.q, x.rank): x.id for x in rt.nearest(df, df.where("id % 7 = 0").select(F.col("id").alias("q"), "vec"), "id", "q", "vec", 3).collect()}
    expected = {}
    for q in range(0, 60, 7):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-float(v[q] @ v[i]), i))
        expected |= {(q, k + 1): order[k] for k in range(3)}
    assert got == expected

    terms = [(i, f"t{j}", float(w)) for i, row in enumerate(r.integers(0, 3, (40, 6))) for j, w in enumerate(row) if w] + [(i, "hot", 1.0) for i in range(40)]
    w = spark.createDataFrame(terms, "id long, term string, w double").repartition(4)
    out = {(x.q, x.rank): x.id for x in rt.cosine_nearest(w, w.where("id % 9 = 0").withColumnRenamed("id", "q"), "id", "q", 4).collect()}
    rows = {}
    for i, t, x in terms:
        rows.setdefault(i, {})[t] = x
    for q in range(0, 40, 9):
        order = sorted((i for i in rows if i != q), key=lambda i: (-sum(x * rows[q].get(t, 0) for t, x in rows[i].items()), i))
        assert [out[q, k + 1] for k in range(4)] == order[:4]
    assert rt.nearest(df, df.limit(0).select(F.col("id").alias("q"), "vec"), "id", "q", "vec", 3).count() == 0


def test_order_within_keys_over_many_stretches(spark):
    import random

    from guestlens.operators import ordered as od

    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i // 3, i, r.choice(["x", "y", None])) for i in range(400)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, i int, v string").repartition(6)
    keys, order = ["k"], ["t", "i"]
    by_key = {}
    for k, t, i, v in sorted(rows, key=lambda x: (x[1], x[2])):
        by_key.setdefault(k, []).append((i, v))
    n, carried, island = {}, {}, {}
    for k, xs in by_key.items():
        last, run, before = None, 0, object()
        for j, (i, v) in enumerate(xs):
            n[i], carried[i] = (j + 1, len(xs)), last
            last = v if v is not None else last
            run += v != before
            island[i], before = run, v
    assert {x.i: (x.n, x.total) for x in od.positions(df, keys, order).collect()} == n
    assert {x.i: x.c for x in od.carried(df, keys, order, F.col("v"), "c").collect()} == carried
    assert {x.i: x.island for x in od.islands(df, keys, order, ["v"]).collect()} == island
    assert od.positions(df.limit(0), keys, order).count() == 0
