import os
import random

import pytest
from pyspark.sql import functions as F

from guestlens import session
from guestlens.plans import lexicon
from guestlens.sources import contents

ROWS = [("a1", "Good, really; \"very\" good", 5), ("a2", "Zeile & <b>Tag</b> çğış 早餐", 3), ("a3", None, None)]


@pytest.mark.parametrize("kind", sorted(contents.ADAPTERS))
def test_every_format_round_trips_and_is_recognised(spark, kind):
    rows = [r for r in ROWS if kind != "paste" or r[1]]
    df = spark.createDataFrame(rows, "id string, comment string, rating int")
    files = contents.written(df, kind, "id")
    assert [contents.kind_of(bytes(r.content)) for r in files.collect()] == [kind]
    got = {r.review_id: (r.comment, r.rating) for r in contents.read(files).collect()}
    assert {k: v[0] or None for k, v in got.items()} == {r[0]: r[1] for r in rows}
    if kind in ("xlsx", "json", "sqlite", "csv"):
        assert float(got["a1"][1]) == 5 and not got["a3"][1]


def test_broken_empty_and_unknown_files_give_no_rows(spark):
    df = spark.createDataFrame([("a", bytearray(b"PK\x03\x04broken")), ("b", bytearray(b"")), ("c", bytearray(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1old")), ("d", None), ("e", bytearray(b"\xff\xfe\x00"))], "path string, content binary")
    assert contents.read(df).count() == 0 and contents.read(df.limit(0)).count() == 0


def test_large_tables_become_several_files(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("comment"))
    files = contents.written(df, "xlsx", "id", rows_per_file=300)
    assert files.count() == 4 and contents.read(files).count() == 1000


def test_cells_by_reference_and_shared_texts():
    assert [contents.column_no(r, 9) for r in ("A1", "Z2", "AB3", None)] == [0, 25, 27, 9]


def _edit_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        m = [i for i in range(len(a)) if a[i] != b[i]]
        return len(m) == 1 or len(m) == 2 and m[1] == m[0] + 1 and a[m[0]] == b[m[1]] and a[m[1]] == b[m[0]]
    x, y = (a, b) if len(a) > len(b) else (b, a)
    return any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def test_spelling_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    common = ["breakfast", "pillow", "reception", "elevator", "window"]
    rare = ["brekafast", "pilow", "recepton", "elevatorr", "windoww", "pillows", "garden", "bfeakfast"]
    text = [" ".join(r.sample(common, 5)) for _ in range(30)] + [" ".join(rare)]
    spark.createDataFrame([(str(i), t, 5) for i, t in enumerate(text)], "id string, comment string, rating int").write.parquet(f"{tmp_path}/reviews.parquet")
    got = {x.word: x.correction for x in lexicon.txt_spell_dl1(spark, str(tmp_path)).collect()}
    expected = {a: b for a in rare for b in common if _edit_one(a, b) and not (len(a) == len(b) + 1 and a.startswith(b))}
    assert got == expected and "pillows" not in got and got["brekafast"] == "breakfast"


def test_fuzzy_duplicates_keep_the_more_helpful(spark, tmp_path):
    r = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    near = base[:]
    near[59] = "other"
    far = [f"v{r.randrange(999)}" for _ in range(40)]
    rows = [(1, " ".join(base), 2), (2, " ".join(near), 5), (3, " ".join(base), 1), (4, " ".join(far), None), (5, None, 9), (6, "", 9)]
    spark.createDataFrame(rows, "row_id long, comment string, helpful_count int").write.parquet(f"{tmp_path}/scraped_reviews.parquet")
    assert {x.row_id for x in lexicon.set_dedupe_fuzzy(spark, str(tmp_path)).collect()} == {2, 4}


def test_fuzzy_duplicates_write_less_than_their_shingles(spark, tmp_path):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = [r.choices(words, k=r.randint(1, 120)) for _ in range(300)]
    for i in range(200):  # copies with one to four words changed: on both sides of the threshold
        t = texts[r.randrange(300)][:]
        for _ in range(r.randint(1, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(t)
    rows = [(i, " ".join(t), r.choice([None, 0, 1, 2])) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "row_id long, comment string, helpful_count int").write.parquet(f"{tmp_path}/scraped_reviews.parquet")
    before = len(session.SCRATCH)
    got = {x.row_id for x in lexicon.set_dedupe_fuzzy(spark, str(tmp_path)).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} for t in texts]
    rank = lambda i: (-(rows[i][2] or 0), i)
    best = {}
    for i, t in enumerate(texts):
        j = best.setdefault(tuple(t), i)
        best[tuple(t)] = min(i, j, key=rank)
    kept = sorted(best.values())
    similar = [(i, j) for i in kept for j in kept if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert got == set(kept) - {max(p, key=rank) for p in similar} and len(similar) > 40
    written = sum(os.path.getsize(os.path.join(d, f)) for p in session.SCRATCH[before:] for d, _, fs in os.walk(p.removeprefix("file://")) for f in fs if f.endswith(".parquet"))
    assert written < 8 * sum(map(len, sets))  # a hash of 64 bits a shingle
