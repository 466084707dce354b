import pytest
from pyspark.sql import functions as F

from guestlens.operators import clauses as cl
from guestlens.operators import opinions as op


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Oda çok temizdi ama klima 2.5 saat çalışmadı, personel ise ilgisizdi.", ["Oda çok temizdi", "klima 2.5 saat çalışmadı", "personel ise ilgisizdi."]),
        ("Hem yemekler lezzetliydi hem de havuz temizdi.", ["Hem yemekler lezzetliydi", "havuz temizdi."]),
        ("Havuz ve plaj çok güzeldi.", ["Havuz ve plaj çok güzeldi."]),
        ("Havuz kirliydi ve personel ilgisizdi.", ["Havuz kirliydi", "personel ilgisizdi."]),
        ("The porter said “No problem! It will be fixed.” yesterday", ["The porter said “No problem! It will be fixed.” yesterday"]),
        ("Saat 18.30'da 3. kattaki bar (küçük, loş) doluydu. Garsonlar geç geldi.", ["Saat 18.30'da 3. kattaki bar (küçük, loş) doluydu", "Garsonlar geç geldi"]),
        ("Yemek güzeldi. Ok. Oda temizdi.", ["Yemek güzeldi. Ok", "Oda temizdi"]),
        ("", []),
        ("   \n ", []),
        (None, []),
        ("Tel 12345", []),
    ],
)
def test_clauses(text, parts):
    assert [text[a:b].rstrip(".") for a, b in cl.clauses(text)] == [p.rstrip(".") for p in parts]


def test_clauses_are_ordered_pieces_of_the_text(spark):
    texts = ["Oda temizdi, ama klima bozuktu! Havuz doluydu.", "Room smelled. The lift was out of order and the pool was crowded", "x" * 5000, "a, " * 3000]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, clause_id string")
    rows = cl.with_clauses(df, "text").collect()
    for r in rows:
        assert texts[r.id][r.start_pos - 1 : r.start_pos - 1 + len(r.clause)] == r.clause and r.clause_id == "kept"
    assert {r.id for r in rows} >= {0, 1, 2}
    assert cl.with_clauses(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        cl.with_clauses(df.withColumn("clause", F.lit(1)), "text")


def test_a_change_of_topic_without_marks():
    k = cl.topic_cut("klima gerçekten hep bozuktu havuz ise çok doluydu", [])
    assert k is not None and cl.topic("klima bozuktu") != cl.topic("havuz doluydu")


def _brute_polarity(text):
    from guestlens.rulesets import hotel

    weights = {**hotel.POSITIVE, **{w: -x for w, x in hotel.NEGATIVE.items()}}
    words = [w for w in __import__("re").split(r"[^\w]+", cl.fold(text)) if w]
    total = 0.0
    for i, w in enumerate(words):
        x = weights.get(w, 0.0)
        before = words[max(0, i - 2) : i]
        if any(b in hotel.NEGATES_NEXT for b in before) or words[i + 1 : i + 2] and words[i + 1] in hotel.NEGATES_BEFORE:
            x *= op.NEGATED
        if before and before[-1] in hotel.STRENGTHENS:
            x *= op.STRENGTHENED
        total += x
    return round(total, 6)


def test_polarity_against_brute_force(spark):
    texts = ["The room was not good and very dirty", "Yemekler çok lezzetli, oda temiz değil", "never bad", "", "good good GOOD", "hiç iyi değildi", "Zimmer sehr sauber, nicht kalt"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "c string")
    got = [r.w for r in df.select(op.polarity(F.col("c"))["words"].alias("w")).collect()]
    assert got == [_brute_polarity(t) for t in texts] + [0.0]


def test_short_cues_are_words_and_traps_do_not_count(spark):
    df = spark.createDataFrame([("The pool.",), ("a carpool ride",), ("uplifting lift",), ("lifted",), (None,)], "c string")
    t = op.cue_text(F.col("c"))
    assert [(r.p, r.l) for r in df.select(op.cue(t, "pool").alias("p"), op.cue(t, "lift").alias("l")).collect()] == [(True, False), (False, False), (False, True), (False, False), (False, False)]


def test_clause_decisions_have_every_field(spark, tmp_path):
    from guestlens.plans.opinions import clause_decisions

    spark.createDataFrame([("r1", 2, "Asansör bozuktu ama yemekler çok lezzetliydi."), ("r2", 5, None)], "id string, rating int, comment string").write.parquet(f"{tmp_path}/reviews.parquet")
    rows = clause_decisions(spark, str(tmp_path), "reviews").orderBy("clause_no").collect()
    assert [(r.id, r.department, r.sentiment) for r in rows] == [("r1", "technical", "Negative"), ("r1", "food_beverage", "Positive")]
    assert len(rows[0]) == 18 and rows[0].severity == "high" and rows[0].root_cause == "maintenance" and rows[0].actionable
