"""Cases of the fourth review: each would have failed before."""

from ledgerlake.operators import detection


def test_digits_of_a_key_are_no_phone_number(spark):
    from pyspark.sql import functions as F

    texts = {
        'token = "d86c0ce189810138704e1d510ec509fb1e905fd2"': [], "password=89473500287e1348aa and": [], "phone list: f84279122880a": [], "password=a0f854291 17162": [],
        "mob89473500287, tel84951234567": ["89473500287", "84951234567"], "моб89473500287доб": ["89473500287"], "89473500287ext 4": ["89473500287"],
        "f8 (947) 350-02-87": ["8 (947) 350-02-87"], "password=89473500287": ["89473500287"],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", detection.found_in(F.col("t"), "phone").alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == texts


def test_numbers_beyond_a_part_are_joined(spark):
    """A join finds what a book finds, with one pass over the texts however many numbers there are."""
    import random

    from ledgerlake.operators import known, masking
    from ledgerlake.operators import textsearch as ts

    rng = random.Random(7)
    digits = lambda n: "".join(rng.choice("0123") for _ in range(n))
    pool = [(kind, f"[[{kind}:{k}]]", digits(rng.choice([3, 4, 6, 6, 10, 12]))) for k in range(200) for kind in ("doc", "inn")]
    numbers = spark.createDataFrame(pool, "kind string, token string, digits string")
    parts = [*(d for _, _, d in pool), *(digits(n) for n in (1, 2, 4, 6)), "паспорт", "Юг", "Альфа", "[[inn:770]]", "00000000-0000-0000-0000-000000000123"]
    say = lambda: "".join(rng.choice(parts) + rng.choice(["", " ", "-", "\\n", " a ", ".", "/", "  "]) for _ in range(rng.randint(0, 12)))
    rows = spark.createDataFrame([*((k, say()) for k in range(400)), (400, None), (401, "")], "k int, text string")
    book, joined = ts.books(numbers=numbers), ts.books(numbers=numbers, most=10)
    assert [type(b) for b in joined] == [ts.Numbers]
    found = [sorted(map(tuple, ts.finds(rows, "k", "text", x).collect())) for x in (book, joined)]
    assert len(found[0]) > 1000 and found[0] == found[1]
    masked = known.mask_known_numbers(rows, "k", "text", numbers, 10)
    assert sorted(map(tuple, masked.collect())) == sorted(map(tuple, known.mask_known_numbers(rows, "k", "text", numbers).collect()))
    assert masked._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    names = spark.createDataFrame([("юг", "[[org:A]]"), ("альфа", "[[org:B]]")], "spelling string, token string")
    both = [sorted(map(tuple, masking.rewrite_strings(rows, {}, None, ts.books(names, numbers, most=most)).collect())) for most in (1000, 10)]
    assert both[0] == both[1] and any("[[org:B]]" in (t or "") and "[[inn:" in t for _, t in both[0] if t)
