import random

from arrayloom.llm.stuffing import language, stuffed_pages

HEAD = "the of and to in that it is was for on as with they be at by this had not are but from or have an which one".split()
TOPIC = [f"topic{i}" for i in range(300)]
KEYS = [f"key{i}" for i in range(60)]


def corpus():
    rng = random.Random(2)

    def prose(n):
        return " ".join(rng.choice(HEAD) if rng.random() < 0.5 else rng.choice(TOPIC) for _ in range(n))

    pages = [(i, prose(rng.randrange(25, 120)), rng.choice(["en", "EN", " en", "en-X", None])) for i in range(400)]
    stuffed = [
        ", ".join(rng.choice(KEYS) for _ in range(60)),
        " ".join(f"http://site{rng.randrange(99)}.example/{rng.choice(KEYS)}" for _ in range(40)),
        "".join(f'<li><a href="http://s.example/{i}">{rng.choice(KEYS)} {rng.choice(KEYS)}</a></li>' for i in range(30)),
        prose(12) + "\n" + " | ".join(rng.choice(KEYS) for _ in range(70)),
    ]
    many = [(1000 + i, stuffed[i % 4], "en") for i in range(40)]
    others = [(2000, "yes", "en"), (2001, "\n".join("\t".join(str(rng.randrange(900)) for _ in range(5)) for _ in range(30)), "en"),
              (2002, prose(70) + " " + ", ".join(rng.choice(KEYS) for _ in range(25)), "en"), (2003, None, "en"), (2004, "", None), (2005, "!?", "en"), (None, stuffed[0], "en")]
    return pages + many + many[:3] + others, [p[0] for p in many]


def test_found(spark):
    rows, want = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, word int")
    assert sorted(r.doc_id for r in stuffed_pages(df, "doc_id").collect()) == want
    assert stuffed_pages(df.limit(0), "doc_id").collect() == []


def test_language(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("EN",), (" fr",), ("de-X",), ("und",), (None,), ("",)], "l string")
    assert [r[0] for r in df.select(language(F.col("l"))).collect()] == ["en", "fr", "de", "xx", "xx", "xx"]


def test_scripts_without_spaces_and_wrong_labels(spark):
    """Signs count as words there; a page in another language than its label is no spam; one word over and over is."""
    rng = random.Random(5)
    kana, kanji = "のはをにがでとしてもれるからた", [chr(0x4E00 + 37 * i) for i in range(400)]

    def japanese(n):
        return "".join(rng.choice(kana) if rng.random() < 0.5 else rng.choice(kanji) for _ in range(n))

    def english(n):
        return " ".join(rng.choice(HEAD) if rng.random() < 0.5 else rng.choice(TOPIC) for _ in range(n))

    rows = [(i, japanese(rng.randrange(40, 150)), "ja") for i in range(120)] + [(200 + i, english(rng.randrange(30, 90)), "en") for i in range(120)]
    rows += [(1000 + i, "、".join(rng.choice(kanji[:6]) for _ in range(60)), "ja") for i in range(6)] + [(1010, "buy " * 80, "en"), (1011, "<a href='x'>" * 30, "en")]
    rows += [(2000, japanese(80), "en"), (2001, english(60), "ja"), (2002, english(60), "fi"), (2003, "no", "en"), (2004, "12 7\n3 4 " * 40, "en"), (2005, " ".join(f"z{i}" for i in range(5)), "en")]
    got = stuffed_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id").collect()
    assert sorted(r.doc_id for r in got) == [*range(1000, 1006), 1010, 1011]
    assert all(r.head_share < r.usual_share / 2 and r.divergence > 0 for r in got)
