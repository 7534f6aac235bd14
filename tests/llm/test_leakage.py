import random

from arrayloom.llm.leakage import leaks, words_of


def test_words():
    assert words_of("A<b\nc> <i>x</i>[q=1]y &amp;lt; &lt;p&gt; ﬁne ​so­ft_Z2") == ["a", "b", "c", "x", "y", "lt", "p", "fine", "soft", "z2"]


def brute(docs, items, least):
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for n, s in items:
            v = words_of(s or "")
            if any(tuple(v[i : i + least]) in grams for i in range(len(v) - least + 1)):
                out.add((d, n))
    return sorted(out)


def run(spark, docs, items, least=12):
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(n, t, "e") for n, t in items], "item_id int, text string, doc_id string")
    return sorted((r.doc_id, r.item_id) for r in leaks(a, "doc_id", b, "item_id", least=least).collect())


def test_every_long_span_is_found(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 40)))) for n in range(12)]
    docs = []
    for d in range(150):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 50))]
        source = rng.choice(items)[1].split()
        start, size = rng.randrange(len(source)), rng.choice([9, 11, 12, 13, 20])
        at = rng.randrange(len(own) + 1)
        docs.append((d, " ".join(own[:at] + source[start : start + size] + own[at:])))
    assert run(spark, docs, items) == brute(docs, items, 12)


def test_dirty(spark):
    long = " ".join(f"w{i}" for i in range(12))
    docs = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "x " * 30 + long.upper() + " y" * 20000)]
    assert run(spark, docs, [(1, long), (1, long), (2, None), (None, long), (3, "short")]) == [(3, 1), (4, 1)]
    assert run(spark, [], [(1, long)]) == [] and run(spark, docs, []) == []


def test_the_corpus_is_not_shuffled(spark, monkeypatch):
    """Only the word hashes of texts with a known fingerprint leave a task: no exchange holds a text."""
    from arrayloom.llm import leakage

    written = []
    keep = leakage.write_through
    monkeypatch.setattr(leakage, "write_through", lambda df: written.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    long = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(i, long if i % 50 == 0 else f"other words {i} " * 9) for i in range(200)], "doc_id long, text string")
    found = leaks(docs, "doc_id", spark.createDataFrame([(1, long)], "item_id int, text string"), "item_id")
    assert len(written) == 2 and not any("Exchange" in plan for plan in written)
    assert "text" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.longest) for r in found.collect()) == [(i, 15) for i in range(0, 200, 50)]
