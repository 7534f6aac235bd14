from arrayloom.operators.packed import CANDIDATES, infer_delimiters, split_packed

KIND = "event_id long, source string, sensors string, pos string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], KIND)
    return sorted(map(tuple, split_packed(df, "event_id", "sensors", ["source"], ("a", "b")).collect()))


def spell(items, style):
    """items: pairs or None for an item with nothing in it."""
    def put(form, empty=""):
        return [form.format(*i) if i else empty for i in items]

    return {
        "tight": lambda: "".join(put("({},{})", "()")),
        "spaced": lambda: " ".join(put("({}, {})", "()")),
        "semicolon": lambda: ";".join(put("{},{}")),
        "bar": lambda: "|".join(put("{}:{}")),
        "quoted": lambda: ",".join(f'"{x}"' for x in put("({},{})")),
        "csv": lambda: '"' + " ".join(f'""{x}""' for x in put("{},{}")) + '"',
        "brackets": lambda: ", ".join(put("[{},{}]", "[]")),
        "apostrophe": lambda: "".join(f"'{x}';" for x in put("{},{}")),
        "letters": lambda: ",".join(put("C{}R{}")),
        "inner": lambda: ",".join(put("({};{})", "()")),
        "tab": lambda: "\t".join(put("({:03d},{:03d})", "()")),
        "decimal": lambda: "".join(put("({}.0,{}.0)", "()")),
        "counted": lambda: f"n={len(items)} " + "".join(put("({},{})", "()")),
    }[style]()


STYLES = "tight spaced semicolon bar quoted csv brackets apostrophe letters inner tab decimal counted".split()


def test_writers_of_one_source(spark):
    rows, want, n = [], [], 0
    for style in STYLES:
        for size in (1, 2, 3, 5, 2, 4):
            for hole in (None, 0, 1) if style not in ("spaced",) else (None,):
                items = [(n % 97 + k, k + 3) for k in range(size)]
                if hole is not None and hole < size - 1:
                    items[hole] = None
                n += 1
                rows.append((n, "one", spell(items, style)))
                want += [(n, k + 1, *i) for k, i in enumerate(items) if i]
    for size in (1, 2, 4):
        n += 1
        rows.append((n, "one", ",".join(f"{k},{k + 1}" for k in range(size))))
        want += [(n, k + 1, k, k + 1) for k in range(size)]
        n += 1
        rows.append((n, "one", "  ".join(f"{k}/{k + 1}" for k in range(size))))
        want += [(n, k + 1, k, k + 1) for k in range(size)]
    assert run(spark, rows) == sorted(want)


def test_nothing_in_it(spark):
    rows = [(1, "s", None), (2, "s", ""), (3, "s", "0"), (4, "s", "  "), (5, None, "(1,2)(3,4)"), (5, None, "(1,2)(3,4)"), (6, "s", "()"), (None, "s", "(7,8)")]
    got = run(spark, [r for r in rows if r[0] is not None])
    assert got == [(5, 1, 1, 2), (5, 2, 3, 4)]
    assert run(spark, []) == []
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND)
    assert (None, 1, 7, 8) in [tuple(r) for r in split_packed(df, "event_id", "sensors", ["source"], ("a", "b")).collect()]


def test_long_string(spark):
    items = [(k % 200, k % 90) for k in range(20_000)]
    assert len(run(spark, [(1, "s", spell(items, "tight")), (2, "s", spell(items[:3], "quoted"))])) == 20_003


def test_inference_names(spark):
    df = spark.createDataFrame([(1, "a", "1:2|3:4", ""), (2, "a", "5:6", ""), (3, "b", "1,2,3,4", "")], KIND)
    names = {r.source: CANDIDATES[r.delimiter][0] for r in infer_delimiters(df, "sensors", ["source"]).collect() if r.layout}
    assert names["b"] == "second_comma"
