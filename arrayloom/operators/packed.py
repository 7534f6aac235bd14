"""Fields that pack several values: infer the delimiter per source, split, one row per value.

A *layout* is the set of punctuation marks of a string. Rows of one source and layout come from one
writer. Candidates are scored on the digit-free shapes of the strings (every run of digits reads 9),
of which there are few, weighted with their row counts; so the score covers every row, and only
counts of shapes are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.session import write_through

#: Marks that tell layouts apart.
MARKS = ("(", "[", "{", '"', "'", ";", "|", "/", ":", "\t", " ", ",", "=")

_SEP = r"[\s,;|]"
_COUNT = r"^\s*[A-Za-z#]+\s*=\s*\d+\s*"


def _enclosed(s: Column, opening: str, closing: str) -> Column:
    inner = F.regexp_replace(s, rf"^[^{opening}]*{opening}|{closing}[^{opening}{closing}]*$", "")
    return F.split(inner, rf"{closing}{_SEP}*{opening}")


def _quoted(s: Column, quote: str) -> Column:
    doubled = quote * 3
    bare = F.when(
        s.startswith(doubled) & s.endswith(doubled),
        F.replace(F.expr("substring(packed, 2, length(packed) - 2)"), F.lit(quote * 2), F.lit(quote)),
    ).otherwise(s)
    inner = F.regexp_replace(bare, rf"^[^{quote}]*{quote}|{quote}[^{quote}]*$", "")
    return F.split(inner, rf"{quote}{_SEP}+{quote}")


def _plain(s: Column, regex: str) -> Column:
    return F.split(F.regexp_replace(s, _COUNT, ""), regex)


def _every_second(s: Column, mark: str) -> Column:
    bare = F.regexp_replace(s, _COUNT, "")
    # each match begins where the last one ended, so a long string without the mark is read once
    return F.split(F.regexp_replace(bare, rf"\G([^{mark}]*+{mark}[^{mark}]*+){mark}", "$1\u001f"), "\u001f")


#: Candidate delimiters in order of preference at equal scores; each splits the column `packed`.
CANDIDATES = (
    ("quote", lambda s: _quoted(s, '"')),
    ("apostrophe", lambda s: _quoted(s, "'")),
    ("parentheses", lambda s: _enclosed(s, r"\(", r"\)")),
    ("brackets", lambda s: _enclosed(s, r"\[", r"\]")),
    ("braces", lambda s: _enclosed(s, r"\{", r"\}")),
    ("semicolon", lambda s: _plain(s, ";")),
    ("bar", lambda s: _plain(s, r"\|")),
    ("tab", lambda s: _plain(s, "\t")),
    ("space", lambda s: _plain(F.trim(s), r"\s+")),
    ("comma", lambda s: _plain(s, ",")),
    ("slash", lambda s: _plain(s, "/")),
    ("colon", lambda s: _plain(s, ":")),
    ("second_comma", lambda s: _every_second(s, ",")),
    ("second_semicolon", lambda s: _every_second(s, ";")),
    ("second_bar", lambda s: _every_second(s, r"\|")),
)

_NUMBER = r"\d+(?:\.\d+)?"


def layout(s: Column) -> Column:
    """The marks of a string as a bit set; one more bit says whether it has letters."""
    marks = [*(s.contains(m) for m in MARKS), F.upper(s) != F.lower(s)]
    return reduce(lambda a, b: a + b, (F.when(has, 1 << i).otherwise(0) for i, has in enumerate(marks)))


def infer_delimiters(df: DataFrame, field: str, source: list[str], numbers: int = 2) -> DataFrame:
    """(source columns, layout, delimiter): the best candidate of each source and layout.

    Each candidate's score is the share of rows all of whose pieces are regular (count of numbers per piece always
    `numbers`, or nothing in it), times the share of regular pieces, times one and the share of rows whose number of
    pieces is consistent with the numbers in the whole string (a count at the front of it, which is no piece, left out).
    Ties go to more pieces, then to the order of CANDIDATES. Null and blank strings take no part.
    """
    s = F.col(field)
    shapes = (
        df.filter(s.isNotNull() & (F.trim(s) != ""))
        .groupBy(*source, F.regexp_replace(s, r"\d+", "9").alias("packed"))
        .agg(F.count("*").alias("rows"))
        .withColumn("layout", layout(F.col("packed")))
        .withColumn("bare", F.regexp_replace("packed", _COUNT, ""))
        .withColumn("called", F.size(F.regexp_extract_all("bare", F.lit(_NUMBER), F.lit(0))) / numbers)
    )

    tried = F.array(
        *[F.struct(F.lit(i).alias("delimiter"), split(F.col("packed")).alias("pieces")) for i, (_, split) in enumerate(CANDIDATES)]
    )
    kinds = (
        shapes.select(*source, "layout", "rows", "called", F.explode(tried).alias("c"))
        .select(
            *source, "layout", "rows", "called", "c.delimiter",
            F.transform("c.pieces", lambda p: F.size(F.regexp_extract_all(p, F.lit(_NUMBER), F.lit(0)))).alias("kinds"),
        )
        .select(
            *source, "layout", "rows", "delimiter", F.size("kinds").alias("pieces"),
            (F.size(F.filter("kinds", lambda k: k > 0)) == F.col("called")).alias("consistent"),
            F.size(F.filter("kinds", lambda k: (k == numbers) | (k == 0))).alias("regular"),
        )
    )
    sums = kinds.groupBy(*source, "layout", "delimiter").agg(
        (F.sum(F.when(F.col("regular") == F.col("pieces"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("whole"),
        (F.sum(F.col("regular") * F.col("rows")) / F.sum(F.col("pieces") * F.col("rows"))).alias("regular"),
        (F.sum(F.when(F.col("consistent"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("consistent"),
        F.sum(F.col("pieces") * F.col("rows")).alias("pieces"),
    )
    best = F.max(F.struct((F.col("whole") * F.col("regular") * (1 + F.col("consistent"))).alias("score"), "pieces", (-F.col("delimiter")).alias("order")))
    return sums.groupBy(*source, "layout").agg(best.alias("best")).select(*source, "layout", (-F.col("best.order")).alias("delimiter"))


def _pieces(df: DataFrame, key: str, field: str, source: list[str], carry: list[str], numbers: int) -> DataFrame:
    """(_key, carried columns, pieces): each distinct packed string of a key, split by its layout's delimiter; a piece is the
    array of its numbers. Writes the table of delimiters."""
    chosen = write_through(infer_delimiters(df, field, source, numbers))
    kept = [F.col(c).alias(f"_c_{c}") for c in carry]  # a carried column may be a source, too
    left = df.select(F.col(key).alias("_key"), *kept, *source, F.col(field).alias("packed")).filter(
        F.col("packed").isNotNull() & (F.length("packed") > 1)
    )
    left = left.withColumn("layout", layout(F.col("packed")))
    same = [left[c].eqNullSafe(chosen[c]) for c in (*source, "layout")]
    carried = [f"_c_{c}" for c in carry]
    rows = left.join(chosen, reduce(lambda a, b: a & b, same)).select("_key", *carried, "delimiter", "packed").distinct()
    pieces = reduce(
        lambda case, i: case.when(F.col("delimiter") == i, CANDIDATES[i][1](F.col("packed"))),
        range(1, len(CANDIDATES)),
        F.when(F.col("delimiter") == 0, CANDIDATES[0][1](F.col("packed"))),
    )
    return rows.select("_key", *carried, pieces.alias("pieces"))


def split_packed(
    df: DataFrame, key: str, field: str, source: list[str], names: tuple[str, ...] = ("a", "b"), carry: tuple[str, ...] = ()
) -> DataFrame:
    """(key, carried columns, pos, *names): one row per packed value of `field`, `pos` counting from 1 as written.

    A value holds len(names) whole numbers in any notation. The delimiter is inferred per source and
    layout. Pieces with nothing in them, or with another count of numbers, keep their position and
    give no row; null, empty and bare-number strings give none. Repeated rows of a key give each value
    once (with `carry`, those that agree in the carried columns). Null keys are kept as one key; null sources are a
    source of their own. Extra columns are ignored. Runs a job while it is called.
    """
    rows = _pieces(df, key, field, source, list(carry), len(names))
    carried = [f"_c_{c}" for c in carry]
    found = rows.select("_key", *carried, F.posexplode("pieces").alias("at", "piece")).select(
        "_key", *carried, "at", F.regexp_extract_all("piece", F.lit(_NUMBER), F.lit(0)).alias("n")
    )
    return found.filter(F.size("n") == len(names)).select(
        F.col("_key").alias(key),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
        (F.col("at") + 1).alias("pos"),
        *[F.get("n", F.lit(i)).cast("double").cast("int").alias(name) for i, name in enumerate(names)],
    )


def count_packed(df: DataFrame, key: str, field: str, source: list[str], numbers: int = 2) -> DataFrame:
    """(key, values): how many values each packed string holds, by the rules of split_packed, counted where the string is."""
    rows = _pieces(df, key, field, source, [], numbers)
    whole = F.filter("pieces", lambda p: F.size(F.regexp_extract_all(p, F.lit(_NUMBER), F.lit(0))) == numbers)
    return rows.select(F.col("_key").alias(key), F.size(whole).cast("long").alias("values"))
