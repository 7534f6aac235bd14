"""Pages that are keywords, links or product tags rather than sentences, by their rank-frequency curves.

1. Every page's words are counted and ranked by windows, and a line is fitted to log(count) over log(rank): its
   slope and the residual. Of the words, those count as head words that many pages of a language use (the head
   of that language's own curve).
2. Pages of the same language and a like length say what is usual: the median share of head words, the quartiles
   of slope and residual. What few pages say is drawn towards what all pages say, by a fixed weight.
3. A page is found if the share of its head words is below half of the usual one, that is, if less than half
   of it reads like prose, and this is more than chance for its length (divergence), or its slope or residual is
   extreme, too.

No part of a page but its words' counts decides, and nothing is learned from labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.session import write_through

#: A head word is used by this share of a language's pages, by the lower end of Wilson's interval.
HEAD_SHARE = 0.1
#: Width of that interval in standard errors: a language of one or two pages has no head words by chance.
HEAD_CERTAINTY = 4.0
#: What n pages say weighs n against this number.
PRIOR_PAGES = 50.0
#: A length's usual share of head words is at least this part of its language's, as stuffed pages may prevail at a length.
LEAST_USUAL = 0.8
#: Part of the usual share of head words below which less than half of a page is prose.
HALF = 0.5
_LINK = "xlinkx"
#: Blocks of scripts written without spaces (Thai and Lao, Khmer, kana, Han); each sign is a word.
_NO_SPACES = r"[฀-໿ក-៿々-ヿㇰ-ㇿ㐀-鿿豈-﫿]"
#: Cyrillic letters and the Latin ones they are mistaken for.
LOOKALIKES = ("аеорсухіјѕ", "aeopcyxijs")


def language(lang: Column) -> Column:
    """The two-letter code of a language however written; "xx" for none."""
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(code.rlike("^[a-z]{2}$") & (F.lower(F.trim(lang)) != "und"), code).otherwise("xx")


def page_words(text: Column) -> Column:
    """The words of a page in order: a link is one word, markup and numbers are none; case and lookalikes are folded;
    of scripts without spaces each sign is a word."""
    text = F.regexp_replace(F.lower(text), r"<a\s[^<>]*>|\[url=[^\[\]]*\]", f" {_LINK} ")
    text = F.regexp_replace(text, r"<[^<>\n]*>|\[[^\[\]\n]*\]", " ")
    text = F.regexp_replace(text, r"(?:https?://|www\.)\S+", f" {_LINK} ")
    text = F.regexp_replace(text, r"&(?:[a-z]+|#[0-9]+);", " ")
    text = F.regexp_replace(text, _NO_SPACES, " $0 ")
    return F.regexp_extract_all(F.translate(text, *LOOKALIKES), F.lit(r"\p{N}*\p{L}[\p{L}\p{N}]*"), F.lit(0))


def _words(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(page, key, lang, words): one row per page with its words in order. A page is a row of the table."""
    rows = df.select(F.col(key).alias("key"), language(F.col(lang)).alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("key IS NOT NULL AND text IS NOT NULL")
    return write_through(rows.select(F.monotonically_increasing_id().alias("page"), "key", "lang", page_words(F.col("text")).alias("words")))


def _heads(words: DataFrame) -> DataFrame:
    """(word, head): head words of any language, as posts quote one another across languages. A language has at most
    1 / HEAD_SHARE times as many as its pages have different words on average."""
    used = words.select("lang", F.explode(F.array_distinct("words")).alias("word")).filter(F.col("word") != _LINK)
    used = used.groupBy("lang", "word").agg(F.count("*").alias("k"))
    pages = words.groupBy("lang").agg(F.count("*").alias("n"))  # one row for each of at most 677 codes
    share, z2 = F.col("k") / F.col("n"), HEAD_CERTAINTY**2
    low = (share + z2 / (2 * F.col("n")) - HEAD_CERTAINTY * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") ** 2))) / (1 + z2 / F.col("n"))
    return write_through(used.join(F.broadcast(pages), "lang").filter(low >= HEAD_SHARE).select("word", F.lit(True).alias("head")).distinct())


def page_curves(df: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, words, distinct, head, slope, residual) of each page with words: its number of words, of different
    words and of head words, and the line through its rank-frequency curve (no slope for one word). Pages are
    shuffled once, as arrays; counting, ranking and fitting stay where a page's words are. Runs jobs."""
    words = _words(df, key, text, lang)
    heads = _heads(words)
    tokens = words.repartition("page").select("page", "key", "lang", F.explode("words").alias("word"))
    counts = tokens.groupBy("page", "key", "lang", "word").agg(F.count("*").alias("n"))
    marked = counts.join(heads, "word", "left")  # Spark broadcasts the head words if their measured size allows it
    order = Window.partitionBy("page").orderBy(F.desc("n"))
    lines = marked.withColumn("y", F.ln("n")).withColumn("x", F.ln(F.row_number().over(order)))
    return write_through(lines.groupBy("page", "key", "lang").agg(
        F.sum("n").alias("words"), F.count("*").alias("distinct"),
        F.sum(F.when(F.col("head"), F.col("n")).otherwise(0)).alias("head"),
        F.expr("regr_slope(y, x)").alias("slope"),
        F.expr("sqrt(greatest(0, regr_syy(y, x) - coalesce(regr_sxy(y, x) * regr_slope(y, x), 0)) / count(*))").alias("residual"),
    ))


def _usual(pages: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """What pages of a kind are like: the median head share, the quartiles of slope and residual."""
    quartiles = F.array(F.lit(0.25), F.lit(0.75))
    return pages.groupBy(*by).agg(
        F.count("*").alias(f"{prefix}n"), F.percentile_approx("p", F.lit(0.5), F.lit(1000)).alias(f"{prefix}p"),
        *[F.percentile_approx(c, quartiles, F.lit(1000)).alias(f"{prefix}{c}") for c in ("slope", "residual")],
    )


def _drawn(own: Column, n: str, every: Column) -> Column:
    """What n pages say, drawn towards what all pages say."""
    return F.coalesce((F.col(n) * own + PRIOR_PAGES * every) / (F.col(n) + PRIOR_PAGES), own, every)


def with_usual(curves: DataFrame) -> DataFrame:
    """Adds what is usual for a page's language and length: usual_p, and the quartiles slope_q and residual_q."""
    pages = curves.withColumn("bin", F.floor(F.log2("words"))).withColumn("p", F.col("head") / F.col("words"))
    # at most a row for each of 677 codes and 64 lengths, for each code, for each length, and one in all
    both, length, code = _usual(pages, ["lang", "bin"], "b_"), _usual(pages, ["bin"], "l_"), _usual(pages, ["lang"], "c_")
    every = pages.agg(F.percentile_approx("p", F.lit(0.5), F.lit(1000)).alias("e_p"))
    kinds = both.join(F.broadcast(length), "bin").join(F.broadcast(code), "lang").join(F.broadcast(every))  # one row
    p_code = _drawn(F.col("c_p"), "c_n", F.col("e_p"))
    usual = {"usual_p": F.greatest(_drawn(F.col("b_p"), "b_n", p_code), LEAST_USUAL * p_code)}
    for c in ("slope", "residual"):
        usual[f"{c}_q"] = F.array(*[_drawn(F.get(f"b_{c}", F.lit(i)), "b_n", F.get(f"l_{c}", F.lit(i))) for i in (0, 1)])
    return pages.join(F.broadcast(kinds.select("lang", "bin", *[x.alias(c) for c, x in usual.items()])), ["lang", "bin"])


def _divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of a share p from q, in nats; 0 where p isn't smaller."""
    q = F.greatest(F.least(q, F.lit(0.999)), F.lit(1e-3))
    part = F.when(p > 0, p * F.ln(p / q)).otherwise(0.0)
    return F.when(p < q, part + F.when(p < 1, (1 - p) * F.ln((1 - p) / (1 - q))).otherwise(0.0)).otherwise(0.0)


def _outside(c: str, times: float) -> Column:
    """Farther than `times` the width of the quartiles from them; false for pages without a slope."""
    low, high = F.col(f"{c}_q")[0], F.col(f"{c}_q")[1]
    width = F.greatest(high - low, F.lit(1e-3))
    return F.coalesce((F.col(c) < low - times * width) | (F.col(c) > high + times * width), F.lit(False))


def stuffed_pages(
    df: DataFrame, key: str, text: str = "text", lang: str = "lang", evidence: float = 2.0, spread: float = 2.0
) -> DataFrame:
    """(key, head_share, usual_share, divergence, slope, residual): pages less than half of which reads like prose.

    The share of head words must be below HALF of that of pages of the same language and a like length, and one of
    these must hold: the page's words give at least `evidence` nats against that half (words times divergence
    from it; so a page needs about eight words), or slope or residual lies beyond `spread` interquartile ranges
    from the usual quartiles. divergence is that of the page from the usual share, in nats a word.

    Null keys and null texts take no part; texts without words are never found; repeated rows are pages of their own
    and give one row; a key with several texts is found if one of them is (the one of largest divergence is shown).
    Null or unknown languages form one of their own. Other columns are ignored. Runs jobs while it is called.
    """
    pages = with_usual(page_curves(df, key, text, lang))
    p, half = F.col("p"), HALF * F.col("usual_p")
    against = F.col("words") * _divergence(p, half)
    found = pages.filter((p < half) & ((against >= evidence) | _outside("slope", spread) | _outside("residual", spread)))
    shown = F.struct(_divergence(p, F.col("usual_p")).alias("divergence"), p.alias("head_share"), F.col("usual_p").alias("usual_share"), "slope", "residual")
    best = found.groupBy("key").agg(F.max_by(shown, shown["divergence"]).alias("b"))
    return best.select(F.col("key").alias(key), "b.head_share", "b.usual_share", "b.divergence", "b.slope", "b.residual")
