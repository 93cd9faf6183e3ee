"""Quality rules whose cut-offs follow the corpus: quantiles per language and source.

The quantile sketch is a table of counts over logarithmic bins (relative error ``GAMMA - 1``).
Counts of one bin add up, so sketches merge exactly, over tasks as well as from sources to
languages to the whole corpus, and the result does not depend on the layout of the data. Every
cut-off is a number of quartile ranges beyond the quartiles of a sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
GAMMA = 1.02
ZERO_BIN = -100_000
# Weight of the parent, in documents: the sketch of a language is merged with that of the corpus,
# and that of a source with its language's, so a group of few documents follows its parent.
PRIOR_DOCS = 200.0
UNITS = 1000
# Distance from the quartiles, in quartile ranges, beyond which a value is an outlier. Shares that
# are zero in most documents are compared by their log odds among the documents that have any.
REACH = 5.0
LOG_REACH = 2.0
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LINEAR = ("word_length", "mark_share")
ODDS = ("symbol_share", "dup_line_share", "repeat_share")
LOWER = ("word_length",)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _squeezed(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Replace ``words`` by ``n_repeat_words``.

    Hashes of all windows are compared as a set first; only texts with a repeated window sort
    (hash, position) pairs. Everything stays inside the row and is linear or n log n in its words.
    """
    n = F.size("words")
    gram = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    df = df.withColumn("grams", F.when(n >= 3, gram)).drop("words")
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    pairs = F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("grams", F.when(repeated, F.array_sort(pairs)))

    def again(x: Column, i: Column) -> Column:
        before, after = F.get("grams", i - 1)["h"], F.get("grams", i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    inside = F.transform(
        F.filter("grams", again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)
    )
    covered = F.size(F.array_distinct(F.flatten(inside)))
    covered = F.when(F.col("grams").isNull(), 0).otherwise(covered).cast("long")
    return df.withColumn("n_repeat_words", covered).drop("grams")


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with the five counts of every text, its lines and its ASCII marks.

    NULL and empty texts have no words and no line with a word. The added names must be free.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    blank = " \t\n\x0b\x0c\r"
    counted = df.select(
        *[c for c in df.columns if c != text],
        F.filter(F.split(body, SPACE, -1), lambda w: w != "").alias("words"),
        lines.alias("lines"),
        (F.char_length(body) - _squeezed(body, blank)).cast("long").alias("word_chars"),
        _squeezed(body, SYMBOLS).cast("long").alias("n_symbols"),
        _squeezed(body, MARKS).cast("long").alias("n_marks"),
    )
    counted = counted.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("lines")
    return _repeat_words(counted)


def failed_base() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def _odds(part: str, whole: str) -> Column:
    """The odds of a share, NULL for none; half a unit more in the rest keeps those of 1 finite."""
    return F.when(F.col(part) > 0, F.col(part) / (F.col(whole) - F.col(part) + 0.5))


def _measures() -> dict[str, Column]:
    return {
        "word_length": _share("word_chars", "n_words"),
        "mark_share": _share("n_marks", "word_chars"),
        "symbol_share": _odds("n_symbols", "word_chars"),
        "dup_line_share": _odds("n_dup_lines", "n_lines"),
        "repeat_share": _odds("n_repeat_words", "n_words"),
    }


def _bin(value: Column) -> Column:
    inside = F.ceil(F.log(value) / F.lit(math.log(GAMMA)))
    return F.when(value > 0, inside).when(value == 0, F.lit(ZERO_BIN)).cast("int")


def sketches(df: DataFrame) -> DataFrame:
    """Bin counts per measure for every (lang, source), every lang and the corpus (``level`` 2, 1, 0)."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), _bin(value).alias("bin"))
            for name, value in _measures().items()
        ]
    )
    finest = (
        df.select("lang", "source", F.explode(cells).alias("cell"))
        .filter("cell.bin IS NOT NULL")
        .groupBy("lang", "source", "cell.measure", "cell.bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rolled = finest.groupingSets(
        [
            [F.col("measure"), F.col("bin"), F.col("lang"), F.col("source")],
            [F.col("measure"), F.col("bin"), F.col("lang")],
            [F.col("measure"), F.col("bin")],
        ],
        "measure",
        "bin",
        "lang",
        "source",
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, 2).when(F.col("gid") == 1, 1).otherwise(0)
    return rolled.select("measure", "bin", "lang", "source", "n", level.alias("level"))


def _blend(own: DataFrame, keys: list[str], parent: DataFrame, on: str, prior: float) -> DataFrame:
    """The sketches of ``own`` merged with those of their ``parent``, scaled to ``prior`` documents.

    Counts are integers in units of 1 / ``UNITS`` document, so that no order of adding matters. The
    rows are bins of groups, whatever the number of documents.
    """
    shares = parent.withColumn("total", F.sum("n").over(Window.partitionBy(on, "measure")))
    share = F.expr(f"{round(prior * UNITS)} * n div total")
    given = own.select(on, *keys).distinct().join(shares, on).select(on, *keys, "measure", "bin", share.alias("n"))
    mine = own.select(on, *keys, "measure", "bin", (F.col("n") * UNITS).alias("n"))
    return mine.unionByName(given).groupBy(on, *keys, "measure", "bin").agg(F.sum("n").alias("n"))


def cutoffs(sketch: DataFrame, prior: float = PRIOR_DOCS) -> DataFrame:
    """``lang, source`` with the lowest and highest accepted value of every measure.

    All come from the quartiles of the sketches: the outer edges of the bins that hold them, as
    logarithms for odds. A measure without a range between them gets NULL: no cut-off.
    """
    named = sketch.withColumn("corpus", F.lit(""))
    whole = named.filter("level = 0").select("corpus", "measure", "bin", "n")
    langs = _blend(named.filter("level = 1"), ["lang"], whole, "corpus", prior)
    blend = _blend(sketch.filter("level = 2"), ["source"], langs.drop("corpus"), "lang", prior)
    group = Window.partitionBy("lang", "source", "measure")
    ranked = blend.select(
        "*", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("total")
    )
    limits, picked = [], []
    for name in (*LINEAR, *ODDS):
        for label, quarters, outer in (("q1", 1, -1), ("q3", 3, 0)):
            reached = (F.col("measure") == name) & (4 * F.col("upto") >= quarters * F.col("total"))
            edge = F.min(F.when(reached, F.col("bin"))) + outer
            edge = F.pow(F.lit(GAMMA), edge) if name in LINEAR else edge * F.lit(math.log(GAMMA))
            picked.append(edge.alias(f"{label}_{name}"))
        q1, q3 = F.col(f"q1_{name}"), F.col(f"q3_{name}")
        reach = F.lit(REACH if name in LINEAR else LOG_REACH) * F.nullif(q3 - q1, F.lit(0.0))
        limits.append((q3 + reach).alias(f"high_{name}"))
        if name in LOWER:
            limits.append((q1 - reach).alias(f"low_{name}"))
    return ranked.groupBy("lang", "source").agg(*picked).select("lang", "source", *limits)


def within(limits: DataFrame) -> Column:
    """No value beyond a cut-off; a measure without a value or a cut-off accepts."""
    beyond = F.lit(False)
    for name, value in _measures().items():
        value = F.log(value) if name in ODDS else value
        beyond = beyond | F.coalesce(value > F.col(f"high_{name}"), F.lit(False))
        if name in LOWER:
            beyond = beyond | F.coalesce(value < F.col(f"low_{name}"), F.lit(False))
    return ~beyond


def _counted(docs: DataFrame, text: str, lang: str, source: str, *carried: Column) -> DataFrame:
    rows = docs.select(
        *carried,
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.col(text).alias("text"),
    )
    return text_counts(rows).withColumn("base_failed", failed_base())


def judge_quality(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    prior: float = PRIOR_DOCS,
) -> DataFrame:
    """``doc_id, text_key``, the five counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    ``text_key`` is a hash of the text, so that rows repeated under one key stay apart. A document
    is kept if it passes the base rule and lies inside the cut-offs of its language and source, whose
    sketch is merged with that of the language at the weight of ``prior`` documents.
    NULL and empty language or source form one group. Cut-offs come from the documents that pass
    the base rule; without any, nothing is kept. Other columns are not read.
    """
    counts = stored(
        _counted(docs, text, lang, source, F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_key"))
    )
    # Stored, so that the join knows the size of the cut-offs before it moves the counts.
    sketch = stored(sketches(counts.filter(~F.col("base_failed"))))
    limits = stored(cutoffs(sketch, prior))
    joined = counts.join(limits, ["lang", "source"], "left")
    kept = ~F.col("base_failed") & within(limits)
    return joined.select("doc_id", "text_key", *COUNTS, "base_failed", kept.alias("kept"))


def keep_good(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    prior: float = PRIOR_DOCS,
) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with all their columns.

    Rows travel through the counting pass and its table, so no text is shuffled or joined back.
    """
    counts = _counted(docs, text, lang, source, F.struct(*docs.columns).alias("row"))
    # Filtered after the table, or the optimizer would repeat the counting inside the filter.
    counts = stored(counts).filter(~F.col("base_failed"))
    limits = stored(cutoffs(stored(sketches(counts)), prior))
    return counts.join(limits, ["lang", "source"]).filter(within(limits)).select("row.*")
