"""Secret scans: fixed patterns, and a battery of randomness tests for strings that have no pattern.

Base spans come from three patterns. Every other run of 16 or more token characters is tested for
randomness in its inferred encoding: uniform use of the alphabet (chi-squared over its characters, and
over its kinds: capitals, small letters, digits and signs), number of runs above and below the middle
of the alphabet, and serial correlation of neighbours. The kinds tell words, paths and identifiers
from short random strings, in which most characters are missing anyway. The deviations
are squared and added. How often ordinary long words of the corpus, of the same or a smaller
length class, look at least as random is the p-value of a string, and the Benjamini-Hochberg rule
over all strings limits the share of false discoveries. Counts per class decide, so nothing but
small tables meets in one place. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import order_id, stored

# (kind, pattern, group that has the least length, least length)
BASE = (
    (
        "assign",
        "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)
RANDOM = "random"
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
# Ordinary words: the reference that strings have to differ from. Capitals alone are neither words,
# as they may be keys, nor tested, as the letters alone do not tell.
WORD = "^[A-Z]?[a-z]+$"
CAPITALS = "^[A-Z]+$"
FALSE_SHARE = 0.05
# Upper 0.1 % point of a chi-squared variable with five degrees of freedom.
MOST_DEVIATION = 20.52
STEPS = 2  # classes of deviation per unit
ENCODINGS = {
    "decimal": ("^[0-9]+$", "0123456789"),
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
# Consecutive characters of one kind in each alphabet.
CLASSES = {"decimal": (10,), "hex": (10, 6), "base32": (26, 6), "base64": (26, 26, 12)}


def _quick(pattern: str, least: int) -> str:
    """A pattern that holds wherever a long enough match does, for a cheap first look."""
    return pattern[:-1] + f"{{{least},}}" if pattern.startswith("[0-9a-f]") else pattern


def matches(rows: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """``doc, text_key, kind, start, end, token`` of the leftmost matches; too short ones are dropped.

    Matches and the gaps between them alternate, so running sums of their lengths are the places.
    A window holds the matches of one text.
    """
    hit = rows.filter(F.col("text").rlike(_quick(pattern, least)))
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    both = F.arrays_zip(found.alias("token"), gaps.alias("gap"))
    cut = hit.select("doc", "text_key", F.posexplode(both).alias("i", "x")).select(
        "doc", "text_key", "i", F.col("x.token").alias("token"), F.char_length("x.gap").alias("gap")
    )
    upto = Window.partitionBy("doc", "text_key").orderBy("i")
    end = F.sum(F.col("gap") + F.coalesce(F.char_length("token"), F.lit(0))).over(upto)
    placed = cut.distinct().select("doc", "text_key", "token", end.alias("end")).filter("token IS NOT NULL")
    value = F.col("token") if group == 0 else F.regexp_extract("token", pattern, group)
    return placed.filter(F.char_length(value) >= least).select(
        "doc",
        "text_key",
        F.lit(kind).alias("kind"),
        (F.col("end") - F.char_length("token")).alias("start"),
        "end",
        "token",
    )


def _deviation(df: DataFrame) -> DataFrame:
    """Add ``encoding`` and ``deviation`` (near chi-squared with 5 degrees of freedom if random)."""
    encoding = F.lit("base64")
    for name in ("base32", "hex", "decimal"):
        encoding = F.when(F.col("token").rlike(ENCODINGS[name][0]), name).otherwise(encoding)
    alphabet, size = F.lit(ENCODINGS["base64"][1]), F.lit(64)
    for name in ("base32", "hex", "decimal"):
        letters = ENCODINGS[name][1]
        mine = F.col("encoding") == name
        alphabet, size = F.when(mine, letters).otherwise(alphabet), F.when(mine, len(letters)).otherwise(size)
    body = F.translate(F.regexp_replace("token", "=+$", ""), "-_", "+/")
    df = df.withColumn("encoding", encoding).withColumns({"alphabet": alphabet, "size": size, "body": body})
    body = F.when(F.col("encoding") == "hex", F.lower("body")).otherwise(F.col("body"))
    df = df.withColumn("x", F.filter(F.transform(F.split(body, ""), lambda c: F.instr(F.col("alphabet"), c) - 1), lambda i: i >= 0))
    n, half = F.size("x"), F.col("size") / 2
    df = df.filter(n >= 8).withColumns(
        {
            "n": n.cast("double"),
            "seen": F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda s: F.size(F.filter("x", lambda v: v == s))),
            "high": F.transform("x", lambda v: (v >= half).cast("int")),
            "mean": F.aggregate("x", F.lit(0), lambda a, v: a + v) / n,
        }
    )
    n = F.col("n")

    def total(col: Column) -> Column:
        return F.aggregate(col, F.lit(0.0), lambda a, v: a + v)

    squares = total(F.transform("seen", lambda o: (o * o).cast("double")))
    free = F.col("size") - 1
    chi = (squares * F.col("size") / n - n - free) / F.sqrt(2.0 * free)
    ones = total(F.transform("high", lambda v: v.cast("double")))
    zeros = n - ones
    runs = 1.0 + total(F.transform("high", lambda v, i: F.when((i > 0) & (F.get("high", i - 1) != v), 1.0).otherwise(0.0)))
    expected = 2.0 * ones * zeros / n + 1.0
    spread = (expected - 1.0) * (expected - 2.0) / (n - 1.0)
    runs_z = F.when(spread > 0, (runs - expected) / F.sqrt(spread)).otherwise(F.sqrt(n))
    off = F.transform("x", lambda v: v - F.col("mean"))
    df = df.withColumn("off", off)
    power = total(F.transform("off", lambda v: v * v))
    serial = total(F.transform("off", lambda v, i: v * F.coalesce(F.get("off", i + 1), F.lit(0.0))))
    serial_z = F.when(power > 0, (serial / power + 1.0 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    positive = F.greatest(chi, F.lit(0.0))
    deviation = positive * positive + runs_z * runs_z + serial_z * serial_z
    return df.withColumn("deviation", deviation + _kinds(F.col("encoding"), F.col("seen"), n))


def _kinds(encoding: Column, seen: Column, n: Column) -> Column:
    """Chi-squared of the kinds of characters (capitals, small letters, digits and signs)."""
    out = F.lit(0.0)
    for name, sizes in CLASSES.items():
        parts, at = F.lit(0.0), 1
        for size in sizes if len(sizes) > 1 else ():
            found = F.aggregate(F.slice(seen, at, size), F.lit(0.0), lambda a, v: a + v)
            expected = n * (size / sum(sizes))
            parts = parts + (found - expected) * (found - expected) / expected
            at += size
        out = F.when(encoding == name, parts).otherwise(out)
    return out


def discoveries(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens`` that count as random; ``tokens`` has ``token`` and any other columns.

    Strings that match ``WORD`` (small letters, perhaps with a capital in front) are the reference and
    never count as random; strings of capitals alone are left out.

    Counts per (length class, deviation class) are all that is compared across the corpus; there
    are at most a few hundred of them whatever its size.
    """
    columns = tokens.columns
    tested = _deviation(tokens.filter(~F.col("token").rlike(CAPITALS))).withColumns(
        {
            "word": F.col("token").rlike(WORD),
            "length": F.floor(2.0 * F.log2(F.char_length("token"))).cast("int"),
            # All that is too far from random is one class, so there are a few dozen per length.
            "level": F.floor(F.least("deviation", F.lit(MOST_DEVIATION + 1.0)) * STEPS).cast("int"),
        }
    )
    tested = stored(tested.select(*columns, "word", "length", "level", "deviation"))
    counts = tested.groupBy("word", "length", "level").agg(F.count(F.lit(1)).alias("n"))
    words = counts.filter("word").select(
        F.col("length").alias("word_length"), F.col("level").alias("word_level"), F.col("n").alias("word_n")
    )
    cells = counts.filter(~F.col("word")).select("length", "level", "n")
    # Ordinary words of the same or a smaller length class that are at least as random.
    paired = cells.join(words, F.col("word_length") <= F.col("length"), "left")
    as_random = F.coalesce(F.sum(F.when(F.col("word_level") <= F.col("level"), F.col("word_n"))), F.lit(0))
    tail = paired.groupBy("length", "level", "n").agg(
        ((as_random + 1) / (F.coalesce(F.sum("word_n"), F.lit(0)) + 1)).alias("p")
    )
    order = Window.orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = tail.select("*", F.sum("n").over(order).alias("rank"), F.sum("n").over(Window.partitionBy()).alias("m"))
    passed = ranked.filter(F.col("p") <= FALSE_SHARE * F.col("rank") / F.col("m"))
    limit = passed.agg(F.max("p").alias("limit"))
    chosen = tail.join(limit, F.col("p") <= F.col("limit")).select("length", "level")
    random = tested.filter(~F.col("word") & (F.col("deviation") <= MOST_DEVIATION))
    return random.join(chosen, ["length", "level"]).select(*columns)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, added`` for every row of ``docs``.

    ``base`` and ``added`` are arrays of ``(start, kind_order, kind, end, token)`` in this order,
    places counted in code points with an exclusive end. ``added`` are random strings that touch no
    base span. NULL and empty texts have none. Keys may be NULL or repeated; equal rows have equal
    spans. Other columns are not read.
    """
    rows = docs.select(
        order_id(key).alias("doc"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")
    )
    parts = [matches(rows, *b) for b in BASE]
    base = parts[0].unionByName(parts[1]).unionByName(parts[2])
    place = F.array_position(F.array(*[F.lit(b[0]) for b in BASE]), F.col("kind")).cast("int")
    span = F.struct("start", place.alias("kind_order"), "kind", "end", "token")
    base = stored(base.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(span)).alias("base")))
    strings = matches(rows, RANDOM, TOKEN, 0, 16).join(base, ["doc", "text_key"], "left")
    free = ~F.exists(
        F.coalesce("base", F.array().cast(base.schema["base"].dataType)),
        lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]),
    )
    added = discoveries(strings.filter(free).select("doc", "text_key", "start", "end", "token"))
    span = F.struct("start", F.lit(len(BASE) + 1).alias("kind_order"), F.lit(RANDOM).alias("kind"), "end", "token")
    added = added.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(span)).alias("added"))
    narrow = docs.select(F.col(key).alias("doc_id"), order_id(key).alias("doc"), F.xxhash64(text).alias("text_key"))
    joined = narrow.join(base, ["doc", "text_key"], "left").join(added, ["doc", "text_key"], "left")
    none = F.array().cast(base.schema["base"].dataType)
    return joined.select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added")
    )


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, by start and then kind."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
