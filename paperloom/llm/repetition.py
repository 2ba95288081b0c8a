"""Problem 4: repeated content inside a single document.

A table of thresholds is compiled into one Spark projection of length, symbol, stop-word, line and repetition measures. Nothing in
it is a user function, a join or a shuffle: every measure is an expression over the row's own text.

The share of repeated content: the section texts lose marks, spaces and digits (running numbers), every window of ``width``
characters is hashed, and the windows are sorted by hash and position inside the row. A window whose predecessor has the same hash
repeats earlier text; the share is what such windows cover. Windows do not reach over a section's end. A position and the
upper 44 bits of its hash are packed into one long so that the sort is one of plain numbers (of pairs of numbers where a text has more
positions than the lower bits hold); equal bits are confirmed on the text.

Defined results: null maps, empty sections and texts without letters have measures of 0 and no flag but ``too_short``. Null section
values count as empty. Repeated rows are measured each on its own. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name of the flag, measure, comparison, threshold
THRESHOLDS = (
    ("too_short", "n_letters", "<", 20.0),
    ("too_many_symbols", "symbol_share", ">", 0.4),
    ("no_stop_words", "stop_word_share", "<", 0.005),
    ("too_many_ellipsis_lines", "ellipsis_line_share", ">", 0.3),
    ("too_many_bullet_lines", "bullet_line_share", ">", 0.9),
    ("duplicate_lines", "duplicate_line_share", ">", 0.3),
    ("repeated_content", "repeated_share", ">=", 0.3),
)
#: Function words of Chinese (single characters) and English.
STOP_CHARS = "的了在是和与及或被把由对从为以而也不其中"
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "was", "by", "that", "is", "for", "with", "on", "before", "when")
WIDTH = 20
#: Longest text, in characters, whose positions fit beside the hash; the position is the low part of the packed long.
POSITION_BITS = 20
#: No letter, and its bytes in UTF-32 can't arise across characters.
BREAK = "\U0010ffff"


def letters_only(sections: Column) -> Column:
    """Section texts without marks, spaces and digits; sections are set apart by one break character, which no text holds."""
    values = F.transform(F.coalesce(F.map_values(sections), F.array().cast("array<string>")), lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), r"[^\p{L}]+", ""))
    return F.array_join(values, BREAK)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; an expression that a lambda mentions is otherwise computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered(text: Column, width: int = WIDTH) -> Column:
    """How many characters of a text lie in windows that already occurred earlier in it."""
    low = (1 << POSITION_BITS) - 1
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    high = lambda x: x.bitwiseAND(F.lit(~low))
    end = F.encode(F.lit(BREAK), "UTF-32")

    def positions(raw: Column) -> Column:
        window = lambda i: F.substring(raw, i * 4 + 1, F.lit(4 * width))
        starts = F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - width)
        hashes = F.transform(starts, lambda i: F.xxhash64(window(i)))

        def again(a: Column, at=at, high=high) -> Column:
            same = F.filter(F.sequence(F.lit(1), F.size(a) - 1), lambda j: high(F.get(a, j)) == high(F.get(a, j - 1)))
            sure = F.filter(same, lambda j: (window(at(F.get(a, j))) == window(at(F.get(a, j - 1)))) & ~F.contains(window(at(F.get(a, j))), end))
            return F.sort_array(F.transform(sure, lambda j: at(F.get(a, j))))

        packed = lambda h: F.sort_array(F.transform(h, lambda x, i: high(x).bitwiseOR(i.cast("bigint"))))
        paired = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        long = lambda h: let(paired(h), lambda a: again(a, lambda x: x["i"], lambda x: x["h"]))
        repeats = lambda h: F.when(F.size(h) > low + 1, long(h)).otherwise(let(packed(h), lambda a: again(a)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)).otherwise(F.array().cast("array<int>")))

    total = F.aggregate(
        let(F.encode(text, "UTF-32"), positions),
        F.struct(F.lit(0).alias("sum"), F.lit(-width).alias("last")),
        lambda s, p: F.struct((s["sum"] + F.least(p - s["last"], F.lit(width))).alias("sum"), p.alias("last")),
        lambda s: s["sum"],
    )
    return F.when(F.length(text) > width, total).otherwise(F.lit(0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def measures(text: Column, lines: Column, letters: Column) -> dict[str, Column]:
    """The measures by name, from the joined text, its non-blank lines and the result of :func:`letters_only`."""
    n_lines, n_chars = F.size(lines), F.length(F.regexp_replace(text, r"\s+", ""))
    n_letters = F.length(F.replace(letters, F.lit(BREAK), F.lit("")))
    english = F.regexp_count(F.lower(text), F.lit(r"\b(?:" + "|".join(STOP_WORDS) + r")\b"))
    stops = F.length(letters) - F.length(F.translate(letters, STOP_CHARS, "")) + english
    line_chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return {
        "n_letters": n_letters.cast("bigint"),
        "symbol_share": _share(n_chars - n_letters, n_chars),
        "stop_word_share": _share(stops, n_letters),
        "ellipsis_line_share": _share(F.size(F.filter(lines, lambda x: x.rlike(r"(?:…|\.\.\.)$"))), n_lines),
        "bullet_line_share": _share(F.size(F.filter(lines, lambda x: x.rlike(r"^[-*•·●]"))), n_lines),
        "duplicate_line_share": _share(line_chars(lines) - line_chars(F.array_distinct(lines)), line_chars(lines)),
        "repeated_share": _share(covered(letters), n_letters),
    }


def compile_thresholds(thresholds=THRESHOLDS) -> list[Column]:
    """Flags over the measures' columns; the comparisons are <, <=, >, >=."""
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    return [compare[sign](F.col(measure), F.lit(limit)).alias(flag) for flag, measure, sign, limit in thresholds]


def repetition_report(df: DataFrame, sections_col: str = "sections", keep: tuple[str, ...] = ("ord",), thresholds=THRESHOLDS) -> DataFrame:
    """The columns of ``keep``, a column per measure and a flag per row of the threshold table."""
    wanted = {m for _, m, _, _ in thresholds}
    own = ("_text", "_lines", "_letters")
    if set(own) & set(keep):
        raise ValueError(f"{', '.join(own)} can't be kept")
    values = F.transform(F.coalesce(F.map_values(sections_col), F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")))
    base = df.select(*keep, F.array_join(values, "\n").alias("_text"), letters_only(F.col(sections_col)).alias("_letters"))
    lined = base.withColumn("_lines", F.filter(F.transform(F.split("_text", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""))
    sized = lined.select(*keep, *(c.alias(k) for k, c in measures(*map(F.col, own)).items() if k in wanted))
    return sized.select(*keep, *(c for c in sized.columns if c not in keep), *compile_thresholds(thresholds))
