"""Problem 5: visually identical text with different characters.

Values are brought to one form in three steps, all of them SQL:

1. a look-alike map: full-width forms, radical and compatibility ideographs, letters of other alphabets, kinds of spaces and line
   ends become one character, what can't be seen is removed, and letters followed by marks are composed;
2. the mapped values are grouped under the accent-sensitive, case-sensitive Unicode collation, which makes composed and decomposed
   accents equal and keeps raised and circled figures, accents and case apart;
3. each class gets a deterministic canonical member (the shortest, then least value of the class by binary order), which is joined back.

Collating long texts is dear, so it only sees values that can have a partner: values are first gathered by a binary key that the
collation can't split (the mapped text without accents), and a value alone under its key is a class of its own. The keys are
written down once; texts are only moved where they have a partner.

Defined results: null stays null; blank values are their own canonical form and never part of a pair. Repeated rows share a class.
Only the named columns are touched. A value without a partner takes its form from the first step alone, so it also compares with
other tables; several marks on one letter that are not in canonical order or don't compose one after the other, and jamo, are only
united by the second step.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import checkpoint

#: Rows of a field, an identifier and a key that may be broadcast, some 100 bytes each in memory.
MOST_BROADCAST = 500_000
COLLATION = "UNICODE"
#: Letters of other alphabets that look like Latin ones.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԛԝаеѕіјорсухһԁԜ", "ABESIJKMHOPCTYXYqwaesijopcyxhdW")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj")
#: Spaces that look like a plain one; lines' ends are treated apart.
SPACES = "               　"
UNSEEN = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0000}-\x{e0fff}]"
ACCENTS = r"\p{M}+"


def _ranges() -> tuple[str, str]:
    """The map that follows from rules: wide and narrow forms, radicals and compatibility ideographs to what they stand for."""
    pairs = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    for low, high in ((0x2E80, 0x2FDF), (0xF900, 0xFB00), (0x2F800, 0x2FA20)):
        for code in range(low, high):
            other = unicodedata.normalize("NFKC", chr(code))
            if len(other) == 1 and other != chr(code):
                pairs[chr(code)] = other
    for code in range(0xFF61, 0xFFA0):
        other = unicodedata.normalize("NFKC", chr(code))
        if len(other) == 1:
            pairs[chr(code)] = other
    for a, b in (CYRILLIC, GREEK):
        pairs |= dict(zip(a, b))
    pairs |= dict.fromkeys(SPACES, " ")
    return "".join(pairs), "".join(pairs.values())


def _accents() -> tuple[str, str]:
    """Letters that decompose to their base letter; syllable blocks, which have no base, are left to the pattern of :func:`coarse`."""
    pairs = {}
    mark = lambda x: unicodedata.category(x)[0] == "M"
    for code in range(0xC0, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(code))
        if parts != chr(code) and not mark(parts[0]) and all(mark(x) for x in parts[1:]):
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


def _composed() -> dict[str, str]:
    """A letter and one mark behind it to the composed letter."""
    pairs = {}
    for code in range(0xC0, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            two = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", two) == chr(code):
                pairs[two] = chr(code)
    return pairs


LOOK_ALIKE, PLAIN = _ranges()
ACCENTED, BASE = _accents()
COMPOSED = _composed()


def composed(text: Column) -> Column:
    """Letters with the marks behind them as one character, where there is one; texts without marks are not looked into."""
    table = F.create_map(*(F.lit(x) for pair in COMPOSED.items() for x in pair))
    two = lambda a, c: F.coalesce(F.try_element_at(table, F.concat(a, c)), F.concat(a, c))
    whole = lambda piece: F.when(F.length(piece) > 1, F.aggregate(F.split(piece, ""), F.lit(""), two)).otherwise(piece)
    pieces = lambda t: F.regexp_extract_all(t, F.lit(rf"[^\p{{M}}]+(?=[^\p{{M}}]\p{{M}}|\z)|[^\p{{M}}]?{ACCENTS}"), F.lit(0))
    plain = lambda piece: F.when(piece.rlike(r"\p{M}"), whole(piece)).otherwise(piece)
    return let(text, lambda t: F.when(t.rlike(r"\p{M}"), F.array_join(F.transform(pieces(t), plain), "")).otherwise(t))


def mapped(text: Column) -> Column:
    """Step 1: the look-alike map, without composing."""
    seen = F.translate(F.regexp_replace(text, UNSEEN, ""), LOOK_ALIKE, PLAIN)
    return F.regexp_replace(seen, r"\r\n|\r|\x{85}|\x{2028}|\x{2029}", "\n")


def coarse(text: Column) -> Column:
    """A binary key that values equal under the collation always share: the mapped text without accents."""
    return F.xxhash64(F.translate(F.regexp_replace(text, r"[\p{M}\p{Cc}\p{Cf}\p{IsHangul}]+", ""), ACCENTED, BASE))


def values_of(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, id, value) of all values that are not blank."""
    items = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    rows = df.select(F.col(id_col).alias("id"), F.explode(items).alias("x")).select("id", "x.field", "x.value")
    return rows.where("value is not null").where(F.col("value").rlike(r"[^\s\p{Z}\p{Cf}]"))


def _partners(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, id, k, value): the values that have a partner under the coarse key which differs in bytes.

    Keys are small rows, written down once. The rows with a partner are found among them, and only if these are few are they broadcast to
    where the texts are; otherwise the planner decides.
    """
    rows = values_of(df, id_col, fields)
    marked = checkpoint(rows.select("field", "id", coarse(mapped(F.col("value"))).alias("k"), F.xxhash64("value").alias("h")))
    several = marked.groupBy("field", "k").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("field", "k")
    wanted = checkpoint(marked.join(several, ["field", "k"], "left_semi").distinct())
    few = wanted.count() <= MOST_BROADCAST
    return rows.withColumn("h", F.xxhash64("value")).join(F.broadcast(wanted) if few else wanted, ["field", "id", "h"]).select("field", "id", "k", "value")


def look_alike_classes(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, id, value, class_id, canonical) of every value that has a differing partner of the same look."""
    texts = _partners(df, id_col, fields).withColumn("m", mapped(F.col("value")))
    return df.sparkSession.sql(
        f"""
        WITH forms AS (SELECT field, k, m COLLATE {COLLATION} AS form, value, id FROM {{texts}}),
        classes AS (
          SELECT field, k, form, min(id) AS class_id, min_by(value, struct(length(value), value)) AS canonical, count(DISTINCT value) AS n
          FROM forms GROUP BY field, k, form)
        SELECT f.field, f.id, f.value, c.class_id, c.canonical
        FROM forms f JOIN classes c ON f.field = c.field AND f.k = c.k AND f.form = c.form
        WHERE c.n > 1""",
        texts=texts,
    )


def look_alike_members(df: DataFrame, id_col: str = "ord", fields: tuple[str, ...] = ("title", "full_text")) -> DataFrame:
    """(field, class_id, <id>, digest): the members of all classes with more than one form; the digest tells the forms apart."""
    found = look_alike_classes(df, id_col, fields)
    return found.select("field", "class_id", F.col("id").alias(id_col), F.md5("value").alias("digest"))


def class_report(members: DataFrame) -> DataFrame:
    """(field, class_id, n_records, n_forms) per class."""
    return members.groupBy("field", "class_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("digest").alias("n_forms"))


def look_alike_pairs(df: DataFrame, id_col: str = "ord", fields: tuple[str, ...] = ("title", "full_text")) -> DataFrame:
    """(field, ord_a, ord_b): records (ord_a < ord_b) whose values look the same and are different strings."""
    found = checkpoint(look_alike_members(df, id_col, fields))
    one, two = (found.select("field", "class_id", F.col(id_col).alias(f"ord_{x}"), F.col("digest").alias(f"d_{x}")) for x in "ab")
    return one.join(two, ["field", "class_id"]).where("ord_a < ord_b and d_a <> d_b").select("field", "ord_a", "ord_b")


def one_form(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """All columns of ``df`` with the fields in one consistent form: the mapped and composed canonical member of their class."""
    classes = look_alike_classes(df, id_col, fields)
    own = classes.groupBy(F.col("id").alias("_id")).agg(*(F.max(F.when(F.col("field") == f, F.col("canonical"))).alias(f"_form_{i}") for i, f in enumerate(fields)))
    joined = df.join(own, df[id_col] == own["_id"], "left")
    form = {f: composed(mapped(F.coalesce(own[f"_form_{i}"], df[f]))).alias(f) for i, f in enumerate(fields)}
    return joined.select(*(form.get(c, df[c]) for c in df.columns))
