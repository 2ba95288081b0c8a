"""Problem 2: splits that keep related records together.

Records that share any entity (a unit, a head of project) are one group, also through other records. The graph has the entities
as nodes; a record with several of them is a star around its smallest. Equal edges are merged before anything is shuffled on, so
a unit that holds a third of all records weighs no more than its distinct neighbours. Connected components come from alternating
large-star and small-star steps, which need no driver-side structure: each step is a minimum per node, combined before the shuffle,
and a join. In large graphs nodes with more than a thousandth of all edges, and always entities of as many records, are joined through a broadcast of their one value
(:func:`.hot.join_hot`), so neither a hub's neighbours nor a hot entity's records meet in one task.

Defined results: a record without entities is its own group with a null key. Null messages, metadata or numbers give no entity.
Repeated rows get the same group. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evidence import uniform
from ..session import checkpoint
from .hot import join_hot

FEW_EDGES = 1_000_000
#: How a report number may be written after width folding and upper-casing.
NUMBER = r"([A-Z]{2}[0-9]{3})[^A-Z0-9]?([0-9]{4})[^A-Z0-9]?([0-9]{7})(?![0-9])"
SERIAL = r"(?<![0-9])([0-9]{7})(?![0-9])"
#: A line that names the heads of a project (not its advisers, members or examiners).
HEAD_LINE = (
    r"(?im)^[ \t　 ]*(?:"
    r"[【\[]?(?:本)?(?:课题|项目)?(?:主要)?(?:负责人|主持人|主持)(?:[（(]签[名字][)）]|[】\]]|[ \t　]*[:：]|[ \t　]+)[ \t　]*([^\n\r]*)"
    r"|本(?:课题|项目)由([^\n\r]*?)(?:主持|负责)[^\n\r]*"
    r"|(?:heads? of(?: the)? project|project (?:leads?|leaders?|heads?)|led by)[ \t]*[:：]?[ \t]*([^\n\r]*)"
    r")[ \t　]*$"
)
SEPARATORS = r"\s*(?:[、，,；;/／&＆|]|\band\b|(?<=[一-鿿]{2})[和与及](?=[一-鿿]{2}))\s*"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))


def narrow(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)


def number_part(text: Column, part: int) -> Column:
    """1: the unit, 3: the serial; null where the text holds no whole number."""
    return F.nullif(F.regexp_extract(F.upper(narrow(text)), NUMBER, part), F.lit(""))


def serial(text: Column) -> Column:
    return F.coalesce(number_part(text, 3), F.nullif(F.regexp_extract(narrow(text), SERIAL, 1), F.lit("")))


def heads(message: Column) -> Column:
    """Names, without white space, of the heads of project that a user message gives."""
    lines = F.flatten(F.array(*(F.regexp_extract_all(message, F.lit(HEAD_LINE), F.lit(i)) for i in (1, 2, 3))))
    names = F.flatten(F.transform(lines, lambda x: F.split(x, SEPARATORS)))
    clean = F.transform(names, lambda x: F.regexp_replace(F.lower(narrow(x)), r"[\s　 ​.。:：]+", ""))
    return F.coalesce(F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 2)), F.array().cast("array<string>"))


def large_star(edges: DataFrame, join=join_hot) -> DataFrame:
    """Link every neighbour that is larger than a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join(both.where("v > u"), least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def small_star(edges: DataFrame, join=join_hot) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = join(down, least, "u").select(F.explode(F.array(F.struct("m", F.col("v").alias("x")), F.struct("m", F.col("u").alias("x")))).alias("e"))
    return linked.select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, component) for edges (a, b); the component is its smallest node. Nodes without an edge to another are left out.

    Up to ``few_edges`` edges fit one task whatever their shape, so hubs are only split beyond that.
    """
    now = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    for _ in range(most_rounds):
        join = join_hot if before[0] > few_edges else DataFrame.join
        now = checkpoint(small_star(large_star(now, join), join))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())


def linked_groups(records: DataFrame, id_col: str, entities: str) -> DataFrame:
    """(<id>, component) where ``entities`` is an array<string>; the component is the smallest entity of the group, null without any."""
    rows = checkpoint(records.select(F.col(id_col), F.array_sort(F.array_distinct(F.filter(F.col(entities), lambda x: x.isNotNull()))).alias("es")))
    stars = rows.where(F.size("es") > 1).select("es").distinct()
    edges = stars.select(F.col("es")[0].alias("a"), F.explode(F.slice("es", F.lit(2), F.size("es"))).alias("b"))
    found = components(edges)
    first = rows.select(id_col, F.when(F.size("es") > 0, F.get("es", F.lit(0))).alias("node"))
    return join_hot(first, found, "node", keep=True).select(id_col, F.coalesce("component", "node").alias("component"))


def sample_entities(samples: DataFrame, reports: DataFrame) -> DataFrame:
    """(sample_id, entities): ``0:<unit>`` and ``1:<head>``, so that the smallest entity of a group is its smallest unit.

    The unit is that of the number under which the report is filed; a sample may give the number in another spelling or only
    the serial. Where the report was never filed, the sample's own number counts.
    """
    filed = (
        reports.select(serial(F.col("doc_id")).alias("serial"), number_part(F.col("doc_id"), 1).alias("unit"))
        .where("serial is not null and unit is not null")
        .groupBy("serial")
        .agg(F.collect_set("unit").alias("units"))
    )
    field = lambda name: F.col(f"meta.{name}")
    written = F.coalesce(*(F.when(serial(field(c)).isNotNull(), field(c)) for c in ("doc_id", "safe_doc_id", "seed_stem", "seed_path")))
    user = F.array_join(F.transform(F.filter("messages", lambda m: m.role == "user"), lambda m: F.coalesce(m.content, F.lit(""))), "\n")
    rows = samples.select("sample_id", serial(written).alias("serial"), number_part(written, 1).alias("own"), heads(user).alias("heads"))
    joined = rows.join(filed, "serial", "left")
    units = F.coalesce("units", F.when(F.col("own").isNotNull(), F.array("own")), F.array().cast("array<string>"))
    tag = lambda items, mark: F.transform(items, lambda x: F.concat(F.lit(mark), x))
    return joined.select("sample_id", F.concat(tag(units, "0:"), tag(F.coalesce("heads", F.array().cast("array<string>")), "1:")).alias("entities"))


def sample_groups(samples: DataFrame, reports: DataFrame) -> DataFrame:
    """(sample_id, component, group_key): group_key is the smallest unit code of the group, null where the group has no unit."""
    found = linked_groups(sample_entities(samples, reports), "sample_id", "entities")
    return found.withColumn("group_key", F.when(F.col("component").startswith("0:"), F.substring("component", 3, 99)))


def grouped_split(samples: DataFrame, reports: DataFrame, shares: DataFrame, seed: int = 42, heavy: float = 0.01) -> DataFrame:
    """(sample_id, group_key, split_name): one split per sample, groups never torn.

    A group's identifier is hashed into the ranges of ``shares``. Groups above ``heavy`` of all samples, of which there are at
    most ``1 / heavy``, are placed first, largest first, each where most is lacking; the ranges then cover what is left. So the
    shares come out near their targets even where one unit holds a third of the samples.
    """
    rows = checkpoint(sample_groups(samples, reports).withColumn("unit_of_split", F.coalesce("component", F.concat(F.lit("2:"), F.col("sample_id")))))
    wanted = [(r[0], float(r[1])) for r in shares.select("split_name", "share").where("share > 0").orderBy(F.desc("share"), "split_name").collect()]
    total = rows.count()
    sizes = rows.groupBy("unit_of_split").count()
    large = sizes.where(F.col("count") > max(heavy * total, 1)).orderBy(F.desc("count"), "unit_of_split").collect()
    lack = {name: share * total for name, share in wanted}
    placed = []
    for name, count in large:
        split = max(lack, key=lambda s: (lack[s], s))
        lack[split] -= count
        placed.append((name, split))
    left = {s: max(0.0, x) for s, x in lack.items()}
    whole, at, ranges = sum(left.values()) or 1.0, 0.0, []
    for name, _ in wanted:
        at += left[name] / whole
        ranges.append((name, at))
    draw = uniform("unit_of_split", seed=seed)
    split = F.lit(ranges[-1][0])
    for name, end in reversed(ranges[:-1]):
        split = F.when(draw < end, F.lit(name)).otherwise(split)
    if placed:
        fixed = F.create_map(*(F.lit(x) for pair in placed for x in pair))
        split = F.coalesce(F.try_element_at(fixed, F.col("unit_of_split")), split)
    return rows.select("sample_id", "group_key", split.alias("split_name"))
