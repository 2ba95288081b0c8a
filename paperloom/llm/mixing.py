"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer, whose file is a parameter. The budget is handed down a tree of domains, languages and sources:
a node's weight is the sum of its leaves', a leaf's the target share of its source, divided over the source's languages by their
tokens. Where a leaf can't fill its budget even when its documents are repeated as often as allowed, what is short goes to its
siblings first, and to the next level up only as far as they can't take it. A leaf then takes whole seeded epochs, and of the last
one a prefix: documents in an order drawn anew per epoch, up to the budget in tokens.

The prefix is found without sorting a leaf in one task: documents fall into buckets of the drawn order, bucket sums decide which
buckets are taken whole, and only the bucket in which the budget ends is ordered. So a source of a third of all documents is spread like any
other. The tree has as many leaves as there are combinations of domain, language and source with a target, a small table.

By default the mix is the largest in which every source with documents has its share. With ``total_tokens`` it has that size, and
shares give way where a source is too small; the report tells both.

Defined results: documents without text have 0 tokens and are not taken. Null, unknown and untargeted sources are not taken. A null
``max_repeat`` is 1. A source without documents gets nothing, its share goes to the others. Repeated texts under other ids are
other documents. Empty tables give an empty mix.
"""

from __future__ import annotations

import base64
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint
from .batches import map_rows

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that the tokenizer's vocabulary is defined over.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Domains of sources; others are a domain of their own. A parameter.
DOMAINS = {"journal": "published", "bulletin": "published", "handbook": "published", "translation": "published", "lesson_plan": "school", "school_site": "school", "case_file": "school", "interview": "spoken", "forum": "spoken"}
BUCKETS = 4096


def language(lang: Column) -> Column:
    """One spelling per language: the primary subtag, of two or three letters, in lower case; ``und`` for whatever else is written."""
    plain = F.lower(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    return F.when(plain.isin("chinese", "zho", "chi", "cmn"), "zh").when(plain.isin("english", "eng"), "en").when(F.length(plain).between(2, 3), plain).otherwise("und")


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, lang, source, tokens). The vocabulary's file is read here and broadcast (1 MB), so executors need no copy of it."""
    with open(tokenizer, "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})

    def start():
        import tiktoken

        encode = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        return lambda doc_id, lang, source, text: ((doc_id, lang, source, len(encode(text))),)

    rows = documents.select(F.col("doc_id").cast("bigint"), language(F.col("lang")), "source", "text").where("source is not null and length(text) > 0")
    return map_rows(rows, "doc_id bigint, lang string, source string, tokens bigint", start)


def budgets(leaves: list[tuple[tuple[str, ...], float, float]], total: float) -> dict[tuple[str, ...], float]:
    """Budget per leaf for (path, weight, capacity); shortages go to siblings before ancestors."""
    children: dict[tuple, set] = defaultdict(set)
    weight: dict[tuple, float] = defaultdict(float)
    room: dict[tuple, float] = defaultdict(float)
    for path, w, c in leaves:
        for k in range(len(path) + 1):
            weight[path[:k]] += w
            room[path[:k]] += c
            if k:
                children[path[: k - 1]].add(path[:k])
    given: dict[tuple, float] = {}

    def hand_down(node: tuple, amount: float) -> None:
        if node not in children:
            given[node] = min(amount, room[node])
            return
        rest, open_, share = min(amount, room[node]), sorted(children[node]), {}
        while open_:
            whole = sum(weight[c] for c in open_)
            part = {c: rest * (weight[c] / whole if whole else 1 / len(open_)) for c in open_}
            full = [c for c in open_ if part[c] >= room[c]]
            if not full:
                share |= part
                break
            for c in full:
                share[c] = room[c]
                rest -= room[c]
            open_ = [c for c in open_ if c not in full]
        for c, x in share.items():
            hand_down(c, max(0.0, x))

    if leaves:
        hand_down((), total)
    return given


def corpus_tokens(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> int:
    """The tokens of all documents whose source has a target."""
    wanted = targets.where("source is not null and target_share > 0").select("source").distinct()
    return with_tokens(documents.join(F.broadcast(wanted), "source", "left_semi"), tokenizer).agg(F.sum("tokens")).first()[0] or 0


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """(doc_id, source, lang, tokens, copies): the documents of the mix and how often each is used."""
    spark = documents.sparkSession
    wanted = {r[0]: (float(r[1]), max(0, r[2] if r[2] is not None else 1)) for r in targets.select("source", "target_share", "max_repeat").where("source is not null and target_share > 0").collect()}
    counted = checkpoint(with_tokens(documents.where(F.col("source").isin(list(wanted))), tokenizer).where("tokens > 0"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "epoch", "doc_id"), F.lit(BUCKETS)).cast("int")
    sizes = {(r[0], r[1]): int(r[2]) for r in counted.groupBy("lang", "source").agg(F.sum("tokens")).collect()}
    of_source: dict[str, int] = defaultdict(int)
    for (_, source), n in sizes.items():
        of_source[source] += n
    leaves = [((domains.get(s, s), lang, s), wanted[s][0] * n / of_source[s], float(n * wanted[s][1])) for (lang, s), n in sizes.items()]
    present = sum(wanted[s][0] for s in of_source)
    if total_tokens is None:
        total_tokens = min((of_source[s] * wanted[s][1] * present / wanted[s][0] for s in of_source if wanted[s][1]), default=0)
    given = budgets(leaves, float(total_tokens))
    plan = []
    for (_, lang, source), budget in sorted(given.items()):
        size = sizes[lang, source]
        epochs = min(int(budget // size), wanted[source][1]) if size else 0
        rest = int(budget - epochs * size) if epochs < wanted[source][1] else 0
        plan.append((lang, source, epochs, rest))
    leaf = spark.createDataFrame(plan, "lang string, source string, epoch int, rest bigint")
    rows = counted.join(F.broadcast(leaf), ["lang", "source"]).withColumn("bucket", bucket)
    sums = rows.groupBy("lang", "source", "bucket").agg(F.sum("tokens").alias("size"))
    upto = sums.withColumn("before", F.sum("size").over(Window.partitionBy("lang", "source").orderBy("bucket")) - F.col("size")).select("lang", "source", "bucket", "before", "size")
    placed = rows.join(upto, ["lang", "source", "bucket"])
    whole = placed.where("before + size <= rest").select("doc_id", "source", "lang", "tokens", (F.col("epoch") + 1).alias("copies"))
    cut = placed.where("before + size > rest and before < rest")
    order = Window.partitionBy("lang", "source", "bucket").orderBy(F.xxhash64(F.lit(seed), "doc_id", "epoch"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.withColumn("sum", F.col("before") + F.sum("tokens").over(order)).select("doc_id", "source", "lang", "tokens", (F.col("epoch") + F.when(F.col("sum") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    beyond = placed.where("before >= rest").select("doc_id", "source", "lang", "tokens", F.col("epoch").alias("copies"))
    return whole.unionByName(last).unionByName(beyond).where("copies > 0")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies) for every source with a target."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("total"))
    joined = targets.select("source", "target_share").join(got, "source", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = F.when(zero(F.col("total")) > 0, F.round(zero(F.col("tokens")) / F.col("total"), 6)).otherwise(F.lit(0.0))
    return joined.select("source", "target_share", share.alias("actual_share"), zero(F.col("tokens")).alias("tokens"), zero(F.col("documents")).alias("documents"), zero(F.col("most_copies")).alias("most_copies"))
