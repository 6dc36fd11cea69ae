"""Mixing sources to target weights by hierarchical budgeting.

Sources stand in a tree domain - language - source.  A total budget goes down the tree by weight; a
node that cannot use its part (its texts, each repeated at most ``max_repeats`` times, hold fewer
tokens) hands the rest to its siblings by weight, and only what the siblings cannot take goes up to
the ancestors.  Each leaf then takes the token-prefix of its seeded epochs: every epoch holds each of
the leaf's texts once, in an order drawn from the seed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from math import fsum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut

#: The setting that names the tokenizer's vocabulary file, and the file where it is not set.
TOKENIZER_SETTING, TOKENIZER = "spark.docloom.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bounds of the plan kept on the driver: targets rows, and (source, language) leaves.
MOST_LEAVES = 1_000_000
#: A leaf's order is cut into blocks of about so many texts; running totals are kept per block.
BLOCK_TEXTS = 20_000
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@cache
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens): sizes in tokens of a public tokenizer, over whole texts.

    The vocabulary file, on the driver or in a folder that Spark can read, is sent to the workers.
    """
    path = tokenizer or docs.sparkSession.conf.get(TOKENIZER_SETTING, TOKENIZER)
    docs.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokens"])

    return docs.mapInArrow(run, "doc_id long, source string, lang string, tokens long")


def normal_source(source: Column) -> Column:
    """A source's name in one spelling: small, trimmed, blanks and hyphens as underscores; '' stays null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_"), F.lit(""))


def allot(budget: float, weights: dict, room: dict) -> dict:
    """``budget`` over children by weight, none above its room; shortages go to the siblings, by weight.

    Water-filling: the children that would overflow are filled and the rest is shared out anew.  What
    no sibling can take is left over (the caller's ancestors see to it).
    """
    given = {k: 0.0 for k in weights}
    open_ = {k for k, w in weights.items() if w > 0 and room[k] > 0}
    left = min(budget, fsum(room[k] for k in open_))
    while open_ and left > 0:
        total = fsum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total >= room[k]}
        if not full:
            return given | {k: left * weights[k] / total for k in open_}
        given |= {k: room[k] for k in full}
        left -= fsum(room[k] for k in full)
        open_ -= full
    return given


def plan(leaves: list[dict], budget: float | None) -> tuple[float, list[dict]]:
    """Token budgets of leaves (domain, lang, source, weight, room), and the budget used.

    Without ``budget`` it is the largest total that meets every weight that has texts without a shortage.
    """
    key = lambda leaf, n: (leaf["domain"], leaf["lang"], leaf["source"])[:n]
    weight: dict = defaultdict(float)
    room: dict = defaultdict(float)
    below: dict = defaultdict(set)
    for leaf in leaves:
        for n in range(4):
            weight[key(leaf, n)] += leaf["weight"]
            room[key(leaf, n)] += leaf["room"] if leaf["weight"] > 0 else 0
            if n:
                below[key(leaf, n - 1)].add(key(leaf, n))
    if budget is None:
        budget = min((leaf["room"] / leaf["weight"] for leaf in leaves if leaf["weight"] > 0 and leaf["room"] > 0), default=0.0) * fsum(x["weight"] for x in leaves)
    given: dict = {(): min(float(budget), room[()])}

    def down(node: tuple) -> None:
        children = sorted(below[node])
        given.update(allot(given[node], {c: weight[c] for c in children}, {c: room[c] for c in children}))
        for child in children:
            if len(child) < 3:
                down(child)

    down(())
    return given[()], [leaf | {"budget": given.get(key(leaf, 3), 0.0)} for leaf in leaves]


def mixture(docs: DataFrame, targets: DataFrame, budgets: dict[str, float] | None = None, budget_share: float | None = None, domains: dict[str, str] | None = None, seed: int = 17, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn texts (mix_name, doc_id, source, lang, tokens, times) and the report of shares.

    The report has (mix_name, source, target_share, available_tokens, budget_tokens, drawn_tokens,
    actual_share, documents, max_times), a row for every target, also of sources without texts.
    A source's share is split among its languages by the tokens they have.  ``domains`` names a
    source's domain (all in one by default); ``budgets`` a mix's total in tokens, ``budget_share`` the
    total of the other mixes as a share of all tokens of the corpus; without either it is the largest
    total that needs no source more often than its repeats allow.

    Texts without target are not drawn.  Null and empty texts have no tokens and are not drawn; null
    sources match no target; null ids are kept out; repeated targets count once (the largest share);
    null or negative shares and repeats count as 0.  A share is a weight, so they need not add to one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_source(F.col("source")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text").where("doc_id is not null")
    # Sizes once, then texts are never touched again.
    sized = cut(token_counts(rows, tokenizer).where("tokens > 0 and source is not null"))
    goals = targets.select("mix_name", normal_source(F.col("source")).alias("source"), F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("repeats"))
    goals = goals.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.max(F.struct("share", "repeats")).alias("g")).selectExpr("mix_name", "source", "g.share", "g.repeats")
    whole = budget_share and budget_share * (sized.agg(F.sum("tokens")).first()[0] or 0)
    totals = sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    found = goals.join(totals, "source", "left").limit(MOST_LEAVES + 1).collect()  # a row per target and language: bounded
    if len(found) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    per_source: dict = defaultdict(float)
    for r in found:
        per_source[r.mix_name, r.source] += r.tokens or 0
    leaves_by_mix: dict = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.mix_name, r.source, r.lang or "")):
        part = (r.tokens or 0) / per_source[r.mix_name, r.source] if per_source[r.mix_name, r.source] else 0.0
        leaves_by_mix[r.mix_name].append({"mix_name": r.mix_name, "domain": (domains or {}).get(r.source, ""), "lang": r.lang or "", "source": r.source, "share": r.share, "weight": r.share * part, "room": float((r.tokens or 0) * r.repeats), "tokens": r.tokens or 0, "repeats": r.repeats, "bits": max(1, ((r.documents or 0) // BLOCK_TEXTS).bit_length())})
    planned = [leaf for mix, leaves in sorted(leaves_by_mix.items()) for leaf in plan(leaves, (budgets or {}).get(mix, whole))[1]]
    fields = ["mix_name", "source", "lang", "share", "tokens", "repeats", "bits", "budget"]
    kind = "mix_name string, source string, lang string, share double, tokens long, repeats int, bits int, budget double"
    table = spark.createDataFrame([tuple(leaf[f] for f in fields) for leaf in planned], kind)

    # Every text is drawn floor(budget / leaf tokens) times; the last epoch is drawn in part: the prefix,
    # in the epoch's seeded order, that comes nearest to the rest.  Running totals come from
    # block sums, so that a leaf of a third of all rows is not one task's sort.
    wanted = table.where("budget > 0").selectExpr("mix_name", "source", "lang", "repeats", "bits", "budget", "cast(floor(budget / tokens) as int) as whole", "budget - floor(budget / tokens) * tokens as rest")
    wanted = F.broadcast(wanted)  # at most MOST_LEAVES rows, checked above
    epochs = sized.join(wanted, ["source", "lang"]).withColumn("place", F.xxhash64(F.lit(seed), "mix_name", "whole", "doc_id"))
    epochs = epochs.withColumn("block", F.expr("shiftrightunsigned(place, 64 - bits)"))  # the first bits of the order, by the leaf's size
    sums = epochs.groupBy("mix_name", "source", "lang", "block").agg(F.sum("tokens").alias("in_block"))
    over = Window.partitionBy("mix_name", "source", "lang").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("in_block").over(over), F.lit(0))).select("mix_name", "source", "lang", "block", "before")
    order = Window.partitionBy("mix_name", "source", "lang", "block").orderBy("place", "doc_id")
    drawn = epochs.join(before, ["mix_name", "source", "lang", "block"]).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    drawn = drawn.withColumn("times", F.least(F.col("repeats"), F.col("whole") + (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))).where("times > 0").select("mix_name", "doc_id", "source", "lang", "tokens", "times")
    drawn = cut(drawn)
    got = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("drawn_tokens"), F.count("*").alias("documents"), F.max("times").alias("max_times"))
    per = table.groupBy("mix_name", "source").agg(F.max("share").alias("target_share"), F.sum("tokens").alias("available_tokens"), F.sum("budget").alias("budget_tokens"))
    report = per.join(got, ["mix_name", "source"], "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
    all_tokens = F.sum("drawn_tokens").over(Window.partitionBy("mix_name"))
    report = report.select("mix_name", "source", "target_share", "available_tokens", "budget_tokens", "drawn_tokens", F.when(all_tokens > 0, F.col("drawn_tokens") / all_tokens).otherwise(0.0).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_times", F.lit(0)).alias("max_times"))
    return drawn, report
