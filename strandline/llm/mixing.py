"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.  DataFrame expressions only.

A source's documents, in hashed order, are one stream of words, cut into blocks of equal size.  Its quota
is a whole number of blocks: full passes over the stream, plus the blocks that a permutation puts first.
A binary tree splits the vector of quotas among the output shards: each node hands half of its blocks
left, drawn without replacement, so that every shard's quotas are exact and sum to the sources'.  A shard
takes the blocks that its quotas reach, which no other takes, and shuffles them by an order of its own; what
no shard's quota reaches is not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.text import SPACES, words
from strandline.plans.shared import let, materialize, release

#: Multipliers of the block permutations, all prime; of any three, one at least does not divide a stream's length.
PRIMES = (2654435761, 4294967291, 2147483647)
MOST = 3  #: no word is taken more often


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _ln_factorial(n: Column) -> Column:
    """Natural logarithm of n!: exact below 10, Stirling's series from there on."""
    import math

    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(10)])

    def large(x: Column) -> Column:
        return (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)

    return F.when(n < 10, F.get(small, n.cast("int"))).otherwise(large(F.greatest(n, F.lit(10.0))))


def hypergeometric(good: Column, bad: Column, sample: Column, key: Column, tries: int = 64) -> Column:
    """How many of ``sample`` draws without replacement are good: Stadlober's ratio of uniforms (HRUA), seeded by ``key``.

    Costs the same at every size; each of the ``tries`` accepts with probability over one half.
    """
    inputs = F.struct(good.cast("double").alias("good"), bad.cast("double").alias("bad"), sample.cast("double").alias("sample"), key.alias("key"))

    def derived(x: Column) -> Column:
        total = x["good"] + x["bad"]
        lesser, greater, m = F.least(x["good"], x["bad"]), F.greatest(x["good"], x["bad"]), F.least(x["sample"], total - x["sample"])
        share = lesser / F.greatest(total, F.lit(1.0))
        spread = F.sqrt((total - m) * x["sample"] * share * (1 - share) / F.greatest(total - 1, F.lit(1.0)) + 0.5)
        centre = m * share + 0.5
        return F.struct(
            lesser.alias("lesser"), greater.alias("greater"), m.alias("m"), centre.alias("d6"), (1.7155277699214135 * spread + 0.8989161620588988).alias("d8"),
            F.floor((m + 1) * (lesser + 1) / (total + 2)).cast("double").alias("mode"), F.least(F.least(m, lesser) + 1, F.floor(centre + 16 * spread).cast("double")).alias("d11"),
        )

    def weigh(z: Column, d: Column) -> Column:
        """Minus the logarithm of the probability of z, up to a constant."""
        terms = F.array(z, d["lesser"] - z, d["m"] - z, d["greater"] - d["m"] + z)
        return F.aggregate(terms, F.lit(0.0), lambda a, n: a + _ln_factorial(n))

    def draw(x: Column) -> Column:
        def with_derived(d: Column) -> Column:
            def with_top(top: Column) -> Column:
                def attempt(z: Column, t: Column) -> Column:
                    def judged(p: Column) -> Column:
                        inside = (p["w"] >= 0) & (p["w"] < d["d11"])
                        value = F.floor(F.when(inside, p["w"]).otherwise(0.0)).cast("double")
                        return F.when(inside & (2 * F.log(p["x"]) <= top - weigh(value, d)), value).otherwise(F.lit(-1.0))

                    u = _uniform(x["key"], t, F.lit(0))
                    pair = F.struct(u.alias("x"), (d["d6"] + d["d8"] * (_uniform(x["key"], t, F.lit(1)) - 0.5) / u).alias("w"))
                    return F.when(z >= 0, z).otherwise(let(pair, judged))

                found = F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(-1.0), attempt, lambda z: F.when(z < 0, d["mode"]).otherwise(z))
                found = let(found, lambda z: F.when(x["good"] > x["bad"], d["m"] - z).otherwise(z))
                return F.when(d["m"] < x["sample"], x["good"] - found).otherwise(found)

            return let(weigh(d["mode"], d), with_top)

        sure = F.when((x["good"] == 0) | (x["sample"] == 0), F.lit(0.0)).when(x["bad"] == 0, x["sample"])
        return sure.when(x["sample"] == x["good"] + x["bad"], x["good"]).otherwise(let(derived(x), with_derived))

    return let(inputs, draw).cast("long")


def targets(sizes: DataFrame, block_words: int, least_blocks: int = 200) -> DataFrame:
    """Per (source, source_size): rank, weight, target and its quota of blocks.

    Weights 1, 2, 3 repeat over sources in code-point order, null last.  A target is the lesser of three
    times the source and weight times the level at which all targets sum to all words: the fixed point of
    handing on the excess of capped sources by weight.  One row a source, so its windows run in one task.
    """
    everything = Window.partitionBy(F.lit(0))
    rows = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))))
    rows = rows.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    cap = F.lit(float(MOST)) * F.col("source_size")
    rows = rows.withColumns({"cap": cap, "full": cap / F.col("weight"), "total": F.sum("source_size").over(everything).cast("double")})
    order = everything.orderBy("full", "rank")
    rows = rows.withColumns(
        {
            "place": F.row_number().over(order),
            "capped": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("try", (F.col("total") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("full") >= F.col("try"), F.struct("place", "try"))).over(everything)["try"]
    rows = rows.withColumn("target", F.least(F.col("cap"), F.col("weight") * level))
    size = F.col("source_size")
    rows = rows.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(size / least_blocks))).cast("long"))
    rows = rows.withColumn("n_blocks", F.ceil(size / F.col("block")).cast("long"))
    rows = rows.withColumn("passes", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    rest = F.col("target") - F.col("passes") * size
    rows = rows.withColumn("extra", F.when(F.col("passes") >= MOST, 0).otherwise(F.least(F.col("n_blocks"), F.round(rest / F.col("block")))).cast("long"))
    rows = rows.withColumn("quota", F.col("passes") * F.col("n_blocks") + F.col("extra"))
    return rows.select("source", "rank", "source_size", "weight", "target", "block", "n_blocks", "passes", "extra", "quota")


def _half(numbers: Column, need: Column, key: Column) -> Column:
    """How many of each of ``numbers`` go left when ``need`` of their sum do, drawn without replacement."""

    def split(state: Column, x: Column) -> Column:
        rest = state["rest"] - x["n"]
        drawn = hypergeometric(x["n"], rest, state["need"], F.xxhash64(key, x["i"]))
        return let(drawn, lambda d: F.struct(rest.alias("rest"), (state["need"] - d).alias("need"), F.concat(state["left"], F.array(d)).alias("left")))

    start = F.struct(_sum(numbers).alias("rest"), need.alias("need"), F.array().cast("array<long>").alias("left"))
    return F.aggregate(F.transform(numbers, lambda x, i: F.struct(x.alias("n"), i.alias("i"))), start, split, lambda s: s["left"])


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def shard_quotas(plan: DataFrame, levels: int, seed: int, group: int = 1024) -> DataFrame:
    """(rank, upto): for every source, up to which of its draws each of the 2**levels shards owns them.

    A node of the tree holds its quotas in rows of ``group`` sources.  Its half is first drawn among the rows
    and then, within each, among its sources: the same distribution as one draw over all sources, with no more
    than ``group`` numbers at a time (and as many rows: some million sources).
    """
    rows = plan.select("rank", "quota", F.floor((F.col("rank") - 1) / group).alias("grp"))
    node = rows.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("q")).withColumn("node", F.lit(0).cast("long"))
    one_row = plan.limit(group + 1).count() <= group
    for level in range(levels):
        node = node.withColumn("t", _sum(F.col("q")))
        if one_row:
            node = node.withColumn("need", F.floor(F.col("t") / 2).cast("long"))
        else:
            tops = node.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("grp", "t"))).alias("s")).withColumn("n", F.transform("s", lambda x: x["t"]))
            share = _half(F.col("n"), F.floor(_sum(F.col("n")) / 2).cast("long"), F.xxhash64(F.lit(seed), F.lit(level), F.col("node")))
            tops = tops.select("node", F.explode(F.zip_with("s", share, lambda x, d: F.struct(x["grp"].alias("grp"), d.alias("need")))).alias("h")).select("node", "h.grp", "h.need")
            node = node.join(tops, ["node", "grp"])
        node = node.withColumn("left", _half(F.col("q"), F.col("need"), F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), F.col("grp"))))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")))
        node = materialize(node.select("grp", F.explode(halves).alias("h")).select("grp", "h.node", "h.q"), f"tree-{level}")
    flat = node.select("grp", F.col("node").alias("shard"), F.posexplode("q").alias("at", "n"))
    flat = flat.withColumn("upto", F.sum("n").over(Window.partitionBy("grp", "at").orderBy("shard")))
    return flat.groupBy((F.col("grp") * group + F.col("at") + 1).alias("rank")).agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("upto"))


def _key(id: str, source: str) -> Column:
    """A hash of a row's id and source; with the text's hash it says which rows are alike."""
    return F.xxhash64(F.col(id).cast("long"), F.col(id).isNull(), F.col(source), F.col(source).isNull())


def _place(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, block_words: int = 1024, buckets_log2: int = 10, shards_log2: int = 4) -> tuple[DataFrame, list[DataFrame]]:
    """Every row's place in its source's stream, with the source's plan: (id, key, th, source, size, offset, rank, ...).

    Prefix sums run within ranges of the hashed order (2**buckets_log2 of them a source), then over the
    ranges, so that a source with a third of all rows is spread over that many windows.  Also the tables that
    this reads, to be deleted once it is written.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    th = F.xxhash64(body)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(source).alias("source"), _key(id, source).alias("key"), th.alias("th"), F.size(words(body)).cast("long").alias("size"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), F.coalesce(F.col("id"), F.lit(-1)), F.col("th")))
    rows = materialize(rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - buckets_log2).cast("int")), "sizes")
    plan = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), block_words), "targets")
    made = [rows, plan]
    plan = plan.join(shard_quotas(plan, shards_log2, seed), "rank").drop("weight", "passes", "extra")
    ranges = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    same = ranges["source"].eqNullSafe(plan["source"])
    ranges = ranges.join(plan, same).select(ranges["source"].alias("r_source"), F.col("bucket").alias("r_bucket"), "base", *[c for c in plan.columns if c != "source"])
    own = Window.partitionBy("source", "bucket").orderBy("h", F.asc_nulls_first("id"), "th").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum("size").over(own), F.lit(0)))
    out = rows.join(ranges, rows["source"].eqNullSafe(F.col("r_source")) & (rows["bucket"] == F.col("r_bucket")))
    return out.withColumn("offset", F.col("base") + F.col("local")).drop("r_source", "r_bucket", "base", "local", "h", "bucket"), made


def _permuted(block: Column, n_blocks: Column, passes: Column, key: Column) -> Column:
    """Place of a block in the permutation of one pass; the last block, which may be short, is last in all."""
    n = F.greatest(n_blocks - 1, F.lit(1))
    choices = [F.when(n % F.lit(p) != 0, F.lit(p)) for p in PRIMES]
    prime = F.coalesce(F.element_at(F.array(*choices), (passes % 3 + 1).cast("int")), *choices)
    wide = lambda c: c.cast("decimal(19,0)")
    at = (wide(block) * wide(prime % n) + wide(F.pmod(F.xxhash64(key, passes), n))) % wide(n)
    return F.when(block == n_blocks - 1, n_blocks - 1).otherwise(at.cast("long"))


def draws(placed: DataFrame, seed: int = 1) -> DataFrame:
    """One row per drawn piece: (id, key, th, rank, offset, pass, draw, shard, order_key, start, length).

    ``start`` and ``length`` count words of the row's text; ``draw`` numbers the source's drawn blocks,
    each of which one shard owns; a shard is read by ascending ``order_key``.
    """
    block = F.col("block")
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    rows = placed.where("size > 0 and quota > 0").withColumn("b", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    low = F.greatest(F.col("offset"), F.col("b") * block)
    high = F.least(F.col("offset") + F.col("size"), (F.col("b") + 1) * block)
    rows = rows.withColumns({"start": low - F.col("offset"), "length": high - low})
    at = lambda p: _permuted(F.col("b"), F.col("n_blocks"), p, F.xxhash64(F.lit(seed), F.col("rank")))
    # a block is offered once a pass; it is taken by the shard whose quota of the source reaches its draw, if any does
    offers = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(MOST - 1).cast("long")), lambda p: F.struct(p.alias("pass"), (p * F.col("n_blocks") + at(p)).alias("draw")))
    rows = rows.withColumn("t", F.explode(F.filter(offers, lambda x: x["draw"] < F.element_at("upto", -1)))).withColumn("draw", F.col("t.draw"))
    rows = rows.withColumn("shard", F.size(F.filter("upto", lambda u: u <= F.col("draw"))))
    order = F.xxhash64(F.lit(seed), F.col("shard"), F.col("rank"), F.col("draw"))
    return rows.select("id", "key", "th", "rank", "offset", F.col("t.pass").alias("pass"), "draw", "shard", order.alias("order_key"), "start", "length")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """(placed, drawn): every row of ``docs`` with its source's plan, and the pieces that the mix takes of them.

    Null and empty texts have no words and are never drawn; a null source is a source, the last one; rows
    with a null id, and repeated rows, are rows of their own.  A source's words come within half a block
    (1/400 of the source, or half a word) of its target.  The same rows give the same mix, however they are
    partitioned.  A very long text spans many blocks; an empty table gives empty results; other columns
    are not read.
    """
    rows, made = _place(docs, id, text, source, seed, **sizes)
    placed = materialize(rows, "placed")
    release(*made)
    return placed, draws(placed, seed)


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, placed: bool = False, **sizes: int) -> DataFrame:
    """The mix as rows of ``docs``, shard by shard: a row for the words that a shard takes of one pass over a row.

    Words keep the white space behind them and their order.  Rows lie in runs of one shard, shuffled by the
    shard's own order; a shard is spread over as many tasks as its size asks for.  Columns are those of
    ``docs``; with ``placed``, also ``shard`` and ``order_key`` (which replace columns so named), by which a
    shard is read.  Rows alike in id, source and text share what is drawn of them, numbered in one task.
    """
    _, drawn = mix(docs, id, text, source, seed, **sizes)
    takes = drawn.groupBy("key", "th", "offset", "pass", "shard").agg(F.min("order_key").alias("order_key"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    takes = takes.groupBy("key", "th", "offset").agg(F.collect_list(F.struct("pass", "shard", "order_key", "spans")).alias("takes"))
    takes = takes.groupBy("key", "th").agg(F.transform(F.sort_array(F.collect_list(F.struct("offset", "takes"))), lambda x: x["takes"]).alias("__takes"))
    inner = docs.columns
    rows = docs.withColumns({"__key": _key(id, source), "__th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}).where(F.length(F.btrim(F.col(text), F.lit(SPACES))) > 0)
    takes = takes.withColumnsRenamed({"key": "__key", "th": "__th"})
    rows = rows.join(takes.hint("merge"), ["__key", "__th"])
    # rows alike take their turns in the order of a hash of the whole row; behind the join, this needs no shuffle of its own
    whole_row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not _has_map(f.dataType)])
    rows = rows.withColumn("__twin", F.row_number().over(Window.partitionBy("__key", "__th").orderBy(whole_row)))
    rows = rows.withColumn("__takes", F.get("__takes", F.col("__twin") - 1)).where("__takes is not null")
    own = F.regexp_extract_all(F.ltrim(F.col(text), F.lit(SPACES)), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    total = lambda t: F.aggregate(t["spans"], F.lit(0).cast("long"), lambda a, s: a + s["length"])

    def cut(w: Column) -> Column:
        pieces = lambda t: F.flatten(F.transform(t["spans"], lambda s: F.slice(w, s["start"].cast("int") + 1, s["length"].cast("int"))))
        part = lambda t: F.when(total(t) == F.size(w), F.col(text)).otherwise(F.array_join(pieces(t), ""))
        return F.transform("__takes", lambda t: F.struct(t["shard"].alias("shard"), t["order_key"].alias("order_key"), t["pass"].alias("pass"), part(t).alias("text")))

    rows = rows.withColumn("__take", F.explode(let(own, cut))).drop("__takes")
    rows = rows.withColumns({text: F.col("__take.text"), "__shard": F.col("__take.shard"), "__order": F.col("__take.order_key"), "__pass": F.col("__take.pass")}).drop("__take")
    rows = rows.repartition("__shard", F.shiftrightunsigned("__order", 48)).sortWithinPartitions("__shard", "__order", "__key", "__th", "__twin", "__pass")
    if not placed:
        return rows.select(*[f"`{c}`" for c in inner])
    return rows.select(*[f"`{c}`" for c in inner if c not in ("shard", "order_key")], F.col("__shard").alias("shard"), F.col("__order").alias("order_key"))


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The mix as one folder a shard (``shard=0`` ...), every file in the shard's order."""
    mixed_documents(docs, placed=True, **options).write.partitionBy("shard").parquet(path)
