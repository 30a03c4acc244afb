"""Similar accounts, recurring combinations of details, links between records and a flat picture of accounts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations as combinations_of

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.selection import matched_pairs
from corvane.storage import dealt, written

# Shared core and behaviour details of a pair, bars of a match and of a link, details of a link.
SHARED_CORE, SHARED_BEHAVIOUR, MATCH, LINK, LINK_DETAILS = 2, 1, 5.0, 7.5, 3
# Fixed value: bar of a pair when two records are compared.
COMPARED = 4.0
# Tags that accounts meet in at once, their tuples for each tag of the table; pairs of two records that are made at one bar, else
# its steps. They decide the cost alone.
LONGEST, TUPLES, FEW_PAIRS, STEP = 4, 16, 2_000_000, 0.85
# Combinations that a task counts at a time.
MOST_HELD = 2_000_000
# Details of an account that count, accounts, records and lift of a type, weight of a triple.
HEAVIEST, TYPE_ACCOUNTS, TYPE_RECORDS, TYPE_LIFT, TRIPLE = 10, 6, 3, 1.6, 1.2
# Share of a type's accounts that makes a detail part of its description, years that make a link distant.
ALSO, YEARS_APART = 0.25, 15


def tag_weights(tags: DataFrame, record: str, tag: str, scale: Column | float = 1.0, digits: int | None = None) -> DataFrame:
    """scale * ln(max(n, 2) / df) of each tag."""
    rows = tags.select(record, tag).distinct()
    n = rows.agg(F.countDistinct(record).alias("n"))
    df = rows.groupBy(tag).agg(F.count("*").alias("df"))
    w = F.log(F.greatest("n", F.lit(2)) / F.col("df")) * scale
    return df.join(F.broadcast(n)).select(tag, "df", (w if digits is None else F.bround(w, digits)).alias("w"))


def weighted_tags(tags: DataFrame, record: str, tag: str, weights: DataFrame) -> DataFrame:
    return tags.join(weights.select(tag, "w"), tag)


def _reaching(own: Column, k: int, least: float) -> Column:
    """Hashes of the k-tuples of an account's tags that can be the heaviest k it shares with another one.

    own: its tags as (tag, w, after: weight from this one on), in the order that all accounts follow. A pair's heaviest shared
    tags are a tuple of both accounts, and what each has from the last of them on must lift their weight to `least`.
    """

    def longer(head: tuple[Column, ...], weight: Column, from_: Column) -> Column:
        left = k - len(head) - 1
        items = F.slice(own, from_, F.greatest(F.size(own) - from_ + 1 - left, F.lit(0)))
        items = F.filter(items, lambda x: weight + x["after"] >= least - 1e-9)
        if not left:
            return F.transform(items, lambda x: F.xxhash64(*head, x["tag"]))
        return F.flatten(F.transform(items, lambda x, i: longer((*head, x["tag"]), weight + x["w"], from_ + i + 1)))

    return longer((), F.lit(0.0), F.lit(1))


def _tuple_length(weighted: DataFrame, record: str, tag: str, shared: int, least: float) -> tuple[int, int]:
    """How many tags a pair surely shares, as far as TUPLES allows, and the number of tuples: linear in the tags."""
    heaviest = [r["w"] for r in weighted.groupBy(tag).agg(F.max("w").alias("w")).orderBy(F.desc("w")).limit(LONGEST).collect()]
    needed = next((i for i in range(1, len(heaviest) + 1) if sum(heaviest[:i]) >= least - 1e-9), LONGEST)
    m = weighted.groupBy(record).agg(F.count("*").cast("double").alias("m"))
    ways = lambda k: reduce(lambda x, i: x * (F.col("m") - i) / (i + 1), range(k), F.lit(1.0))
    sums = m.agg(*[F.sum(F.greatest(ways(k), F.lit(0.0))).alias(str(k)) for k in range(1, LONGEST + 1)]).first()
    counts = [v or 0.0 for v in sums]
    k = max(i for i in range(1, LONGEST + 1) if i == 1 or (i <= max(shared, needed) and counts[i - 1] <= TUPLES * counts[0]))
    return k, int(counts[k - 1])


def similar_pairs(tags: DataFrame, record: str, tag: str, series: str, shared: int = SHARED_CORE, least: float = MATCH,
                  core: Column | None = None, behaviour: Column | None = None, owner: str | None = None,
                  weights: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of different series (and owners) whose score, evidence times cosine, reaches `least`.

    Weights are those of the tags at hand where none are given. core and behaviour, conditions on tags, say
    which shared ones are counted against `shared` and SHARED_BEHAVIOUR.
    """
    return pairs_reaching(tagged_accounts(tags, record, tag, series, core, behaviour, owner, weights), record, tag, series, shared, least)


def tagged_accounts(tags: DataFrame, record: str, tag: str, series: str, core: Column | None = None, behaviour: Column | None = None,
                    owner: str | None = None, weights: DataFrame | None = None) -> DataFrame:
    """The written table of tags with their weights that `pairs_reaching` reads."""
    rows = tags.select(record, tag, series, F.col(owner or series).alias("_owner"), (F.lit(True) if core is None else core).alias("_core"), (F.lit(True) if behaviour is None else behaviour).alias("_beh")).distinct()
    rows = written(rows, "account_tags")
    n = rows.count()
    weights = tag_weights(dealt(rows, record, rows=n), record, tag) if weights is None else weights
    return written(weighted_tags(dealt(rows, tag, rows=n), record, tag, dealt(weights, tag, rows=n)), "weighted_tags")


def pairs_reaching(weighted: DataFrame, record: str, tag: str, series: str, shared: int, least: float) -> DataFrame:
    """(a, b, n_shared, score) of the pairs that reach `least`, written.

    Evidence is the weight of the shared tags and bounds the score, as a cosine is at most one. Accounts meet in the heaviest
    tags they share, several at a time (as many as a pair surely shares), if these and the lighter ones can make up `least`:
    a tag that many accounts have is no key on its own. Pairs that met are then scored with all their tags.
    """
    k, tuples = _tuple_length(weighted, record, tag, shared, least)
    placed = dealt(weighted, record)
    own = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), F.col(tag).alias("tag"))))
    accounts = placed.groupBy(record, series, "_owner").agg(own.alias("own"), F.sum("w").alias("_e")).filter((F.col("_e") >= least - 1e-9) & (F.size("own") >= k))
    weight = lambda x: -x["o"]
    after = lambda x, i: F.aggregate(F.slice("own", i + 1, F.size("own")), F.lit(0.0), lambda s, y: s + weight(y))
    accounts = accounts.withColumn("own", F.transform("own", lambda x, i: F.struct(x["tag"].alias("tag"), weight(x).alias("w"), after(x, i).alias("after"))))
    keys = accounts.select(record, series, "_owner", F.explode(_reaching(F.col("own"), k, least)).alias("_k"))
    keys = dealt(keys, "_k", rows=tuples)
    side = lambda x: keys.select("_k", F.col(record).alias(x), *[F.col(c).alias(c + x) for c in (series, "_owner")])
    met = side("a").join(side("b"), "_k").filter((F.col("a") < F.col("b")) & (F.col(series + "a") != F.col(series + "b")) & (F.col("_ownera") != F.col("_ownerb")))
    near = written(met.select("a", "b").distinct(), "near_pairs")
    ends = near.select(F.explode(F.array("a", "b")).alias(record)).distinct()
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(record)))
    # Few accounts are left: their ids are the hashed side, so that the tags of all accounts need no sorting.
    full = written(placed.join(ends.hint("shuffle_hash"), record, "left_semi").withColumn("_norm", norm), "near_tags")
    left = dealt(near, "a").join(full.select(F.col(record).alias("a"), tag, "w", "_core", "_beh", F.col("_norm").alias("na")), "a")
    both = left.join(full.select(F.col(record).alias("b"), tag, F.col("_norm").alias("nb")), ["b", tag])
    scored = both.groupBy("a", "b").agg(
        F.count_if(F.col("_core")).alias("n_shared"), F.count_if(F.col("_beh")).alias("_b"), F.sum("w").alias("e"),
        F.sum(F.col("w") * F.col("w")).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb"),
    )
    score = F.when(F.col("na") * F.col("nb") > 0, F.col("e") * F.col("d") / (F.col("na") * F.col("nb"))).otherwise(0.0)
    scored = scored.withColumn("score", score)
    enough = (F.col("n_shared") >= shared) & (F.col("_b") >= SHARED_BEHAVIOUR) & (F.col("score") >= least)
    return written(scored.filter(enough).select("a", "b", "n_shared", "score"), "similar_pairs")


def compared_records(tags: DataFrame, account: str, record: str, tag: str, a: object, b: object, least: float = COMPARED, most: int = 8) -> DataFrame:
    """Accounts of two records matched one to one by falling score (to nine digits), weighted by the tags of all records.

    A pick depends on higher scores only. So where the records are large, pairs are made from the highest possible score
    downward, a part of it at a time, until there are `most` picks or `least` is reached. Fewer picks than `most` at a bar mean that
    all pairs above it hold one of the picked accounts, so those passed over are few for each account.
    """
    weights = tag_weights(tags, account, tag)
    own = tagged_accounts(tags.filter(F.col(record).isin(a, b)), account, tag, record, weights=weights)
    side = written(own.select(F.col(account).alias("a"), (F.col(record) == F.lit(a)).alias("_first")).distinct(), "sides")
    sums = own.groupBy(record, account).agg(F.sum("w").alias("e")).groupBy(record).agg(F.max("e").alias("e"), F.count("*").alias("n")).collect()
    bar = min((r["e"] for r in sums), default=least)
    if math.prod(r["n"] for r in sums) <= FEW_PAIRS:
        bar = least
    while True:
        bar = max(least, STEP * bar) if bar > least else least
        pairs = pairs_reaching(own, account, tag, record, SHARED_CORE, bar - 1e-8).withColumn("score", F.bround("score", 9)).filter(F.col("score") >= bar)
        turned = pairs.join(side, "a").select(
            F.when(F.col("_first"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("_first"), F.col("b")).otherwise(F.col("a")).alias("b"), "score"
        )
        picked = written(matched_pairs(turned, most), "compared")
        if bar <= least or picked.count() >= most:
            return picked


def top_partners(pairs: DataFrame, k: int = 6) -> DataFrame:
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_per_group(pairs: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """(ga, gb, n, best, a, b) of pairs by their unordered groups: the best pair, the first by ids on ties."""
    first = F.min_by(F.struct("a", "b"), F.struct(-F.col("score"), F.col("a"), F.col("b")))
    out = pairs.groupBy(F.least(group_a, group_b).alias("ga"), F.greatest(group_a, group_b).alias("gb"))
    return out.agg(F.count("*").alias("n"), F.max("score").alias("best"), first.alias("_p")).select("ga", "gb", "n", "best", "_p.a", "_p.b")


def combinations(tags: DataFrame, defining: Sequence[str], behaviour: Sequence[str], weak: Sequence[str] = (),
                 contradictions: Mapping[str, Sequence[str]] | None = None, accounts: int = TYPE_ACCOUNTS,
                 records: int = TYPE_RECORDS, lift: float = TYPE_LIFT, heaviest: int = HEAVIEST) -> DataFrame:
    """Pairs and triples of details that recur in more accounts than their shares suggest.

    tags (account, record, tag, dim, w), each tag of an account once. Only an account's heaviest tags count; the
    dimensions of a combination differ, one is a behaviour and one defines (weak tags do not); an account that also has a tag
    that contradicts one of the combination is no member. Result: t1, t2, t3 (null in pairs), m accounts, r records,
    lift, score.
    """
    heaviness = F.struct((-F.col("w")).alias("o"), "tag", "dim")
    kept = tags.groupBy("account").agg(F.first("record").alias("record"), F.array_sort(F.collect_list(heaviness)).alias("all"))
    kept = written(kept.select("record", F.slice("all", 1, heaviest).alias("sig"), F.col("all")["tag"].alias("every")), "accounts")
    spark, n = tags.sparkSession, kept.count()
    seen = kept.select(F.explode("sig").alias("x")).groupBy("x.tag", "x.dim").agg(F.count("*").alias("p"))
    seen = written(seen, "details")
    p = seen.groupBy("tag").agg(F.sum("p").alias("p"))
    items = [(r["tag"], r["dim"]) for r in seen.filter("dim is not null").orderBy("tag", "dim").collect()]  # one row for each tag of the lexicon
    member = lambda x: x["dim"].isNotNull()
    if contradictions:
        against = F.create_map(*[c for t, others in contradictions.items() for c in (F.lit(t), F.array(*map(F.lit, others)))])
        member = lambda x: x["dim"].isNotNull() & ~F.coalesce(F.arrays_overlap("every", F.try_element_at(against, x["tag"])), F.lit(False))
    own = F.transform(F.filter("sig", member), lambda x: F.concat(x["tag"], F.lit("\0"), x["dim"]))
    held = kept.select("record", own.alias("own"))
    made = _Combinations(items, defining, behaviour, weak, heaviest)
    codes = held.select("own").mapInArrow(made.count, "code long, k long").groupBy("code").agg(F.sum("k").alias("m")).filter(F.col("m") >= accounts)
    names = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(items)] or [(0, None)], "_i long, _t string")
    base = F.lit(made.base)
    digit = [F.expr(f"code div {made.base * made.base}"), F.expr(f"code div {made.base}") % base, F.col("code") % base]
    counted = codes
    for k, d in enumerate(digit, 1):
        counted = counted.withColumn("_i", d).join(names.withColumnRenamed("_t", f"tag{k}"), "_i", "left").drop("_i")
        counted = counted.join(p.select(F.col("tag").alias(f"tag{k}"), F.col("p").alias(f"p{k}")), f"tag{k}", "left")
    expected = F.col("p1") * F.col("p2") / F.lit(n)
    expected = F.when(F.col("tag3").isNull(), expected).otherwise(expected * F.col("p3") / F.lit(n))
    found = written(counted.withColumn("lift", F.col("m") / expected).filter(F.col("lift") >= lift), "combinations")
    # Records are counted for the combinations that are left.
    wanted = spark.sparkContext.broadcast(np.array(sorted(r["code"] for r in found.select("code").collect()), np.int64))
    kind = held.schema["record"].dataType.simpleString()
    pairs = held.mapInArrow(made.records(wanted), f"code long, record {kind}").distinct()
    spread = pairs.groupBy("code").agg(F.count("*").alias("r")).filter(F.col("r") >= records)
    score = F.log("lift") * F.col("r") * F.when(F.col("tag3").isNull(), 1.0).otherwise(TRIPLE)
    return found.join(spread, "code").select(F.col("tag1").alias("t1"), F.col("tag2").alias("t2"), F.col("tag3").alias("t3"), "m", "r", "lift", score.alias("score"))


class _Combinations:
    """Pairs and triples of an account's details as numbers: three digits, places in the ordered lexicon; a pair ends in `base` - 1."""

    def __init__(self, items: Sequence[tuple[str, str]], defining: Sequence[str], behaviour: Sequence[str], weak: Sequence[str], heaviest: int):
        self.names, self.base, self.heaviest = [f"{t}\0{d}" for t, d in items], len(items) + 1, heaviest
        if self.base**3 >= 2**63:
            raise ValueError(f"{len(items)} details are too many to number their triples")
        dims = {d: i for i, d in enumerate(sorted({d for _, d in items}))}
        self.dim = np.array([dims[d] for _, d in items] + [-1], np.int32)
        self.defines = np.array([d in defining and t not in weak for t, d in items] + [False])
        self.behaves = np.array([d in behaviour for _, d in items] + [False])

    def _made(self, own: pa.ListArray, names: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and combinations that they hold, a choice of places at a time."""
        none, n = self.base - 1, len(own)
        flat = pc.index_in(own.flatten(), value_set=names).to_numpy(zero_copy_only=False)
        sizes = np.diff(own.offsets.to_numpy())
        rows = np.repeat(np.arange(n), sizes)
        table = np.full((n, self.heaviest), none, np.int64)
        table[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        table.sort(axis=1)
        cols = [table[:, i] for i in range(min(self.heaviest, int(sizes.max(initial=0))))]
        for i, j in combinations_of(range(len(cols)), 2):
            at = np.flatnonzero((cols[j] < none) & (self.dim[cols[i]] != self.dim[cols[j]]))
            x, y = cols[i][at], cols[j][at]
            head, d, b = (x * self.base + y) * self.base, self.defines[x] | self.defines[y], self.behaves[x] | self.behaves[y]
            ok = d & b
            yield at[ok], head[ok] + none
            for z in (c[at] for c in cols[j + 1 :]):
                ok = (z < none) & (self.dim[z] != self.dim[x]) & (self.dim[z] != self.dim[y]) & (d | self.defines[z]) & (b | self.behaves[z])
                yield at[ok], head[ok] + z[ok]

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(code, k): how many rows hold a combination, summed over a task as far as MOST_HELD combinations go."""
        names, codes, counts = pa.array(self.names, pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            found = [c for _, c in self._made(batch["own"], names)]
            if not found:
                continue
            new, k = np.unique(np.concatenate(found), return_counts=True)
            codes, where = np.unique(np.concatenate((codes, new)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, k)), len(codes)).astype(np.int64)
            if len(codes) > MOST_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "k"])
                codes, counts = codes[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "k"])

    def records(self, wanted: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """(code, record) of the wanted combinations, once a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, chosen = pa.array(self.names, pa.string()), wanted.value
            for batch in batches:
                if not len(chosen):
                    continue
                coded = batch["record"].dictionary_encode()
                which = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                held = []
                for rows, codes in self._made(batch["own"], names):
                    at = np.searchsorted(chosen, codes)
                    at[at == len(chosen)] = 0
                    hit = chosen[at] == codes
                    held.append(np.unique(at[hit] * (len(coded.dictionary) + 1) + which[rows[hit]]))
                if held:
                    both = np.unique(np.concatenate(held))
                    at, record = np.divmod(both, len(coded.dictionary) + 1)
                    index = pa.array(record, mask=record == len(coded.dictionary))
                    yield pa.RecordBatch.from_arrays([pa.array(chosen[at]), coded.dictionary.take(index)], ["code", "record"])

        return run


def type_members(types: DataFrame, tags: DataFrame) -> DataFrame:
    """(type, account) for types (type, items): accounts that have all items."""
    wanted = types.select("type", F.size("items").alias("_n"), F.explode("items").alias("tag"))
    hits = tags.select("account", "tag").distinct().join(F.broadcast(wanted), "tag")
    return hits.groupBy("type", "account", "_n").agg(F.count("*").alias("_k")).filter("_k = _n").select("type", "account")


def type_descriptions(types: DataFrame, members: DataFrame, tags: DataFrame, accounts: DataFrame, k: int = 8) -> DataFrame:
    """type, size, records, first_year, last_year, and what its accounts also report: (detail, share) of the k most
    frequent other details with at least ALSO of the accounts. accounts (account, record, year)."""
    rows = members.join(accounts, "account")
    sizes = rows.groupBy("type").agg(F.count("*").alias("size"), F.countDistinct("record").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    own = types.select("type", F.explode("items").alias("tag"))
    other = members.join(tags.select("account", "tag").distinct(), "account").join(F.broadcast(own), ["type", "tag"], "left_anti")
    counts = other.groupBy("type", "tag").agg(F.count("*").alias("c")).join(sizes.select("type", "size"), "type").filter(F.col("c") / F.col("size") >= ALSO)
    nth = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("c"), "tag"))
    top = counts.withColumn("_r", nth).filter(F.col("_r") <= k)
    also = top.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("_r", "tag", F.bround(F.col("c") / F.col("size"), 2).alias("share")))).alias("_a"))
    also = also.select("type", F.transform("_a", lambda x: F.struct(x["tag"].alias("tag"), x["share"].alias("share"))).alias("also"))
    return sizes.join(also, "type", "left")


def strongest_type(members: DataFrame) -> DataFrame:
    """account and its type: the first one, types being numbered by strength."""
    return members.groupBy("account").agg(F.min("type").alias("type"))


def record_links(best: DataFrame, records: DataFrame, related: DataFrame, bar: float = LINK, apart: int = YEARS_APART) -> DataFrame:
    """Pairs of records (a, b, score, details, same_report) worth a link: strong, not joined by the publisher, from different
    agencies or years far apart, with enough shared details unless they copy one report. records (record, agency, year)."""
    both = related.select("a", "b").union(related.select("b", "a")).distinct()
    rows = best.filter(F.col("score") >= bar).join(both, ["a", "b"], "left_anti")
    of = lambda side: records.select(F.col("record").alias(side), F.col("agency").alias(f"_g{side}"), F.col("year").alias(f"_y{side}"))
    rows = rows.join(of("a"), "a").join(of("b"), "b")
    cross = F.coalesce(F.col("_ga") != F.col("_gb"), F.lit(False))
    gap = F.coalesce(F.abs(F.col("_ya") - F.col("_yb")), F.lit(0))
    rows = rows.withColumns({"cross_agency": cross, "years_apart": gap}).filter(F.col("cross_agency") | (F.col("years_apart") >= apart))
    return rows.filter(F.col("same_report") | (F.col("details") >= LINK_DETAILS)).drop("_ga", "_gb", "_ya", "_yb")


def flat_layout(tags: DataFrame, account: str, tag: str, low: float = 0.03, high: float = 0.97) -> DataFrame:
    """(account, x, y) in [low, high]: the two main directions of the accounts' unit tag vectors.

    The matrix of tags by tags, whose size is that of the lexicon, is summed over all accounts; its leading directions come from
    fixed starts, so the picture is the same on every run. Fewer than five accounts stand on a line.
    """
    w = tag_weights(tags, account, tag)
    rows = weighted_tags(tags.select(account, tag).distinct(), account, tag, w)
    unit = rows.withColumn("v", F.col("w") / F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(account))), F.lit(1e-12)))
    unit = written(unit.select(account, tag, "v"), "unit_tags")
    few = unit.select(account).distinct().count()
    if few < 5:
        place = F.row_number().over(Window.orderBy(account))
        line = unit.select(account).distinct().withColumn("_i", place)
        return line.select(account, (F.lit(low) + (high - low) * F.col("_i") / (few + 1)).alias("x"), F.lit(0.5).alias("y"))
    names = [r[0] for r in unit.select(tag).distinct().orderBy(tag).collect()]  # one row for each tag of the lexicon
    index = {t: i for i, t in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    other = unit.select(account, F.col(tag).alias("_t"), F.col("v").alias("_v"))
    for r in unit.join(other, account).groupBy(tag, "_t").agg(F.sum(F.col("v") * F.col("_v")).alias("s")).collect():
        gram[index[r[tag]], index[r["_t"]]] = r["s"]
    mean = {r[tag]: r["m"] / few for r in unit.groupBy(tag).agg(F.sum("v").alias("m")).collect()}
    center = np.array([mean[t] for t in names])
    values, vectors = np.linalg.eigh(gram - few * np.outer(center, center))
    axes = vectors[:, np.argsort(-values, kind="stable")[:2]]
    if axes.shape[1] < 2:
        axes = np.column_stack([axes, np.zeros(len(names))])
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1, 1)
    loads = tags.sparkSession.createDataFrame([(t, float(a), float(b)) for t, (a, b) in zip(names, axes, strict=True)], f"{tag} string, _x double, _y double")
    flat = unit.join(F.broadcast(loads), tag).groupBy(account).agg(F.sum(F.col("v") * F.col("_x")).alias("x"), F.sum(F.col("v") * F.col("_y")).alias("y"))
    ends = flat.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    scaled = lambda c: F.lit(low) + (high - low) * F.when(F.col(f"{c}1") > F.col(f"{c}0"), (F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0"))).otherwise(0.5)
    return flat.join(F.broadcast(ends)).select(account, scaled("x").alias("x"), scaled("y").alias("y"))


def sunflower(rows: DataFrame, group: Sequence[str], order: Sequence[Column], radius: float = 1.0) -> DataFrame:
    """rows with dx, dy: the k-th of a group at an angle of k golden sections, as far out as equal areas put it."""
    k = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    angle, far = k * (math.pi * (3 - math.sqrt(5))), F.lit(1.8 * radius) * F.sqrt(k + 0.5)
    return rows.withColumns({"dx": far * F.cos(angle), "dy": far * F.sin(angle)})


def packed_circles(radii: Sequence[float], gap: float = 0.0) -> list[tuple[float, float]]:
    """Centres of circles that do not overlap, the largest first near the middle: each goes to the place nearest to the
    centre among those where it touches two placed ones. For the few classes of a picture."""
    order = sorted(range(len(radii)), key=lambda i: (-radii[i], i))
    placed: list[tuple[float, float, float]] = []
    at = [(0.0, 0.0)] * len(radii)
    for i in order:
        r = radii[i] + gap / 2
        spots = [(0.0, 0.0)] if not placed else [(placed[0][2] + r, 0.0)] if len(placed) == 1 else []
        for k, (x1, y1, r1) in enumerate(placed):
            for x2, y2, r2 in placed[k + 1 :]:
                d, a, b = math.hypot(x2 - x1, y2 - y1), r1 + r, r2 + r
                if d and abs(a - b) <= d <= a + b:
                    along = (a * a - b * b + d * d) / (2 * d)
                    up = math.sqrt(max(0.0, a * a - along * along))
                    for sign in (1, -1):
                        spots.append((x1 + (along * (x2 - x1) - sign * up * (y2 - y1)) / d, y1 + (along * (y2 - y1) + sign * up * (x2 - x1)) / d))
        free = [s for s in spots if all(math.hypot(s[0] - x, s[1] - y) >= r + q - 1e-9 for x, y, q in placed)]
        at[i] = min(free, key=lambda s: (round(math.hypot(*s) + r, 9), s))
        placed.append((*at[i], r))
    return at


def enclosing(circles: Sequence[tuple[float, float, float]], rounds: int = 400) -> tuple[float, float, float]:
    """A circle (x, y, radius) around circles (x, y, radius): the centre moves towards the farthest one by ever smaller steps."""
    x = sum(c[0] for c in circles) / len(circles)
    y = sum(c[1] for c in circles) / len(circles)
    for k in range(1, rounds):
        fx, fy, _ = max(circles, key=lambda c: math.hypot(c[0] - x, c[1] - y) + c[2])
        x, y = x + (fx - x) / (k + 1), y + (fy - y) / (k + 1)
    return x, y, max(math.hypot(c[0] - x, c[1] - y) + c[2] for c in circles)
