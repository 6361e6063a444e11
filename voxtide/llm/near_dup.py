"""Near-duplicate groups by min-max hashing, confirmed on whole shingle sets.

1. Every text becomes the set of its four-word shingles (64-bit hashes; another number of words is an option). Texts with equal sets are
   one class from here on; what follows runs on one document of each class.
2. Each of 64 permutations gives the smallest and the largest value of the set, so 128 signature
   values cost 64 evaluations. Two permutations with both their ends make one of 32 bands.
3. Classes that share a band are one bucket. In each bucket every member is compared with the
   bucket's first member: links grow with the members, not with their pairs.
4. Members of a bucket that are still in different components afterwards are compared in blocks:
   sets meet in tasks of bounded size and only links leave them. Members of the bucket's largest
   component meet the others, not each other.

At a similarity of 0.8 a pair shares no band with a probability below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.llm.common import U64, Recent, batch_udf, free_name, kept, mixed, small_batches, struct_rows, utf8
from voxtide.operators.components import connected_components
from voxtide.session import materialize

SHINGLE = 4
PERMUTATIONS = 64
PER_BAND = 2  # permutations, so twice as many values
BANDS = PERMUTATIONS // PER_BAND
BLOCK = 128  # members of a bucket that meet another block in one task
CENTER_ROWS = 256  # links of one first member handled in one task

_random = np.random.default_rng(20240229)
XOR = _random.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
FACTOR = _random.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | U64(1)
PLACE = _random.integers(0, 2**64, 64, dtype=np.uint64) | U64(1)


class WordHashes(Recent):
    def learn(self, texts: list[list[bytes]]) -> None:
        for w in self.missing(chain.from_iterable(texts)):
            self.now[w] = xxhash.xxh3_64_intdigest(w)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.now.__getitem__, words), U64, len(words))


def shingle_sets(values: list[bytes | None], n: int = SHINGLE) -> list[np.ndarray]:
    """The shingle set of each text."""
    cache = kept("words", WordHashes)
    texts = [(v or b"").lower().split() for v in values]
    cache.learn(texts)
    out = [shingles(cache.of(words), n) for words in texts]
    cache.turn()
    return out


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of hashed words; a shorter text is one shingle."""
    if not len(h):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        if len(h) < n:
            return mixed(np.array([(h * PLACE[n : n + len(h)]).sum() + PLACE[len(h)]], U64))
        out = h[: len(h) - n + 1] * PLACE[0]
        for j in range(1, n):
            out = mixed(out) + h[j : len(h) - n + 1 + j] * PLACE[j]
        return np.unique(mixed(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys, one row per non-empty set, from the ends of each permutation."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), BANDS), U64)
    y, shifted = np.empty_like(flat), np.empty_like(flat)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(sets), band, U64)
            for p in range(band * PER_BAND, (band + 1) * PER_BAND):
                np.bitwise_xor(flat, XOR[p], out=y)
                np.multiply(y, FACTOR[p], out=y)
                np.right_shift(y, U64(32), out=shifted)
                np.bitwise_xor(y, shifted, out=y)
                np.multiply(y, FACTOR[p], out=y)
                for end in (np.minimum, np.maximum):
                    key = mixed(key * U64(0x9E3779B97F4A7C15) + end.reduceat(y, starts))
            out[:, band] = key
    return out


def _batched(sets: list[np.ndarray], values: int = 32_768) -> Iterable[list[np.ndarray]]:
    """Runs of sets that fit the processor's cache together."""
    some, n = [], 0
    for s in sets:
        some.append(s)
        n += len(s)
        if n >= values:
            yield some
            some, n = [], 0
    if some:
        yield some


FIELDS = [("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]


def _sketch(n: int):
    def work(values: list) -> pa.Array:
        sets = shingle_sets(values, n)
        full = [s for s in sets if len(s)]
        keys = iter(np.concatenate([signatures(some) for some in _batched(full)]).view(np.int64)) if full else iter(())
        return struct_rows(FIELDS, (
            [len(s) for s in sets],
            [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            [next(keys) if len(s) else None for s in sets],
        ))

    return batch_udf(work, "struct<n:bigint,digest:binary,bands:array<bigint>>")


def _sets(n: int):
    def work(values: list) -> pa.Array:
        return pa.array([s.view(np.int64) for s in shingle_sets(values, n)], pa.list_(pa.int64()))

    return batch_udf(work, "array<bigint>")


def similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


class Forest:
    """Union-find over a few keys."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(
    ids: np.ndarray, components: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Links that join different components, between the two sides or, with one side, within it.

    A link that would only repeat what the links so far say is left out, so at most as many leave
    as there are members.
    """
    order = np.lexsort((ids, sides))
    first = [i for i in order if sides[i] == 0]
    second = [i for i in order if sides[i] == 1]
    forest, out = Forest(), []
    for x, i in enumerate(first):
        others = second if second else first[x + 1 :]
        others = [j for j in others if forest.root(components[j]) != forest.root(components[i])]
        others = [j for j in others if 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j]))]
        if not others:
            continue
        flat = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        starts = np.concatenate([[0], np.cumsum([len(sets[j]) for j in others])])[:-1]
        common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
        for j, n in zip(others, common.tolist(), strict=True):
            if similar(n, len(sets[i]), len(sets[j]), percent) and forest.join(components[i], components[j]):
                out.append((int(ids[i]), int(ids[j])))
    return out


def _links_with_first(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of every bucket's first member u and each member v that is similar to it."""
    pairs = buckets.where("v <> u").select("u", "v").distinct()
    parts = pairs.groupBy("u").agg(F.count("*").alias("m")).select("u", F.expr(f"int((m + {CENTER_ROWS - 1}) div {CENTER_ROWS})").alias("parts"))
    parts = materialize(parts, "centers")
    dealt = pairs.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    left = sets.join(parts, sets["id"] == parts["u"]).select("u", F.col("shingles").alias("a"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    right = dealt.join(sets, dealt["v"] == sets["id"]).select("u", "v", "part", F.col("shingles").alias("b"))
    both = right.join(left, ["u", "part"])
    common = F.size(F.array_intersect("a", "b"))
    return both.where(similar(common, F.size("a"), F.size("b"), percent)).select("u", "v")


def _blocks(n: str, name: str):
    return F.expr(f"int(({n} + {BLOCK - 1}) div {BLOCK})").alias(name)


def _links_between(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that are in different components, found block by block.

    Members of a bucket's largest component need not meet each other. They meet the others once per
    component, not once per bucket; the others meet within their bucket.
    """
    each = rest.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    large = materialize(each.groupBy("bucket").agg(F.max(F.struct("m", "component"))["component"].alias("large")), "large")
    tagged = materialize(rest.join(large, "bucket").withColumn("inside", F.col("component") == F.col("large")), "tagged")

    apart = tagged.select(F.col("large").alias("key"), "v", "component", "inside").distinct()
    sizes = apart.groupBy("key").agg(F.count_if("inside").alias("m"), F.count_if(~F.col("inside")).alias("n"))
    apart = apart.join(materialize(sizes.select("key", _blocks("m", "i_blocks"), _blocks("n", "j_blocks")), "blocks"), "key")
    place = F.xxhash64("v")
    first = apart.where("inside").select(
        F.lit(0).alias("kind"), "key", F.pmod(place, F.col("i_blocks")).cast("int").alias("own"), F.col("j_blocks").alias("blocks"),
        F.lit(0).alias("side"), "v", "component",
    )
    second = apart.where("not inside").select(
        F.lit(0).alias("kind"), "key", F.pmod(place, F.col("j_blocks")).cast("int").alias("own"), F.col("i_blocks").alias("blocks"),
        F.lit(1).alias("side"), "v", "component",
    )

    others = tagged.where("not inside").select(F.col("bucket").alias("key"), "v", "component")
    sizes = others.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    others = others.join(materialize(sizes.where("lo < hi").select("key", _blocks("n", "blocks")), "blocks"), "key")
    within = others.select(
        F.lit(1).alias("kind"), "key", F.pmod(place, F.col("blocks")).cast("int").alias("own"), "blocks", F.lit(0).alias("side"), "v", "component",
    )
    met = first.unionByName(second).unionByName(within)
    # a member fetches its set once per key and is copied to the blocks it meets afterwards
    full = met.join(sets, met["v"] == sets["id"]).select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    bucket, lower, upper = F.col("kind") == 1, F.least("own", "other"), F.greatest("own", "other")
    full = full.select(
        "kind", "key", F.when(bucket, lower).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(bucket, upper).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("j"),
        F.when(bucket, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side")).alias("side"), "v", "component", "shingles",
    )

    def meet(table: pa.Table) -> pa.Table:
        sides = set(table["side"].to_pylist())
        links: list[tuple[int, int]] = []
        if len(sides) == 2 or table["kind"][0].as_py() == 1 and table["i"][0] == table["j"][0]:
            own = [np.asarray(s.values.to_numpy(zero_copy_only=False)).view(U64) for s in table["shingles"]]
            links = block_links(table["v"].to_numpy(), table["component"].to_numpy(), table["side"].to_numpy(), own, percent)
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return full.groupBy("kind", "key", "i", "j").applyInArrow(meet, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, shingle: int = SHINGLE
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Two documents are linked when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of `shingle`-word
    shingles; words are runs without ASCII white space, with A-Z lowered. A text of fewer words is
    one shingle. Null, empty and blank texts have an empty set and are linked with nothing.
    component_id is the smallest id that links lead to; kept marks it. Rows with a null id get a
    null component and are kept, as no other row can name them. Rows that repeat an id share one
    component, as if the id stood for all their texts; each is returned with its own size. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("body"))
    sketch = materialize(base.select("id", _sketch(shingle)(utf8("body")).alias("s")).select("id", "s.*"), "sketches")
    named = sketch.where(F.col("id").isNotNull() & F.col("digest").isNotNull())

    classes = materialize(named.groupBy("digest").agg(F.min("id").alias("u"), F.first("bands").alias("bands")), "classes")
    member = classes.select(F.col("u").alias("v"), F.posexplode("bands").alias("band", "key"))
    crowd = member.groupBy("band", "key").agg(
        F.min("v").alias("u"), F.count("*").alias("m"), F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("b")
    ).where("m > 1")
    # buckets with the same members are one
    crowd = crowd.groupBy("u", "m", "a", "b").agg(F.min(F.struct("band", "key")).alias("k")).select("u", F.col("k.band").alias("band"), F.col("k.key").alias("key"))
    crowd = materialize(crowd, "crowds")
    bucket = F.xxhash64("band", "key").alias("bucket")
    buckets = materialize(member.join(crowd, ["band", "key"]).select(bucket, "u", "v"), "buckets")

    wanted = buckets.select(F.col("v").alias("id")).distinct()
    picked = base.where(F.col("id").isNotNull()).join(materialize(wanted, "wanted"), "id").dropDuplicates(["id", "body"])
    sets = materialize(picked.select("id", _sets(shingle)(utf8("body")).alias("shingles")), "sets")

    links = materialize(_links_with_first(buckets, sets, percent), "links")
    component = materialize(connected_components(links, "u", "v"), "components")
    where = buckets.where("v <> u").join(component.withColumnRenamed("node", "v"), "v", "left").select(
        "bucket", "v", F.coalesce("component", "v").alias("component")
    )
    mixed_ones = where.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    rest = materialize(where.join(materialize(mixed_ones, "mixed"), "bucket"), "rest")
    more = materialize(_links_between(rest, sets, percent), "links")
    # documents of a class are linked to its first one; ids that occur with several texts join classes
    same = named.join(classes.select("digest", "u"), "digest").where("id <> u").select("u", F.col("id").alias("v"))
    every = links.unionAll(more)
    groups = connected_components(every.unionAll(same), "u", "v")
    out = sketch.join(groups.withColumnRenamed("node", "id"), "id", "left")
    found = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), found.alias("component_id"),
        F.coalesce(found == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those that another document of their group stands for.

    Of rows that repeat an id and a text one stays, that of the smallest hash over the columns that can
    be hashed. Rows with a null id all stay.
    """
    gone = near_duplicates(docs, id=id, text=text, **options).where(~F.col("kept")).select(id).distinct()
    # written, so that the planner knows its size; a document with a null id stays
    left = docs.join(materialize(gone, "gone"), id, "left_anti").select(*docs.columns)
    ids = docs.select(F.col(id).alias("id")).where("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    again = materialize(ids.where("n > 1").select(F.col("id").alias(id)), "again")
    if again.isEmpty():
        return left
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rank = free_name(docs.columns, "rank")
    first = W.partitionBy(id, text).orderBy(F.xxhash64(*hashed))
    one = left.join(again, id, "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return left.join(again, id, "left_anti").select(*docs.columns).unionAll(one.select(*docs.columns))
