"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct k-word shingles. All sets are ordered alike, rare shingles first: the frequent ones are
found by counts within bounded parts of the input (a shingle in a given share of all documents has that share in some part),
all others go by hash. Two sets that reach the threshold share a shingle of their prefixes, the n - ceil(t n) + 1 first.

1. Equal sets collapse to the smallest doc_id; sets with equal prefix and size form a group, led by its smallest doc_id.
2. Postings of the groups: a rare shingle of one document alone is dropped; the rest are written.
3. First rounds, linear in the postings: in short lists all groups meet; in a longer one each group meets the list's pivot of
   like size, first the group with the fewest rarer shingles, then two drawn by hash. A further member meets its leader. What
   is verified is linked, and components are formed.
4. Last round: only pairs of long lists' entries that are still in different components are left.
   Members of one group that are still apart meet where the shingles after their prefix, again as many as must be, agree.
Size and positional filters apply to pairs of groups; then groups expand to their members, and the whole texts decide, by
hashes that are independent of those that found the pair. Before texts are compared, parities of the sets over hash classes rule out pairs that differ too much for certain.

So a pair at the threshold is linked, or both ends were already connected; a crowd of near copies costs one check each.
Texts are sent only for documents in some pair (a bounded bloom filter drops most others at the scan).

Defined results: a null or wordless text has an empty set and links with nothing; each row takes
the class of its own text, and texts with the same smallest doc_id share a class; a null doc_id links with nothing and has a null component; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.words import U64, chunks, lean, mix, row_sets, shingles, split
from quillon.runtime import Scratch, small_batches

#: A shingle counts as frequent if parts of the input that hold it PART_COUNT times or more add up to LEAST_COUNT; at most
#: the HEAVY most frequent are told apart. A part is about _PART shingles.
PART_COUNT, LEAST_COUNT = 4, 16
HEAVY = 1 << 20
_PART = 6_000_000
#: Lists of up to this many groups are joined whole.
SHORT = 32
#: Rounds of pivots before the last round.
TURNS = 3
BLOOM_BITS = 1 << 26
SIGNS = ("s0", "s1", "s2", "s3")


@dataclass(frozen=True)
class Rule:
    """Documents link when den * |A and B| >= num * |A or B|."""

    k: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.num * n // self.den) + 1

    def need(self, n: np.ndarray) -> np.ndarray:
        """What two sets of n share at least when they link."""
        return -(-2 * self.num * n // (self.num + self.den))

    def links(self, shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.den * shared >= self.num * (n + m - shared)


def _sets(texts: pa.Array, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    words = split(texts, lower=True)
    return row_sets(*shingles(words, words.hashes(second), k, second), len(texts))


def _features(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, n, a, b) of the documents, and rows (token, count) of what is frequent in a part."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "a", "b", "token", "count"]
        held = np.empty(_PART, dtype=U64)
        size = 0

        def frequent() -> pa.RecordBatch:
            part = held[:size]
            part.sort()
            far = PART_COUNT - 1
            tokens = np.unique(part[far:][part[far:] == part[:-far]]) if size > far else part[:0]
            count = np.searchsorted(part, tokens, side="right") - np.searchsorted(part, tokens)
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 4 + [pa.array(tokens.view(np.int64)), pa.array(count)], names)

        for batch in batches:
            for part in chunks(batch, "text"):
                sets, bounds = _sets(part.column("text"), k)
                total = np.zeros((len(sets) + 1, 2), dtype=U64)
                np.cumsum(sets, out=total[1:, 0])
                np.cumsum(mix(sets ^ U64(0x5851F42D4C957F2D)), out=total[1:, 1])
                key = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
                none = pa.nulls(part.num_rows, pa.int64())
                ids = part.column("doc_id").cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(key[:, 0]), pa.array(key[:, 1]), none, none], names)
                while len(sets):
                    take = min(len(sets), _PART - size)
                    held[size : size + take] = sets[:take]
                    size, sets = size + take, sets[take:]
                    if size == _PART:
                        yield frequent()
                        size = 0
        yield frequent()

    return run


def _signatures(sets: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parities over the next power of two to n, from 256 to 8192, classes; halves laid over each other give those over fewer."""
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 256, 8192)
    out: list[bytes] = [b""] * len(n)
    hashed = mix(sets ^ U64(0x2545F4914F6CDD1D))
    for size in np.unique(bits):
        rows = np.flatnonzero(bits == size)
        local = np.full(len(n), -1)
        local[rows] = np.arange(len(rows))
        mine = local[row] >= 0
        at = local[row[mine]] * size + (hashed[mine] & U64(size - 1)).astype(np.int64)
        odd = np.bincount(at, minlength=len(rows) * size).astype(np.uint8) & 1
        for i, packed in zip(rows.tolist(), np.packbits(odd.reshape(-1, size), axis=1), strict=True):
            out[i] = packed.tobytes()
    return out


def _folded(signs: pa.Array, width: int) -> np.ndarray:
    """Signatures of one length as a matrix of `width` bytes."""
    data = np.frombuffer(b"".join(signs.to_pylist()), dtype=np.uint8).reshape(len(signs), -1)
    while data.shape[1] > width:
        data = data[:, : data.shape[1] // 2] ^ data[:, data.shape[1] // 2 :]
    return data


def _screen(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drop the pairs whose signatures differ in more bits than sets at the threshold differ in shingles."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            one, two = batch.column("sign_u"), batch.column("sign_v")
            most = n + m - 2 * -(-rule.num * (n + m) // (rule.num + rule.den))
            sizes = np.column_stack([pa.compute.binary_length(c).to_numpy() for c in (one, two)])
            keep = np.zeros(batch.num_rows, dtype=bool)
            for pair in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == pair).all(1))
                take = pa.array(at)
                apart = _folded(one.take(take), pair.min()) ^ _folded(two.take(take), pair.min())
                keep[at] = np.bitwise_count(apart).sum(1) <= most[at]
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def screened(pairs: DataFrame, signs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) that their documents' signatures leave possible."""
    side = lambda c, n: signs.select(F.col("doc_id").alias(c), F.col("n").alias(n), F.col("sign").alias(f"sign_{c}"))
    joined = pairs.join(side("v", "n2"), "v").join(side("u", "n1"), "u")
    return joined.select("u", "v", "n1", "n2", "sign_u", "sign_v").mapInArrow(_screen(rule), "u long, v long")


def _order(sets: np.ndarray, bounds: np.ndarray, row: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Put the shingles of each row in the common order, in place; returns their counts, 0 for those that are not frequent."""
    rank = np.zeros(len(sets), dtype=np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, sets), len(tokens) - 1)
        rank = np.where(tokens[at] == sets, counts[at], 0)
    # Sets are sorted by hash already; only rows with a frequent shingle need another order.
    for i in np.unique(row[rank > 0]):
        a, b = bounds[i], bounds[i + 1]
        order = np.argsort(rank[a:b], kind="stable")
        sets[a:b], rank[a:b] = sets[a:b][order], rank[a:b][order]
    return rank


def _tails(rule: Rule, heavy) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, tokens): the shingles after the prefix of which two linked members of one group share one.

    Such members share their prefix, so they share need - prefix of the rest; where that is nothing, one token stands for all.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = heavy.value
        for batch in batches:
            for part in chunks(batch, "text"):
                sets, bounds = _sets(part.column("text"), rule.k)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                _order(sets, bounds, row, tokens, counts)
                place, first, need = np.arange(len(sets)) - bounds[row], rule.prefix(n), rule.need(n)
                inside = (place >= first[row]) & (place <= (first + n - need)[row])
                free = need <= first
                sets[inside & free[row]] = 0
                lists = [np.unique(x) for x in np.split(sets[inside], np.cumsum(np.bincount(row[inside], minlength=len(n)))[:-1])]
                lists = [np.zeros(1, U64) if f else x for f, x in zip(free, lists, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.view(np.int64) for x in lists], pa.list_(pa.int64()))], ["doc_id", "tokens"])

    return run


def _prefixes(rule: Rule, heavy) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, n, light, dense, s0..s3, sign): the prefix in order, its frequent shingles, if any, come last.

    s0 to s3 are the parities of the set over 256 hash classes, sign those over about n classes: two sets differ in at
    least as many shingles as bits.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = heavy.value
        for batch in batches:
            for part in chunks(batch, "text"):
                sets, bounds = _sets(part.column("text"), rule.k)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                classes = (mix(sets) >> U64(56)).astype(np.int64)
                odd = np.bincount(row * 256 + classes, minlength=256 * len(n)).astype(np.uint8) & 1
                signs = np.packbits(odd.reshape(-1, 256), axis=1).view(np.int64)
                rank = _order(sets, bounds, row, tokens, counts)
                inside = np.arange(len(sets)) - bounds[row] < rule.prefix(n)[row]
                light, dense = inside & (rank == 0), inside & (rank > 0)
                out = [part.column("doc_id").cast(pa.int64()), pa.array(n)]
                for mask in (light, dense):
                    ends = np.append(0, np.cumsum(np.bincount(row[mask], minlength=len(n)))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(sets[mask].view(np.int64))))
                out += [pa.array(np.ascontiguousarray(signs[:, j])) for j in range(4)]
                out.append(pa.array(_signatures(sets, row, n), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "light", "dense", *SIGNS, "sign"])

    return run


def bloom(ids: DataFrame, count: int) -> np.ndarray:
    """A bloom filter of the ids, as 64-bit words: two bits each, at most BLOOM_BITS; a fuller one only lets more rows pass.

    Partitions fill filters of their own, which are combined word by word before and after a shuffle.
    """
    bits = min(BLOOM_BITS, 1 << max(10, (16 * count).bit_length()))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 64, dtype=U64)
        for batch in batches:
            for word, bit in _bits(batch.column("id").to_numpy(), bits):
                np.bitwise_or.at(seen, word, bit)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at].view(np.int64))], ["word", "bits"])

    parts = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(bits // 64, dtype=U64)
    whole[parts.column("word").to_numpy()] = parts.column("bits").to_numpy().view(U64)
    return whole


def _bits(ids: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word and bit of both places of each id."""
    h = mix(ids.astype(np.int64).view(U64))
    both = h & U64(bits - 1), (h >> U64(32)) & U64(bits - 1)
    return [((at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63))) for at in both]


def may_hold(filter_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be one of those a filter was made of."""
    one, two = ((filter_[word] & bit) != 0 for word, bit in _bits(ids, 64 * len(filter_)))
    return one & two


def texts_of(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, text) of the documents in ids (distinct, written)."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(ids, ids.count()))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(filter_.value, batch.column("id").to_numpy())))

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    return scratch.table(rows.mapInArrow(run, "id long, text string").join(ids, "id", "left_semi"), "texts")


def _verify(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text_u"):
                for piece in chunks(part, "text_v"):
                    one, first = _sets(piece.column("text_u"), rule.k, second=True)
                    two, second = _sets(piece.column("text_v"), rule.k, second=True)
                    row = np.concatenate([np.repeat(np.arange(piece.num_rows), np.diff(b)) for b in (first, second)])
                    both = np.concatenate([one, two])
                    order = np.lexsort((both, row))
                    both, row = both[order], row[order]
                    twin = row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])]
                    shared = np.bincount(twin, minlength=piece.num_rows)
                    n, m = np.diff(first), np.diff(second)
                    good = rule.links(shared, n, m) & (n > 0) & (m > 0)
                    yield piece.select(["u", "v"]).filter(pa.array(good))

    return run


def verified(docs: DataFrame, pairs: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The pairs (u, v; written) whose whole texts reach the threshold."""
    ids = scratch.table(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
    texts = texts_of(docs, ids, scratch)
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "text_u", "text_v")
    edges = scratch.table(joined.mapInArrow(_verify(rule), "u long, v long"), "edges")
    scratch.drop(ids, texts)
    return edges


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Near-duplicate classes of documents (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    source = docs.select("doc_id", "text")
    schema = "doc_id long, n long, a long, b long, token long, count long"
    seen = scratch.table(source.mapInArrow(_features(rule.k), schema), "features")
    rows = seen.filter("n is not null").select("doc_id", "n", "a", "b")
    reps = scratch.table(
        rows.filter("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")), "reps"
    )
    often = seen.filter("token is not null").groupBy("token").agg(F.sum("count").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    often = often.orderBy(F.desc("n"), "token").limit(HEAVY)
    table = often.toArrow()
    tokens, counts = table.column("token").to_numpy().view(U64), table.column("n").to_numpy()
    order = np.argsort(tokens)
    heavy = spark.sparkContext.broadcast((tokens[order], counts[order]))

    prefixes = source.mapInArrow(_prefixes(rule, heavy), "doc_id long, n long, light array<bigint>, dense array<bigint>, s0 long, s1 long, s2 long, s3 long, sign binary")
    alone = prefixes.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    marks = scratch.table(
        alone.withColumn("p", F.xxhash64("light", "dense")).withColumn("q", F.hash("light", "dense")), "prefixes"
    )
    groups = scratch.table(
        marks.groupBy("n", "p", "q").agg(F.min("doc_id").alias("g"), F.count("*").alias("members")), "groups"
    )
    members = scratch.table(marks.select("doc_id", "n", "p", "q").join(groups, ["n", "p", "q"]).select("doc_id", "g").filter("doc_id <> g"), "members")
    led = marks.join(groups.select(F.col("g").alias("doc_id"), "members"), "doc_id")
    light = led.select(F.col("doc_id").alias("g"), "n", "members", *SIGNS, F.posexplode("light").alias("pos", "token"))
    dense = led.select(F.col("doc_id").alias("g"), "n", "members", *SIGNS, F.size("light").alias("before"), F.posexplode("dense").alias("at", "token"))
    same = Window.partitionBy("token")
    light = light.withColumn("held", F.sum("members").over(same)).withColumn("m", F.count("*").over(same))
    light = light.filter("held > 1").select("token", "g", "n", "pos", "m", (F.col("members") == 1).alias("solo"), *SIGNS)
    dense = dense.select("token", "g", "n", (F.col("before") + F.col("at")).cast("int").alias("pos"), F.lit(None).cast("long").alias("m"), (F.col("members") == 1).alias("solo"), *SIGNS)
    lists = scratch.table(light.unionByName(dense), "lists")
    signs = scratch.table(marks.select("doc_id", "n", "sign"), "signs")
    scratch.drop(marks, groups)
    long = lists.filter(f"m is null or m > {SHORT}").drop("m")
    pairs = _short(lists.filter(f"m <= {SHORT}").drop("m"), rule).unionByName(_pivots(long, rule, scratch))
    pairs = _expanded(pairs, members).unionByName(members.select(F.col("doc_id").alias("u"), F.col("g").alias("v"))).distinct()
    first = verified(docs, scratch.table(screened(scratch.table(pairs, "pairs"), signs, rule), "screened"), rule, scratch)
    near = scratch.table(components(first, scratch), "components")
    for turn in range(1, TURNS):
        pairs = scratch.table(_expanded(_pivots(_labelled(long, members, near), rule, scratch, turn), members).distinct(), "pairs")
        more = verified(docs, scratch.table(screened(pairs, signs, rule), "screened"), rule, scratch)
        if more.isEmpty():
            break
        stars = near.select(F.col("id").alias("u"), F.col("component_id").alias("v"))
        near = scratch.table(components(stars.unionByName(more), scratch), "components")
    pairs = _apart(long, members, near, rule, scratch).unionByName(_within(docs, members, near, rule, heavy, scratch)).distinct()
    pairs = scratch.table(pairs, "pairs")
    scratch.drop(lists)
    last = verified(docs, scratch.table(screened(pairs, signs, rule), "screened"), rule, scratch)
    stars = near.select(F.col("id").alias("u"), F.col("component_id").alias("v"))
    both = components(stars.unionByName(last), scratch)
    known = scratch.table(
        reps.join(both.withColumnRenamed("id", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("component_id", "rep").alias("component_id")),
        "classes",
    )
    out = rows.join(known, ["n", "a", "b"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _near(rule: Rule) -> tuple[str, str]:
    """Conditions that every pair at the threshold meets at its first shared shingle: sizes and signatures; positions.

    For sizes n1 and n2 the pair shares at least `need` shingles, so it differs in at most n1 + n2 - 2 need, and the first
    one shared has at most n - need before it on either side.
    """
    need = f"ceil({rule.num} * (n1 + n2) / {rule.num + rule.den} - 1e-9)"
    bits = " + ".join(f"bit_count({c} ^ o{c})" for c in SIGNS)
    apart = f"solo and osolo and {bits} > n1 + n2 - 2 * {need}"  # a group of several has no signature of its own
    sizes = f"{rule.den} * least(n1, n2) >= {rule.num} * greatest(n1, n2) and not ({apart})"
    return sizes, f"p1 <= n1 - {need} and p2 <= n2 - {need}"


def _sides(entries: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The entries under the names of the left and of the right end of a pair."""
    one = entries.select("token", *keys, F.col("g").alias("u"), F.col("n").alias("n1"), F.col("pos").alias("p1"), "solo", *SIGNS)
    two = entries.select(
        "token", *[F.col(k).alias(f"o{k}") for k in keys], F.col("g").alias("v"), F.col("n").alias("n2"), F.col("pos").alias("p2"),
        *[F.col(c).alias(f"o{c}") for c in ("solo", *SIGNS)],
    )
    return one, two


def _short(lists: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of short lists."""
    one, two = _sides(lists)
    sizes, places_ = _near(rule)
    return one.join(two, "token").filter("u < v").filter(sizes).filter(places_).select("u", "v")


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of leaders as pairs of all members of both groups."""
    whole = members.select("g", "doc_id").unionByName(members.select("g", F.col("g").alias("doc_id")).distinct())
    for end in ("u", "v"):
        side = whole.select(F.col("g").alias(end), F.col("doc_id").alias("member"))
        pairs = pairs.join(side, end, "left").withColumn(end, F.coalesce("member", end)).drop("member")
    return pairs.select("u", "v")


def _groups(members: DataFrame, near: DataFrame) -> DataFrame:
    """(doc_id, g, c) of all members of groups of several, leaders too."""
    whole = members.select("g", "doc_id").unionByName(members.select("g", F.col("g").alias("doc_id")).distinct())
    label = near.select(F.col("id").alias("doc_id"), F.col("component_id").alias("c"))
    return whole.join(label, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))


def _labelled(lists: DataFrame, members: DataFrame, near: DataFrame) -> DataFrame:
    """The entries with a label c: their component, or one of their own where a group's members are in several."""
    mixed = _groups(members, near).groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
    label = near.select(F.col("id").alias("g"), F.col("component_id").alias("c"))
    label = label.join(mixed.select("g", F.lit(True).alias("mixed")), "g", "full")
    own = F.when(F.col("mixed"), F.concat(F.lit("group "), F.col("g"))).otherwise(F.coalesce("c", "g").cast("string"))
    return lists.join(label, "g", "left").withColumn("c", own).drop("mixed")


def _pivots(lists: DataFrame, rule: Rule, scratch: Scratch, turn: int = 0) -> DataFrame:
    """Each group with the pivots of its lists, one for each size class.

    In turn 0 the pivot is the group with the fewest rarer shingles, later one by hash, among entries that have components,
    and pairs within one are left out.
    """
    size = lists.withColumn("size", F.floor(F.log("n") / F.log(F.lit(rule.den / rule.num))).cast("int"))
    size = size if turn else size.withColumn("c", F.col("g").cast("string"))
    size = size.withColumn("draw", F.xxhash64("g", F.lit(turn)) if turn else F.col("pos").cast("long"))
    head = F.min(F.struct("draw", "n", "g", "pos", "c", "solo", *SIGNS)).alias("head")
    heads = size.groupBy("token", "size").agg(head, F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
    heads = scratch.table(heads.select("token", "size", "head.*"), "pivots")
    one, _ = _sides(size, "size", "c")
    _, two = _sides(heads, "size", "c")
    met = one.join(two.withColumnRenamed("osize", "size"), ["token", "size"])
    return met.filter("c <> oc").filter(_near(rule)[0]).select("u", "v")


def _apart(long: DataFrame, members: DataFrame, near: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Pairs of documents in different components that pass the filters.

    Where most entries of a list are components of their own, they meet directly; else the components of a list meet
    first, so that the entries of one component are never set against each other.
    """
    entries = scratch.table(_labelled(long, members, near), "entries")
    span = scratch.table(entries.groupBy("token", "c").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("first"), F.count("*").alias("m")), "spans")
    mixed = span.groupBy("token").agg(F.count("*").alias("parts"), F.sum("m").alias("m")).filter("parts > 1")
    mixed = scratch.table(mixed.select("token", (F.col("m") <= 2 * F.col("parts")).alias("direct")), "mixed")
    live = scratch.table(entries.join(mixed, "token"), "live")
    sizes, places_ = _near(rule)
    one, two = _sides(live.filter("direct"), "c")
    direct = one.join(two, "token").filter("u < v and c <> oc").filter(sizes).filter(places_)
    left = span.join(mixed.filter("not direct"), "token")
    right = left.select("token", *[F.col(k).alias(f"o{k}") for k in ("c", "low", "high", "first", "m")])
    # The smaller component's entries are laid out first, and meet those of the larger one under all filters.
    # The least that sets of sizes n and m share grows with both: the most before a first shared shingle is n - need(n, low m).
    most = lambda n, m: f"{n} - ceil({rule.num} * ({n} + {m}) / {rule.num + rule.den} - 1e-9)"
    reach = f"(m < om or m = om and c < oc) and {rule.den} * high >= {rule.num} * olow and {rule.den} * ohigh >= {rule.num} * low"
    reach += f" and first <= {most('high', 'olow')} and ofirst <= {most('ohigh', 'low')}"
    classes = left.join(right, "token").filter(reach).select("token", "c", "oc", "olow")
    one, two = _sides(live.filter("not direct"), "c")
    half = classes.join(one, ["token", "c"]).filter(f"p1 <= {most('n1', 'olow')}").drop("olow", "c")
    through = half.join(two, ["token", "oc"]).filter(sizes).filter(places_)
    pairs = direct.select("u", "v").unionByName(through.select("u", "v"))
    out = scratch.table(_expanded(pairs.distinct(), members), "pairs")
    scratch.drop(entries, span, mixed, live)
    return out


def _within(docs: DataFrame, members: DataFrame, near: DataFrame, rule: Rule, heavy, scratch: Scratch) -> DataFrame:
    """Pairs of one group's members in different components that share a shingle which they must share beyond the prefix."""
    every = scratch.table(_groups(members, near), "grouped")
    mixed = every.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("g")
    apart = scratch.table(every.join(mixed, "g"), "apart")
    if apart.isEmpty():
        return apart.select(F.col("doc_id").alias("u"), F.col("g").alias("v"))
    texts = texts_of(docs, apart.select(F.col("doc_id").alias("id")).distinct(), scratch)
    tails = texts.mapInArrow(_tails(rule, heavy), "doc_id long, tokens array<bigint>")
    one = scratch.table(apart.join(tails, "doc_id").select("g", F.col("doc_id").alias("u"), "c", F.explode("tokens").alias("token")), "tails")
    two = one.select("g", "token", F.col("u").alias("v"), F.col("c").alias("oc"))
    return one.join(two, ["g", "token"]).filter("u < v and c <> oc").select("u", "v")
