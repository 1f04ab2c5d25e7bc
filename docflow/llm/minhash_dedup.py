"""Near-duplicate detection with HyperMinHash sketches.

A document's set is its distinct 5-word shingles.  Its sketch has 256 buckets; a
shingle's hash picks the bucket, and the bucket keeps its smallest remaining hash
in 16 bits: the count of leading zeros (6 bits) and the mantissa bits that follow
(10).  Empty buckets borrow from a bucket that the document fills.  Some registers
in a row form a band: six at a threshold of 0.85, five at 0.80.

1. Documents with equal words form a class; one row a class takes part.
2. Classes that share a band are candidates.  A band's *star* is the member whose
   bands are the most populous (in a group of near copies: the text they come
   from).  Every member is compared with its star on whole sets.
3. Members that end in another component than their star (*outsiders*) are looked at
   further.  In rounds, one outsider of each star is compared with the others, a pair
   a member, as long as that settles a tenth of them.  What is left is compared under
   exact bounds.  Two sets at the threshold share an element of their prefixes when
   elements outside the star's set come first.  So either they share an element that
   the star lacks, which an inverted index finds (elements with the same members have
   one posting list), or few such elements exist; and the sizes of both differences to
   the star must allow a link.  Only pairs of different components count.
4. Before the sets of such a pair are read, its sketches must allow the threshold:
   the collision-corrected estimate plus six standard errors.
5. Components come from label propagation over confirmed links.

No bucket is cut short.  Two sets at the threshold share no band with a
probability of about (1 - 0.85**6)**42 = 2e-9, or (1 - 0.80**5)**51 = 2e-9.

Defined results: null and empty texts have an empty set and link with nothing;
texts with fewer than five words have the whole sequence as their one shingle.  A
null ``doc_id`` counts only where all its class has none.  Rows that repeat a
``doc_id`` share its component only through their texts.  An empty table gives an
empty result.  Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.common import materialize, release
from docflow.llm.wordhash import buffers, groups, lists, mix, named, whole_windows, window_hashes, word_hashes

SHINGLE = 5
BUCKETS = 256
MANTISSA = 10
#: Percent of the union that the intersection must reach, where the caller names none.
THRESHOLD = 85
#: Chance at most that two sets at the threshold share no band.
MISS = 2.5e-9
#: Standard errors that a sketch estimate may lie below the threshold.
ERRORS = 6
#: Part of the outsiders that a round of second stars must settle for another round.
GAIN = 0.1


def band_rows(threshold: int = THRESHOLD) -> int:
    """Registers in a band: as many as the chance of a miss allows."""
    return max([1] + [r for r in range(1, BUCKETS + 1) if (1 - (threshold / 100) ** r) ** (BUCKETS // r) <= MISS])


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    (words,), begins = word_hashes(texts, lower=True)
    starts, _ = whole_windows(begins, width)
    hashes = window_hashes(words, width)[starts] if len(starts) else np.zeros(0, np.uint64)
    counts = np.maximum(np.diff(begins) - width + 1, 0)
    cuts = np.cumsum([0, *counts])
    out = []
    for k, (at, to) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
        if counts[k]:
            out.append(np.unique(hashes[cuts[k] : cuts[k + 1]]))
        elif to > at:  # a short text: one shingle of all its words, told apart by its length
            out.append(mix(window_hashes(words[at:to], to - at) + np.uint64(to - at)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray, buckets: int = BUCKETS, mantissa: int = MANTISSA) -> np.ndarray:
    """16-bit registers: leading zeros + 1 above the mantissa of each bucket's least hash; 0 if empty."""
    registers = np.zeros(buckets, np.uint16)
    if not len(shingles):
        return registers
    shift = buckets.bit_length() - 1
    bucket = (shingles >> np.uint64(64 - shift)).astype(np.int64)  # sets are sorted, and so are buckets
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = shingles[first] << np.uint64(shift)
    # The highest set bit by halves; beyond 2**mantissa-th zeros differences do not matter.
    zeros = np.zeros(len(least), np.uint64)
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = rest < (np.uint64(1) << np.uint64(64 - step))
        zeros[low] += np.uint64(step)
        rest[low] <<= np.uint64(step)
    tail = (rest << np.uint64(1)) >> np.uint64(64 - mantissa)
    zeros = np.minimum(zeros, np.uint64(2 ** (16 - mantissa) - 2))
    registers[bucket[first]] = (((zeros + np.uint64(1)) << np.uint64(mantissa)) | tail).astype(np.uint16)
    return registers


#: For each bucket, the order in which it looks at others when it is empty: some at random, then all.
_BORROW = np.random.default_rng(7).integers(0, BUCKETS, (64, BUCKETS))
_LAST = np.random.default_rng(9).permuted(np.tile(np.arange(BUCKETS, dtype=np.int16), (BUCKETS, 1)), axis=1)
_MULTIPLIERS = np.random.default_rng(8).integers(1, 2**63, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(registers: np.ndarray, band: int = band_rows()) -> np.ndarray:
    """One key a band; empty registers take the value of another bucket first."""
    if not registers.any():
        return np.zeros(0, np.int64)
    full = registers.astype(np.uint64)
    for row in _BORROW:
        empty = np.flatnonzero(full == 0)
        if not len(empty):
            break
        full[empty] = registers[row[empty]]
    empty = np.flatnonzero(full == 0)
    if len(empty):  # few are filled: each takes the one that comes first in its own order
        filled = np.flatnonzero(registers)
        full[empty] = registers[filled[_LAST[empty][:, filled].argmin(1)]]
    n = len(full) // band
    rows = mix(full[: n * band].reshape(n, band) * _MULTIPLIERS[:band])
    return mix(rows.sum(1, dtype=np.uint64) + np.arange(n, dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, mantissa: int = MANTISSA, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of sketch rows, and their standard errors at the threshold.

    Two different least hashes share a register with a probability of about
    2**-mantissa times the chance of equal leading zeros, 1/3 for like sizes.
    """
    either = ((a > 0) | (b > 0)).sum(1)
    both = ((a == b) & (a > 0)).sum(1)
    chance = 2.0**-mantissa / 3
    n = np.maximum(either, 1)
    found = np.clip((both / n - chance) / (1 - chance), 0, 1)
    t = threshold / 100
    return found, np.sqrt(t * (1 - t) / n)


def _sketches(batches: Iterator[pa.RecordBatch], band: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in groups(batch.column(1)):
            texts = batch.column(1)[lo:hi]
            sets = shingle_sets(texts)
            raw, at = buffers(pc.ascii_lower(texts))
            view = memoryview(np.ascontiguousarray(raw)).cast("B")
            names = [named(view[at[k] : at[k + 1]], hashlib.md5)[0] for k in range(hi - lo)]
            rows = [sketch(s) for s in sets]
            columns = [batch.column(0)[lo:hi], pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())]
            bands = []
            for r in rows:
                bands.append(band_keys(r, band))
            yield pa.RecordBatch.from_arrays([*columns, lists(bands, pa.int64())], ["doc_id", "node", "n_shingles", "sketch", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in groups(batch.column(1)):
            sets = shingle_sets(batch.column(1)[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists([s.view(np.int64) for s in sets], pa.int64())], ["node", "shingles"])


def _allowed(a: str, b: str, threshold: int) -> Column:
    """Whether two sketches may belong to sets at the threshold."""

    @F.arrow_udf(T.BooleanType())
    def allowed(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        one, two = (np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(len(x), -1) for x in (a, b))
        found, error = estimate(one, two, threshold=threshold)
        return pa.array(found + ERRORS * error >= threshold / 100)

    return allowed(a, b)


def _sizes_allow(a: Column, b: Column, threshold: int) -> Column:
    """Sets of such sizes can reach the threshold at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def _sets_for(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """node and its whole sorted set, made anew from the texts of its first document."""
    need = nodes.distinct().join(classes, "node").select("node", F.col("rep").alias("r_id"))
    found = texts.join(need, F.col("doc_id").eqNullSafe(F.col("r_id")))
    rows = found.select("node", "text").mapInArrow(_sets_of, "node binary, shingles array<long>")
    return materialize(rows, "op7-sets")


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def right(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = buffers(pc.ascii_lower(batch.column(1)))
        view = memoryview(np.ascontiguousarray(raw)).cast("B")
        nodes = batch.column(0).to_pylist()
        keep = [named(view[at[k] : at[k + 1]], hashlib.md5)[0] == nodes[k] for k in range(len(nodes))]
        return batch.filter(pa.array(keep, pa.bool_()))

    return _sets(right(b) for b in batches)


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node reachable over ``links`` (a, b).

    Nodes without links are not returned.  Each round hooks every node to the
    least label around it and then jumps to that label's label, so long chains
    shrink fast; rounds end when no label changes.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "op7-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), "op7-labels")
    spark = links.sparkSession
    while True:
        around = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        hooked = labels.join(around, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "near").alias("new"))
        # Hook the old label's own node too, so that whole trees merge at once.
        lift = hooked.groupBy(F.col("comp").alias("root")).agg(F.min("new").alias("up"))
        moved = hooked.join(lift, F.col("comp") == F.col("root")).select("node", "comp", F.least("new", "up").alias("new"))
        jump = moved.select(F.col("node").alias("j"), F.col("new").alias("j_new"))
        moved = moved.join(jump, F.col("new") == F.col("j")).select("node", "comp", F.least("new", "j_new").alias("new"))
        moved = materialize(moved, "op7-labels")
        changed = moved.where("comp != new").limit(1).count()
        release(spark, labels)
        labels = moved.select("node", F.col("new").alias("comp"))
        if not changed:
            release(spark, edges)
            return labels


def _placed(checked: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of stars with outsiders, and how each differs from its star.

    An outsider is a member in another component than its star.
    """
    own = labels.toDF("node", "comp")
    star = labels.toDF("star", "star_comp")
    placed = checked.join(own, "node", "left").join(star, "star", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "node")).withColumn("star_comp", F.coalesce("star_comp", "star"))
    placed = placed.withColumn("outside", F.col("comp") != F.col("star_comp"))
    placed = placed.withColumn("extra", F.col("n") - F.col("common")).withColumn("lost", F.col("ns") - F.col("common"))
    # A star with one member has no further pair, nor has one without outsiders.
    busy = placed.groupBy("star").agg(F.count(F.lit(1)).alias("m"), F.max("outside").alias("any")).where("m > 1 and any").select("star")
    return materialize(placed.join(busy, "star").select("star", "node", "comp", "outside", "n", "extra", "lost", "fresh"), "op7-placed")


def _second_stars(placed: DataFrame, threshold: int) -> DataFrame:
    """Pairs of each star's outsider nearest to it and the other outsiders: one pair a member."""
    out = placed.where("outside").select("star", "node", "comp", "n", (-F.col("extra") - F.col("lost")).alias("near"))
    top = out.groupBy("star").agg(F.max(F.struct("near", "node", "comp", "n")).alias("top"))
    pairs = out.join(top, "star").where((F.col("comp") != F.col("top.comp")) & _sizes_allow(F.col("n"), F.col("top.n"), threshold))
    return pairs.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()


def _further_pairs(placed: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of members of one star that may link and are in different components."""
    sides = [placed.select("star", F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("outside").alias(f"o{x}"), F.col("n").alias(f"n{x}"), F.col("extra").alias(f"e{x}"), F.col("lost").alias(f"l{x}")) for x in "ab"]
    total = F.col("na") + F.col("nb")
    # The sets differ by this at least, whatever they share of what the star lacks or they lack of it.
    unlike = F.abs(F.col("ea") - F.col("eb")) + F.abs(F.col("la") - F.col("lb"))
    fits = (F.col("ca") != F.col("cb")) & (~F.col("ob") | (F.col("a") < F.col("b"))) & (unlike * (100 + threshold) <= total * (100 - threshold))
    # Pairs that share an element which the star lacks.  Elements of the same members (those around
    # one edit) have one posting list between them, and lists of one component are not looked at.
    index = placed.select("star", F.col("node").alias("i_node"), "comp", "outside", F.explode("fresh").alias("element"))
    lists = index.groupBy("star", "element").agg(
        F.count(F.lit(1)).alias("m"), F.max("outside").alias("any"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.bit_xor(F.xxhash64("i_node")).alias("h1"), F.bit_xor(F.xxhash64("i_node", F.lit(1))).alias("h2"),
    )
    lists = lists.where("m > 1 and any and low != high").groupBy("star", "h1", "h2", "m").agg(F.min("element").alias("element")).select("star", "element")
    postings = materialize(index.join(lists, ["star", "element"]).select("star", "element", "i_node"), "op7-postings")
    # Members are joined to their postings' pairs by key, so the rows of a pair stay narrow.
    left, right = (postings.withColumnRenamed("i_node", x).join(side, ["star", x]) for x, side in zip("ab", (sides[0].where("oa"), sides[1]), strict=True))
    sharing = left.join(right, ["star", "element"]).where(fits).select("a", "b")
    # Pairs that need not: first between the few distinct sizes, then between their members.
    sizes = [x.select("star", f"n{k}", f"e{k}", f"l{k}").distinct() for k, x in zip("ab", (sides[0].where("oa"), sides[1]), strict=True)]
    apart = F.col("ea") + F.col("eb") + F.abs(F.col("la") - F.col("lb"))
    near = apart * (100 + threshold) <= total * (100 - threshold)
    possible = sizes[0].join(sizes[1], "star").where(near & _sizes_allow(F.col("na"), F.col("nb"), threshold))
    few = sides[0].where("oa").join(possible, ["star", "na", "ea", "la"]).join(sides[1], ["star", "nb", "eb", "lb"]).where(fits).select("a", "b")
    ordered = sharing.unionByName(few).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = materialize(ordered.distinct(), "op7-pairs")
    release(placed.sparkSession, postings)
    return out


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``threshold`` is the percent of the union that the intersection must reach.
    """
    spark = docs.sparkSession
    band = band_rows(threshold)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialize(texts.mapInArrow(lambda batches: _sketches(batches, band), "doc_id long, node binary, n_shingles long, sketch binary, bands array<long>").withColumn("row", F.monotonically_increasing_id()), "op7-sketches")
    reps = seen.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("low"))
    held = seen.select(F.col("node").alias("s_node"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("s_id"), "row", F.col("n_shingles").alias("n"), "sketch", "bands")
    classes = reps.join(held, (F.col("node") == F.col("s_node")) & (F.col("low") == F.col("s_id")))
    # Rows that repeat both id and words: the first stands for them.
    once = classes.groupBy("node").agg(F.min("row").alias("row"))
    classes = materialize(classes.join(once, ["node", "row"]).select("node", "rep", "n", "sketch", "bands"), "op7-classes")
    rows = classes.select("node", F.explode("bands").alias("band"))
    crowds = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialize(rows.join(crowds, "band"), "op7-members")
    rank = members.groupBy("node").agg(F.sum("members").alias("rank"))
    members = members.select("band", "node").join(rank, "node")
    stars = members.groupBy("band").agg(F.max(F.struct("rank", "node")).alias("top")).select("band", F.col("top.node").alias("star"))
    spokes = materialize(members.join(stars, "band").where("node != star").select("star", "node").distinct(), "op7-spokes")
    release(spark)
    sets = _sets_for(spokes.select(F.explode(F.array("star", "node")).alias("node")), classes, texts)
    full = spokes.join(sets.toDF("star", "x"), "star").join(sets.toDF("node", "y"), "node")
    common, n = F.size(F.array_intersect("x", "y")), F.size("y")
    prefix = (n - F.ceil(n * (threshold / 100) - 1e-9) + 1).cast("int")
    fresh = F.slice(F.array_sort(F.array_except("y", "x")), F.lit(1), prefix)
    checked = materialize(full.select("star", "node", n.alias("n"), F.size("x").alias("ns"), common.alias("common"), fresh.alias("fresh")), "op7-checked")
    linked = F.col("common") * 100 >= (F.col("n") + F.col("ns") - F.col("common")) * threshold
    links = checked.where(linked).select(F.col("star").alias("a"), F.col("node").alias("b"))
    labels = components(links)
    side = classes.select("node", "sketch")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that link: sketches must allow it, whole sets decide."""
        pairs = pairs.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b")
        pairs = materialize(pairs.where(_allowed("sa", "sb", threshold)).select("a", "b"), "op7-others")
        full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        sized = full.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), F.size("x").alias("ns"), F.size("y").alias("n"))
        out = materialize(sized.where(linked).select("a", "b"), "op7-more")
        release(spark, pairs)
        return out

    placed = _placed(checked, labels)
    outsiders = placed.where("outside").count()
    while outsiders:
        # One outsider of each star becomes its second star: a round costs a pair a member.
        more = confirmed(_second_stars(placed, threshold))
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        release(spark, labels, placed)
        labels = components(links)
        placed = _placed(checked, labels)
        before, outsiders = outsiders, placed.where("outside").count()
        if outsiders > before * (1 - GAIN):
            break
    if outsiders:
        pairs = _further_pairs(placed, threshold)
        more = confirmed(pairs)
        if more.limit(1).count():
            labels = components(links.unionByName(more))
        release(spark, pairs, placed)
    named = classes.select("node", "rep").join(labels, "node")
    lowest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "comp").select("node", "component_id")
    alone = classes.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    out = seen.select("doc_id", "node", "n_shingles").join(alone, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = materialize(out.select("doc_id", "n_shingles", component.alias("component_id")), "op7-components")
    release(spark, sets, spokes, checked)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
