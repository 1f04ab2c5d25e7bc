"""Jaccard join of documents on word n-grams, by PartEnum signatures.

A document's set is its distinct 4-word shingles.  Sizes fall into bands so that two sets at
the threshold are in the same band or in neighbours; each set makes signatures for its own
band and for the next.  In a band whose sets have ``high`` elements at most, two sets at the
threshold differ in ``k = 2 * high * (1 - t) / (1 + t)`` elements at most.

1. *Signatures.*  A band parts the domain of all shingles by a hash: on the first level into
   ``(k + 1) / 2`` parts, of which one must hold at most one of the ``k`` differences, and each
   of those into two, of which one must then hold none.  So the subsets to enumerate are the
   single parts of the second level: sets at the threshold agree on one of them, and the hash
   of the elements there is a signature that both have.
   A part without elements says nothing and gives no signature.  In bands of up to
   :data:`REHASHED` parts the whole set is parted again in its stead, by a hash of that part's
   own; after :data:`DEPTH` levels, or where parts hold few elements, each element is a signature.  In larger bands, a pair that
   agrees on empty parts alone must spread its differences over all others one by one, which
   has a probability under 1e-14.
2. Signatures are counted by 40 of their bits, one narrow row a signature and task.  Those that occur twice set
   the bits of a map of fixed size; only documents that have such a signature go on, with those
   signatures alone, one document for equal words (a *class*).
3. Of the members of a signature, the *star* is the one whose signatures are the most populous.  A class has a
   *sketch*, the parity of its elements in some bits an element.  Two sketches differ in no more bits than their sets
   in elements, so a pair whose sketches differ in more than ``k`` bits is ruled out with certainty, without its texts.
   Every class is compared with its stars so, and what is left on whole sets, for which texts travel to their stars.
   Members that do not end in their star's component (*outsiders*) meet the star's other members by their
   sketches, in blocks of bounded size; only pairs that these allow leave the join and are compared on whole sets.
   So groups of copies cost a comparison a member, and no link between different texts is lost.
4. Components come from label propagation over the confirmed links.

Defined results: null and empty texts, and those of white space alone, have an empty set and
link with nothing; texts with fewer than four words have the whole sequence as their one
shingle.  A null ``doc_id`` counts only where all its class has none.  Rows that repeat a
``doc_id`` share its component only through their texts.  An empty table gives an empty
result.  Other input columns are ignored.  Sets are compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import materialize, release
from docflow.llm.minhash_dedup import _sizes_allow, components, shingle_sets
from docflow.llm.wordhash import buffers, groups, lists, mix, named
from docflow.operators.bits import bit_map, in_map

SHINGLE = 4
#: Percent of the union that the intersection must reach.
THRESHOLD = 85
#: Parts of a band up to which a part without elements is made up for, and levels of that.
REHASHED = 32
DEPTH = 6
#: Elements a part, in the largest sets of a band, below which the elements themselves are the signatures then.
SPARSE = 4
#: Bits of the map of shared signatures, as a power of two (8 MB).
MAP_BITS = 26
#: Bits of a signature that are counted; those of the map are among them, the rest tells apart what shares a bit there.
COUNTED = 40
#: Words of 64 bits of the least sketch, which is what outsiders are first compared by; a sketch has two bits an element at least.
WORDS = 8
#: Outsiders of a star that meet its members in one block.
BLOCK = 1000

_SEED, _PATH, _VALUE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def bands(largest: int, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """The first and last size of each band, one beyond that of ``largest``."""
    out, low = [], 1
    while len(out) < 2 or out[-2][1] < largest:
        high = low * 100 // threshold
        out.append((low, high))
        low = high + 1
    return out


def parts_of(high: int, threshold: int = THRESHOLD) -> int:
    """Parts on both levels of a band of sets of up to ``high`` elements."""
    k = 2 * high * (100 - threshold) // (100 + threshold)
    return 2 * -(-(k + 1) // 2) if k else 1


def _parted(values: np.ndarray, parts: np.ndarray | np.uint64, path: np.ndarray | np.uint64) -> np.ndarray:
    """The part of each element, by a hash that depends on ``path``."""
    return ((mix(values ^ path) >> np.uint64(32)) * parts) >> np.uint64(32)


def _anew(values: np.ndarray, parts: int, high: int, path: np.uint64, depth: int) -> list[np.ndarray]:
    """Signatures of one set of a band in place of those of an empty part that ``path`` names."""
    if depth == DEPTH or parts * SPARSE > high:
        return [mix(mix(values + _VALUE) + path)]
    at = _parted(values, np.uint64(parts), path).astype(np.int64)
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, at, mix(values + _VALUE))
    with np.errstate(over="ignore"):
        names = mix(path * _PATH + np.arange(parts, dtype=np.uint64))
    full = np.bincount(at, minlength=parts) > 0
    out = [mix(sums[full] + names[full])]
    for name in names[~full]:
        out += _anew(values, parts, high, name, depth + 1)
    return out


def signatures(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[np.ndarray]:
    """The PartEnum signatures of each set of hashes, for its own band and the next."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own = bands(int(sizes.max(initial=1)), threshold)
    highs = np.array([b[1] for b in own])
    counts = np.array([parts_of(b[1], threshold) for b in own], np.int64)
    out: list[list[np.ndarray]] = [[] for _ in sets]
    live = np.flatnonzero(sizes)
    if not len(live):
        return [np.zeros(0, np.uint64) for _ in sets]
    values = np.concatenate([sets[k] for k in live])
    owner = np.repeat(np.arange(len(live)), sizes[live])
    elements = mix(values + _VALUE)
    for step in (0, 1):
        band = np.searchsorted(highs, sizes[live]) + step
        parts = counts[band]
        path = mix((band + 1).astype(np.uint64) * _SEED)
        first = np.concatenate([[0], np.cumsum(parts)])
        at = first[owner] + _parted(values, parts.astype(np.uint64)[owner], path[owner]).astype(np.int64)
        sums = np.zeros(first[-1], np.uint64)
        np.add.at(sums, at, elements)
        full = np.bincount(at, minlength=len(sums)) > 0
        holder = np.repeat(np.arange(len(live)), parts)
        names = mix(path[holder] * _PATH + (np.arange(len(sums)) - first[holder]).astype(np.uint64))
        found = mix(sums + names)
        cuts = np.concatenate([[0], np.cumsum(full)])[first]
        found = found[full]
        for k, doc in enumerate(live):
            out[doc].append(found[cuts[k] : cuts[k + 1]])
        for gap in np.flatnonzero(~full & (parts <= REHASHED)[holder]):
            k = holder[gap]
            out[live[k]] += _anew(sets[live[k]], int(parts[k]), int(highs[band[k]]), names[gap], 1)
    return [np.unique(np.concatenate(s)) if s else np.zeros(0, np.uint64) for s in out]


def sketch(values: np.ndarray) -> np.ndarray:
    """The parity of a set's elements in each of ``64 * WORDS`` bits, or twice, four times as many for larger sets."""
    words = WORDS
    while words * 32 < len(values):
        words *= 2
    at = (mix(values) & np.uint64(words * 64 - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=words * 64) & 1).astype(np.uint8), bitorder="little").view("<i8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer words: bits that share a place there are added."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def _signed(width: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in groups(batch.column(1)):
                texts = batch.column(1)[lo:hi]
                sets = shingle_sets(texts, width)
                found = [s.view(np.int64) for s in signatures(sets, threshold)]
                columns = [batch.column(0)[lo:hi], pa.array(_nodes(texts), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists(found, pa.int64()), lists([sketch(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n_shingles", "signatures", "sketch"])

    return run


def _nodes(texts: pa.Array) -> list[bytes]:
    """Digests of the words of each text, one for each class."""
    raw, at = buffers(pc.ascii_lower(texts))
    view = memoryview(np.ascontiguousarray(raw)).cast("B")
    return [named(view[at[k] : at[k + 1]], hashlib.md5)[0] for k in range(len(texts))]


def _shared_only(words: np.ndarray, copies: np.ndarray):
    """Documents with signatures in the map, those signatures, and whether the other map may have the document as a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            good = in_map(own, words) if len(own) else np.zeros(0, bool)
            cuts = np.concatenate([[0], np.cumsum(good)])[np.cumsum(sizes)]
            keep = np.diff(cuts, prepend=0) > 0
            left = np.split(own[good], cuts[:-1]) if len(sizes) else []
            rows = pa.array(np.flatnonzero(keep))
            copy = in_map(batch.column(1).to_numpy()[keep], copies)
            columns = [batch.column(0).take(rows), pa.array(copy), lists([x for x, k in zip(left, keep, strict=True) if k], pa.int64()), batch.column(3).take(rows), batch.column(4).take(rows)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "copy", "signatures", "n", "sketch"])

    return run


def _needed(words: np.ndarray):
    """Texts whose document the map has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(in_map(batch.column(0).to_numpy(), words))).select(["doc_id", "text"])

    return run


def _same_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have the words of the class that asks for them; ids may repeat with other words."""
    for batch in batches:
        for lo, hi in groups(batch.column(3)):
            part = batch.slice(lo, hi - lo)
            same = [a == b for a, b in zip(_nodes(part.column(3)), part.column(1).to_pylist(), strict=True)]
            yield part.filter(pa.array(same, pa.bool_())).select(["node", "stars", "text"])


def _against_star(width: int):
    """How the set of each text differs from that of its star's text, which stands beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            for lo, hi in groups(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                sizes, extras, offs = [], [], []
                for k, (own, y) in enumerate(zip(part.column(0).to_pylist(), shingle_sets(part.column(2), width), strict=True)):
                    if own != star:  # rows of a star stand together
                        star, x = own, shingle_sets(part.column(3)[k : k + 1], width)[0]
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    shared = x[at] == y
                    inside = np.zeros(len(x), bool)
                    inside[at[shared]] = True
                    common = int(shared.sum())
                    has = common * 2 < len(x)
                    sizes.append((len(y), len(x), common, has))
                    extras.append(y[~shared].view(np.int64))
                    offs.append(x[inside == has].view(np.int64))
                n, ns, common, has = zip(*sizes, strict=True)
                columns = [part.column(0), part.column(1), *(pa.array(c, pa.int32()) for c in (n, ns, common)), lists(extras, pa.int64()), pa.array(has, pa.bool_()), lists(offs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["star", "node", "n", "ns", "common", "extra", "has", "off"])

    return run


def _named_in(words: np.ndarray) -> Callable[[Column], Column]:
    """Whether the map may have a hash: only the hash goes to Python, not the row."""

    @F.arrow_udf("boolean")
    def named_in(hashes: pa.Array) -> pa.Array:
        return pa.array(in_map(hashes.to_numpy(zero_copy_only=False), words))

    return named_in


def _sketches_allow(threshold: int) -> Callable[..., Column]:
    """Whether sets of such sizes and sketches can reach the threshold at all."""

    @F.arrow_udf("boolean")
    def allow(total: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        unlike = np.zeros(len(total), np.int64)
        for k in range(len(total)):
            x, y = (side[k].values.to_numpy() for side in (a, b))
            least = min(len(x), len(y))
            unlike[k] = np.bitwise_count((folded(x, least) ^ folded(y, least)).view(np.uint64)).sum()
        return pa.array(unlike * (100 + threshold) <= total.to_numpy() * (100 - threshold))

    return allow


def _least(column: str) -> Column:
    """Sketches of the least size."""

    @F.arrow_udf("array<long>")
    def least(sketches: pa.Array) -> pa.Array:
        return lists([folded(sketches[k].values.to_numpy(), WORDS) for k in range(len(sketches))], pa.int64())

    return least(column)


def _outsider_pairs(spokes: DataFrame, labels: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of members of one star, one of them in another component than it and the other, that least sketches allow."""
    placed = spokes.join(labels.toDF("node", "comp"), "node", "left").join(labels.toDF("star", "star_comp"), "star", "left")
    comp = F.coalesce("comp", "node")
    placed = placed.select("star", "node", comp.alias("comp"), (comp != F.coalesce("star_comp", "star")).alias("outside"))
    # A star with one member has no further pair, nor has one without outsiders.
    busy = placed.groupBy("star").agg(F.count(F.lit(1)).alias("m"), F.count_if("outside").alias("out")).where("m > 1 and out > 0")
    blocks = F.floor((F.col("out") - 1) / BLOCK)
    placed = placed.join(busy.select("star", blocks.alias("last")), "star").join(sketches, "node")
    placed = materialize(placed.select("star", "node", "comp", "outside", "last", "n", _least("sketch").alias("least")), "op11-placed")
    bits = [f"w{k}" for k in range(WORDS)]
    side = lambda x: [F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("outside").alias(f"o{x}"), *(F.col("least")[k].alias(f"{x}{w}") for k, w in enumerate(bits))]
    left = placed.where("outside").select("star", F.pmod(F.xxhash64("node"), F.col("last") + 1).alias("block"), *side("a"))
    right = placed.select("star", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"), *side("b"))
    unlike = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in bits), F.lit(0))
    fits = (F.col("ca") != F.col("cb")) & (~F.col("ob") | (F.col("a") < F.col("b"))) & _sizes_allow(F.col("na"), F.col("nb"), threshold)
    fits = fits & (unlike * (100 + threshold) <= (F.col("na") + F.col("nb")) * (100 - threshold))
    pairs = left.join(right, ["star", "block"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = materialize(pairs, "op11-pairs")
    release(spokes.sparkSession, placed)
    return out


def ngram_join(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents link when ``100 * intersection >= threshold * union`` of their ``width``-word
    shingles; ``component_id`` is the least ``doc_id`` that links reach.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_signed(width, threshold), "doc_id long, node binary, n_shingles long, signatures array<long>, sketch array<long>")
    seen = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "op11-signed")
    shared = bit_map(_repeated(seen), MAP_BITS)
    release(spark)
    # From here a class goes by the row of its first document.
    reps = seen.where("n_shingles > 0").groupBy(F.col("node").alias("name")).agg(F.min("doc_id").alias("rep"), F.min("row").alias("node"))
    reps = materialize(reps, "op11-classes")
    # Only what may be a copy is looked up among the first documents, so the signatures of others stay where they are.
    firsts = reps.select(F.col("node").alias("first"))
    copies = bit_map(seen.join(firsts, F.col("row") == F.col("first"), "left_anti").select(F.xxhash64("row").alias("h")), MAP_BITS)
    held = seen.select("row", F.xxhash64("row").alias("h"), "signatures", "n_shingles", "sketch").mapInArrow(_shared_only(shared, copies), "node long, copy boolean, signatures array<long>, n long, sketch array<long>")
    held = materialize(held, "op11-held")
    first = held.where("copy").join(firsts, F.col("node") == F.col("first"), "left_semi")
    # The signatures of all documents are not read again.
    wide, seen = seen, materialize(seen.select("doc_id", "node", "n_shingles"), "op11-seen")
    release(spark, wide)
    own = held.where("not copy").unionByName(first).select("node", F.explode("signatures").alias("signature"))
    crowds = own.groupBy("signature").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialize(own.join(crowds, "signature"), "op11-members")
    rank = members.groupBy("node").agg(F.sum("members").alias("rank"))
    ranked = members.select("signature", "node").join(rank, "node")
    stars = ranked.groupBy("signature").agg(F.max(F.struct("rank", "node")).alias("top")).select("signature", F.col("top.node").alias("star"))
    spokes = materialize(members.select("signature", "node").join(stars, "signature").where("node != star").select("star", "node").distinct(), "op11-spokes")
    words = bit_map(spokes.select("star").union(spokes.select("node")).select(F.xxhash64("star").alias("h")), MAP_BITS)
    sketches = materialize(held.where(_named_in(words)(F.xxhash64("node"))).select("node", "n", "sketch"), "op11-sketches")
    release(spark, held, members)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: sketches must allow it, whole sets decide."""
        both = pairs.join(sketches.toDF("a", "a_n", "a_sketch"), "a").join(sketches.toDF("b", "b_n", "b_sketch"), "b")
        allowed = _sizes_allow(F.col("a_n"), F.col("b_n"), threshold) & _sketches_allow(threshold)(F.col("a_n") + F.col("b_n"), "a_sketch", "b_sketch")
        asked = materialize(both.where(allowed).select(F.col("a").alias("star"), F.col("b").alias("node")), "op11-asked")
        found = _texts_of(asked, seen, reps, texts)
        whole = found.where(F.array_contains("stars", F.col("node"))).select(F.col("node").alias("star"), F.col("text").alias("x"))
        full = found.select(F.explode("stars").alias("star"), "node", F.col("text").alias("y")).where("star != node").join(whole, "star")
        full = full.select("star", "node", "y", "x").mapInArrow(_against_star(width), "star long, node long, n int, ns int, common int, extra array<long>, has boolean, off array<long>")
        checked = materialize(full, "op11-checked")
        release(spark, asked, found)
        return checked.where(F.col("common") * 100 >= (F.col("n") + F.col("ns") - F.col("common")) * threshold).select(F.col("star").alias("a"), F.col("node").alias("b"))

    links = confirmed(spokes.toDF("a", "b"))
    labels = components(links)
    pairs = _outsider_pairs(spokes, labels, sketches, threshold)
    if pairs.limit(1).count():
        labels = components(links.unionByName(confirmed(pairs)))
    release(spark, pairs)
    lowest = reps.select("name", "node", "rep").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = lowest.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named_at = lowest.join(least, "comp").select("name", "component_id")
    out = seen.select("doc_id", "node", "n_shingles").join(named_at, F.col("node") == F.col("name"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = materialize(out.select("doc_id", "n_shingles", component.alias("component_id")), "op11-components")
    release(spark, seen, reps, spokes, sketches, links, labels)
    return out


def _repeated(seen: DataFrame) -> DataFrame:
    """The signatures that occur twice, without the bits that neither count nor map tell apart: a few more may be among them."""
    top, low = COUNTED - 6, F.lit(63).cast("long")
    signature = F.col("signature")
    brief = F.shiftleft(F.shiftrightunsigned(signature, 64 - top), 6).bitwiseOR(signature.bitwiseAND(low))
    many = seen.select(F.explode("signatures").alias("signature")).groupBy(brief.alias("brief")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return many.select(F.shiftleft(F.shiftright("brief", 6), 64 - top).bitwiseOR(F.col("brief").bitwiseAND(low)).alias("signature"))


def _texts_of(spokes: DataFrame, seen: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """node, its stars and the text of its first document; stars are among their own."""
    asked = spokes.select("node", "star").unionByName(spokes.select(F.col("star").alias("node"), "star")).distinct()
    asked = asked.groupBy("node").agg(F.collect_list("star").alias("stars"))
    need = materialize(asked.join(reps, "node").select("node", "name", F.col("rep").alias("r_id"), "stars"), "op11-need")
    words = bit_map(need.select(F.xxhash64("r_id").alias("h")), MAP_BITS)
    some = texts.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text").mapInArrow(_needed(words), "doc_id long, text string")
    found = some.join(need, F.col("doc_id").eqNullSafe(F.col("r_id"))).select("node", "name", "stars", "text")
    found = found.mapInArrow(_same_words, "node long, stars array<long>, text string")
    # Rows that repeat both id and words stand there again.
    repeats = seen.groupBy("node", "doc_id").count().where("count > 1").limit(1).count()
    out = materialize(found.dropDuplicates(["node"]) if repeats else found, "op11-texts")
    release(texts.sparkSession, need)
    return out
