"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE file, tokenizer B a SentencePiece model that puts a space
before the text; so A gets space + text, and the tokens of both spell the same bytes.

The tokens of a whole batch stand behind each other on one line of bytes.  The ends of A's
tokens and of B's are counted once over that line; where both occur, a *group* ends.  The
stretches between neighbouring ends of either kind are the *links*: each lies in exactly one
token of A and one of B.  Running counts of ends give every link its two tokens and its
group, their differences at document ends the documents' own results.

A pair of ids counts in how many documents it is linked.  Counting shuffles one row a pair
and task.  To give counts back to the documents, the most frequent pairs (at most
:data:`FREQUENT`, so their table has a fixed bound) are looked up where the documents lie;
only links of rarer pairs are shuffled, and no pair there is a hot key.

The libraries make all ids.  A space between two visible characters begins a token in both
vocabularies, so a text is tokenized in parts between such spaces and each worker keeps the
ids of parts that it has seen, within a bound of bytes.

Defined results: texts that are null or empty, or whose joined A or B bytes differ from
space + text (B cannot tell a literal U+2581 from a space), have no tokens: zeros and an empty
string.  Rows that repeat a ``doc_id``, or have none, are documents of their own.  Texts of
any length are taken whole.  An empty table gives an empty result.  Other input columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import materialize, release
from docflow.llm.tokens import vocabulary_path
from docflow.llm.wordhash import groups, lists

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Pairs at most that every task looks up in memory (24 bytes each).
FREQUENT = 1 << 20
#: Bytes of one of a worker's two memos of parts, and of an entry beside its ids.
MEMO_BYTES = 96 << 20
_ENTRY = 330
#: A space between two visible characters.
_CUT = re.compile("(?<=[^\\s\u180e\u200b\u2581]) (?=[^\\s\u180e\u200b\u2581])")
#: Where spaces may stand beside something else, so that not each of them is such a space.
_OTHER = re.compile("  |\n | \n|^ | $|[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2581\u3000]")

_coders: dict[tuple[str, str], Coders] = {}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible characters of Latin-1 stand for themselves, the other bytes for the characters
    from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Spelled(NamedTuple):
    """Ids of tokens on both sides, and whether both spell the text's bytes."""

    a: np.ndarray
    b: np.ndarray
    good: bool


class Coders:
    """Both tokenizers of a worker, the bytes of their tokens, and a memo of parts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        values = byte_level()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.memo: dict[str, tuple[bytes, bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bytes, bool]] = {}
        self.held = 0
        # Decimal names with what may stand behind them.
        self.names_a = [np.array([f"{k}{end}".encode() for k in range(len(self.bytes_a))], object) for end in ",|"]
        self.names_b = [np.array([f"{k}{end}".encode() for k in range(len(self.bytes_b))], object) for end in ",;"]

    def _piece(self, k: int) -> bytes:
        if self.b.is_byte(k):
            return bytes([int(self.b.id_to_piece(k)[3:-1], 16)])
        return self.b.id_to_piece(k).replace("\u2581", " ").encode()

    def _encode(self, parts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        bodies = [b" " + p.encode() for p in parts]
        good = self._spell(ids_a, self.bytes_a, bodies) & self._spell(ids_b, self.bytes_b, bodies)
        return [(array("I", a).tobytes(), array("I", b).tobytes(), g) for a, b, g in zip(ids_a, ids_b, good.tolist(), strict=True)]

    @staticmethod
    def _spell(ids: list[list[int]], table: list[bytes], bodies: list[bytes]) -> np.ndarray:
        """Whether each row of ids spells its body."""
        return np.array([b"".join([table[k] for k in own]) == body for own, body in zip(ids, bodies, strict=True)], bool)

    def spelled(self, texts: list[str]) -> list[Spelled]:
        """The tokens of each text."""
        parts = [(_CUT.split(t) if _OTHER.search(t) else t.split(" ")) if t else [] for t in texts]
        if self.held > MEMO_BYTES:
            self.older, self.memo, self.held = self.memo, {}, 0
        todo = []
        for p in set().union(*parts).difference(self.memo):
            if (known := self.older.get(p)) is None:
                todo.append(p)
            else:
                self._keep(p, known)
        for at in range(0, len(todo), 5000):
            some = todo[at : at + 5000]
            for p, known in zip(some, self._encode(some), strict=True):
                self._keep(p, known)
        out = []
        for text, own in zip(texts, parts, strict=True):
            ids_a, ids_b, good = zip(*map(self.memo.__getitem__, own), strict=True) if own else ((), (), (False,))
            if own and not all(good):  # some part is not spelled: the whole text decides
                ids_a, ids_b, good = zip(*self._encode([text]), strict=True)
            out.append(Spelled(np.frombuffer(b"".join(ids_a), "<u4"), np.frombuffer(b"".join(ids_b), "<u4"), all(good)))
        return out

    def _keep(self, part: str, known: tuple[bytes, bytes, bool]) -> None:
        self.memo[part] = known
        self.held += _ENTRY + len(part) + len(known[0]) + len(known[1])


def coders(path_a: str, path_b: str) -> Coders:
    """One a worker process."""
    if (path_a, path_b) not in _coders:
        _coders[path_a, path_b] = Coders(path_a, path_b)
    return _coders[path_a, path_b]


class Aligned(NamedTuple):
    """Links of a batch by their place, and each document's bounds in them."""

    a: np.ndarray  # the place of the link's token of A in the batch
    b: np.ndarray
    group: np.ndarray
    ends_group: np.ndarray  # whether a group ends with the link
    documents: np.ndarray  # n + 1 bounds of the documents' links


def align(sizes_a: np.ndarray, sizes_b: np.ndarray, bytes_each: np.ndarray) -> Aligned:
    """Links and groups of token sizes that spell documents of ``bytes_each`` bytes on both sides."""
    bounds = np.concatenate([[0], np.cumsum(bytes_each)])
    total = int(bounds[-1])
    at_a, at_b = (np.bincount(np.cumsum(s), minlength=total + 1).astype(bool) for s in (sizes_a, sizes_b))
    ends = np.flatnonzero(at_a | at_b)
    end_a, end_b = at_a[ends], at_b[ends]
    both = end_a & end_b
    before = lambda flags: np.cumsum(flags) - flags
    return Aligned(before(end_a), before(end_b), before(both), both, np.searchsorted(ends, bounds, "right"))


def _rows(path_a: str, path_b: str):
    def part(ids: pa.Array, texts: pa.Array, coder: Coders) -> pa.RecordBatch:
        spelled = coder.spelled(["" if t is None else t for t in texts.to_pylist()])
        keep = [s for s in spelled if s.good]
        place = np.cumsum([0, *[s.good for s in spelled]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *[getattr(s, k).astype(np.int64) for s in keep]]) for k in "ab")
        bytes_each = np.array([int(coder.sizes_a[s.a].sum()) for s in keep], np.int64)
        found = align(coder.sizes_a[a], coder.sizes_b[b], bytes_each)
        n_a, n_b = (np.array([len(getattr(s, k)) for s in keep], np.int64) for k in "ab")
        at = found.documents
        n_groups = np.add.reduceat(np.append(found.ends_group, 0), at[:-1]) if len(keep) else np.zeros(0, np.int64)
        # Names in the order of the printed groups: a group's tokens of A, then those of B.
        last = np.flatnonzero(found.ends_group)
        ends_a, ends_b = found.a[last] + 1, found.b[last] + 1
        sizes = [np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)]
        names = np.empty(len(a) + len(b), object)
        group_a, group_b = (np.repeat(np.arange(len(last)), s) for s in sizes)
        for own, ids_, group, ends, tables in ((np.arange(len(a)) + (ends_b - sizes[1])[group_a], a, group_a, ends_a, coder.names_a), (np.arange(len(b)) + ends_a[group_b], b, group_b, ends_b, coder.names_b)):
            words = tables[0][ids_]
            words[ends - 1] = tables[1][ids_[ends - 1]]
            names[own] = words
        texts_at = np.concatenate([[0], np.cumsum(n_a + n_b)])
        digests = [hashlib.sha256(b"".join(names[lo:hi].tolist())[:-1]).hexdigest() for lo, hi in zip(texts_at[:-1], texts_at[1:], strict=True)]
        # Distinct pairs of each document, and how often each is linked.
        width = len(coder.bytes_b)
        pairs = a[found.a] * width + b[found.b]
        span = len(coder.bytes_a) * width
        owner = np.repeat(np.arange(len(keep)), np.diff(at))
        keys, times = np.unique(owner * span + pairs, return_counts=True)
        cuts = np.searchsorted(keys // span, np.arange(len(keep) + 1))
        none = np.zeros(0, np.int64)
        per = lambda values: [int(values[place[k]]) if s.good else 0 for k, s in enumerate(spelled)]
        held = lambda values: [values[cuts[place[k]] : cuts[place[k] + 1]] if s.good else none for k, s in enumerate(spelled)]
        columns = [ids, *[pa.array(per(v), pa.int64()) for v in (n_a, n_b, n_groups, np.diff(at))], pa.array([digests[place[k]] if s.good else "" for k, s in enumerate(spelled)]), lists(held(keys % span), pa.int64()), lists(held(times), pa.int64()).cast(pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in groups(batch.column(1), 2 << 20):
                yield part(batch.column(0)[lo:hi], batch.column(1)[lo:hi], coders(path_a, path_b))

    return run


def _frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least number of documents that at most ``most`` pairs reach, and those pairs, by pair."""
    bins = counts.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("bin")).count().orderBy(F.desc("bin")).collect()
    least, held = 63, 0
    for row in bins:  # one a power of two
        if held + row["count"] > most:
            break
        least, held = row["bin"], held + row["count"]
    top = counts.where(F.floor(F.log2("n_docs")) >= least).select("pair", "n_docs", "best").toArrow().sort_by("pair")
    return (1 << least, *[top.column(k).to_numpy() for k in range(3)])


def _looked_up(frequent: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Sums over a document's links of frequent pairs, and its other pairs."""
    pairs, n_docs, best = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, times = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), sizes)
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            known = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            sums = np.zeros((2, len(batch)), np.int64)
            np.add.at(sums[0], owner[known], times[known] * n_docs[at[known]])
            np.add.at(sums[1], owner[known], times[known] * best[at[known]])
            cuts = np.searchsorted(owner[~known], np.arange(1, len(batch)))
            rest = [lists(np.split(v[~known], cuts), pa.int64()) for v in (own, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1]), *rest], ["row", "count_sum", "n_best", "pairs", "times"])

    return run


def align_tokens(docs: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    path_a, path_b = vocabulary_a or vocabulary_path(VOCABULARY_A), vocabulary_b or vocabulary_path(VOCABULARY_B)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    seen = materialize(texts.mapInArrow(_rows(path_a, path_b), schema).withColumn("row", F.monotonically_increasing_id()), "op12-links")
    width = _width(path_b)
    counted = seen.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = materialize(counted.withColumn("a", F.expr(f"pair div {width}")), "op12-counted")
    tops = counted.groupBy("a").agg(F.max("n_docs").alias("top"))
    counts = materialize(counted.join(tops, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("top")).cast("long").alias("best")), "op12-counts")
    _, *table = _frequent(counts, frequent)
    looked = seen.select("row", "pairs", "times").mapInArrow(_looked_up(tuple(table)), "row long, count_sum long, n_best long, pairs array<long>, times array<long>")
    looked = materialize(looked, "op12-looked")
    rare = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    rare = rare.join(counts, F.col("pairs") == F.col("pair")).groupBy("row").agg(F.sum(F.col("times") * F.col("n_docs")).alias("rare_sum"), F.sum(F.col("times") * F.col("best")).alias("rare_best"))
    sums = looked.select("row", "count_sum", "n_best").join(rare, "row", "left")
    sums = sums.select(F.col("row").alias("s_row"), (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"))
    out = seen.drop("pairs", "times").join(sums, F.col("row") == F.col("s_row"))
    out = materialize(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "op12-aligned")
    release(spark, seen, counted, counts, looked)
    return out


def _width(path_b: str) -> int:
    """Pieces of the SentencePiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
