"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search reads characters once.  It keeps the best path to each position that a
piece may still start from: a trie cursor runs from every such position, and dies
when no piece goes on, so the window is no longer than the longest piece.  When all
surviving paths run through one boundary, the ids before it are final and leave the
window.  Memory is bounded by the piece length for texts of any length.

Characters outside the vocabulary become byte pieces, so every text decodes to
itself.  A space is written U+2581 inside pieces; a literal U+2581 is written in
bytes, unlike the library, which would turn it into a space.

What makes a path the best depends on the model file.  A unigram model has log
probabilities, which add up.  A merge-ranked (BPE) model has none: there a path may
go on with a piece only if merging would keep it apart from the piece before it.  Of
all pieces that end at a position just one satisfies that, so each position has one
surviving back pointer, and its path is what merging makes of the text up to there.
(Pieces rank behind their parts, as in any trained file.)  The ids are the library's.

Defined results: null and empty texts have no ids and decode to an empty text.
Repeats and null ids are kept.  An empty table gives an empty result.  Other input
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.tokens import vocabulary_path
from docflow.llm.wordhash import buffers

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Scores are whole numbers of this part, so that sums are exact and ties are ties
#: wherever a search begins: of equal paths the one with the longer last piece wins.
UNIT = 1 / 65536
#: Log probability of one byte piece: below any piece's.
BYTE_SCORE = int(-25.0 / UNIT)
#: Bytes of segments, and pairs of pieces, that a worker keeps; at the bound the memo starts anew.
MEMO_BYTES = 128 << 20
MEMO_PAIRS = 200_000

_coders: dict[str, PieceCoder] = {}


class PieceCoder:
    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], merges: bool = False):
        """``pieces``: (text, id, score); ``byte_ids``: the ids of bytes 0 to 255.

        Scores are log probabilities, or with ``merges`` the higher the earlier two
        neighbours are merged into that piece.
        """
        self.byte_ids = byte_ids
        self.root: dict = {}
        for text, n, score in pieces:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = (round(score / UNIT), n, text)
        self.merges = merges
        #: When a piece of several characters is made; lower is earlier.
        self.rank = {text: -score for text, _, score in pieces if len(text) > 1}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.longest = max((len(p[0]) for p in pieces), default=1)
        self.bytes_of: dict[int, bytes] = {n: text.replace(SPACE, " ").encode() for text, n, _ in pieces}
        self.bytes_of |= {n: bytes([b]) for b, n in enumerate(byte_ids)}
        # Where no piece leads on from a character to a space, the space is a sure boundary; so is a character that only bytes write.
        joined = "".join(p[0] for p in pieces if len(p[0]) > 1)
        self.sure = not any(SPACE in text.lstrip(SPACE) for text, _, _ in pieces)
        lone = "" if "\n" in joined else "\n"
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + ("|\n" if lone else ""))
        self.joint = {text[k - 1 : k + 1] for text, _, _ in pieces for k in range(1, len(text))}
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merging joins last to make ``piece``; None if merging its characters never makes it."""
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2:
                ranks = [self.rank.get(a + b, float("inf")) for a, b in pairwise(parts)]
                least = min(ranks)
                if least == float("inf"):
                    break
                at = ranks.index(least)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging leaves two neighbouring pieces as they are.

        Merges are undone, the latest first.  Before each, the parts that touch must
        not have been due to merge: earlier than it, or as early and further left.
        """
        limit, strict = float("inf"), True
        while True:
            due = self.rank.get(left + right)
            if due is not None and (due < limit or (due == limit and not strict)):
                return False
            a = self.rank[left] if len(left) > 1 else -float("inf")
            b = self.rank[right] if len(right) > 1 else -float("inf")
            if a > b:
                limit, strict, left = a, True, self._halves(left)[1]
            elif len(right) > 1:
                limit, strict, right = b, False, self._halves(right)[0]
            else:
                return True

    def _follows(self, left: str | None, piece: str) -> bool:
        """Whether merging could have made ``piece`` behind ``left`` (None: the front)."""
        if left is None:
            return len(piece) == 1 or self._halves(piece) is not None
        found = self.pairs.get((left, piece))
        if found is None:
            found = (len(piece) == 1 or self._halves(piece) is not None) and self._apart(left, piece)
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[left, piece] = found
        return found

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of ``chars``, each as soon as all surviving paths agree on it."""
        # For each position in the window, the best path to it: score, back pointer, ids and last piece.
        best: dict[int, tuple[float, int, tuple[int, ...], str | None]] = {0: (0, -1, (), None)}
        cursors: list[tuple[int, dict]] = []
        root, merges, pairs, follows = self.root, self.merges, self.pairs, self._follows
        front = end = 0
        for c in chars:
            cursors.append((end, root))
            alive = []
            top = None
            for at in cursors:
                node = at[1].get(c)
                if node is None:
                    continue
                if "" in node:
                    piece = node[""]
                    start = at[0]
                    if not merges:
                        if top is None or best[start][0] + piece[0] > top[0]:
                            top = (best[start][0] + piece[0], start, (piece[1],), piece[2])
                    elif top is None:
                        left = best[start][3]
                        kept = pairs.get((left, piece[2]))
                        if follows(left, piece[2]) if kept is None else kept:
                            top = (0, start, (piece[1],), piece[2])
                    if len(node) > 1:
                        alive.append((start, node))
                else:
                    alive.append((at[0], node))
            if top is None or not merges:
                raw = c.encode("utf-8", "surrogatepass")
                if top is None or best[end][0] + BYTE_SCORE * len(raw) >= top[0]:
                    top = (best[end][0] + BYTE_SCORE * len(raw), end, tuple([self.byte_ids[b] for b in raw]), c)
            end += 1
            best[end] = top
            cursors = alive
            if end - front > 2 * self.longest:
                boundary = self._meet(best, front, {end, *(s for s, _ in alive)})
                if boundary > front:
                    yield from self._path(best, front, boundary)
                    for p in range(front, boundary):
                        best.pop(p, None)
                    front = boundary
        yield from self._path(best, front, end)

    @staticmethod
    def _meet(best: dict, front: int, ends: set[int]) -> int:
        """The last boundary that the paths to all ``ends`` run through."""
        while len(ends) > 1:
            last = max(ends)
            if last <= front:
                return front
            ends.remove(last)
            ends.add(max(best[last][1], front))
        return ends.pop()

    @staticmethod
    def _path(best: dict, front: int, end: int) -> list[int]:
        steps = []
        while end > front:
            end, ids = best[end][1:3]
            steps.append(ids)
        return [n for ids in reversed(steps) for n in ids]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; segments between sure boundaries are looked up."""
        if not text:
            return np.zeros(0, "<u4")
        literal = array("I", [self.byte_ids[b] for b in SPACE.encode()]).tobytes()
        parts = []
        for k, part in enumerate(text.split(SPACE)):
            if k:
                parts.append(literal)
            body = (SPACE if not k else "") + part.replace(" ", SPACE)
            for segment in self.segments.findall(body) if self.sure else [body]:
                ids = self.memo.get(segment)
                parts.append(self._segment(segment) if ids is None else ids)
        return np.frombuffer(b"".join(parts), "<u4")

    def _segment(self, segment: str) -> bytes:
        """Ids of a segment, cut once more where no piece holds the two characters that meet."""
        if len(segment) > 64:
            return array("I", self.stream(segment)).tobytes()
        joint, at, out = self.joint, 0, []
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in joint:
                out.append(segment[at:k])
                at = k
        if at:
            known = self.memo.get
            ids = b"".join([known(x) or self._segment(x) for x in (*out, segment[at:])])
        else:
            ids = array("I", self.stream(segment)).tobytes()
        if self.memo_bytes >= MEMO_BYTES:
            self.memo.clear()
            self.memo_bytes = 0
        self.memo[segment] = ids
        self.memo_bytes += 200 + len(segment) + len(ids)
        return ids

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "surrogatepass")  # without the space put in front


def load(path: str) -> PieceCoder:
    """The coder of a model file, one a worker process."""
    if path not in _coders:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [n for n in range(model.get_piece_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n) or model.is_unused(n))]
        scores = [model.get_score(n) for n in plain]
        pieces = [(model.id_to_piece(n), n, s) for n, s in zip(plain, scores, strict=True)]
        # Whole, falling numbers are ranks of merges.
        merges = all(s == int(s) for s in scores)
        _coders[path] = PieceCoder(pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], merges)
    return _coders[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            raw, at = buffers(batch.column(1))
            view = memoryview(np.ascontiguousarray(raw)).cast("B")
            for lo in range(0, len(batch), 256):
                hi = min(lo + 256, len(batch))
                ids = [coder.encode(str(view[at[k] : at[k + 1]], "utf-8")) for k in range(lo, hi)]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                values = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            at, values = np.asarray(batch.column(1).offsets), np.asarray(batch.column(1).values)
            texts = [coder.decode(values[at[k] : at[k + 1]]) for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoded(model or vocabulary_path(MODEL)), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    return tokens.select("doc_id", "ids").mapInArrow(_decoded(model or vocabulary_path(MODEL)), "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32, and sha256 of the text decoded from the ids."""
    path = model or vocabulary_path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests(batch: pa.RecordBatch, texts: pa.RecordBatch) -> pa.RecordBatch:
            at, values = np.asarray(batch.column(1).offsets), np.asarray(batch.column(1).values).astype("<u4")
            sums = [zlib.crc32(values[at[k] : at[k + 1]].data) for k in range(len(batch))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64()), texts.column(1)], ["doc_id", "n_tokens", "ids_crc32", "decoded"])

        for batch in batches:
            yield digests(batch, next(_decoded(path)(iter([batch]))))

    out = encode(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded string")
    return out.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))
