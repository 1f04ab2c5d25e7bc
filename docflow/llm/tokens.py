"""Token ids of whole texts with a public tokenizer, memoised by part.

The tokenizer drops white space and parts a text into letters, digits and marks
before it merges, so a text's ids are the ids of its parts in a row.  Parts
recur, so each Python worker keeps those it has seen.  The library makes all
ids; the memo only spares it repeated work.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

from docflow.llm.wordhash import buffers

#: Bytes of parts and their ids in one of a worker's two memos.  When the younger is full, the
#: older goes; parts that recur move from it to the younger, so frequent ones stay.
MEMO_BYTES = 128 << 20
#: Bytes of an entry beside its text and ids.
_ENTRY = 200
VOCABULARY = "word_bpe_49k.json"
END_ID = 1

#: Texts of ASCII and Latin letters without quotes and control characters: these
#: characters lower-case one by one and never compose, so their parts are plain.
_PLAIN = re.compile(r"[\t-\r !-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_WORD = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_PART = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

_encoders: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of texts as little-endian unsigned bytes, 2 or 4 an id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.code = "H" if self.model.get_vocab_size() <= 65536 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_bytes = 0
        ids = [self.model.encode(x, add_special_tokens=False).ids for x in ("Word x,! 1", "word", "x", ",!", "1")]
        #: Whether white space is dropped and letters are lower-cased and parted from marks; else texts are encoded whole.
        self.parted = ids[0] == sum(ids[1:], [])

    def parts(self, text: str) -> list[str]:
        if not self.parted:
            return [text]
        if "<|" not in text and _PLAIN.fullmatch(text):
            return _PART.findall(text.lower())
        return [c.decode() for c in text.encode().split()]  # ASCII white space: every other character stays in its chunk

    def _keep(self, parts: list[str], ids: list[bytes]) -> None:
        if not ids:
            return
        self.memo.update(zip(parts, ids, strict=True))
        self.memo_bytes += _ENTRY * len(ids) + sum(map(len, parts)) + sum(map(len, ids))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded as one text and cut where the library says a word begins; none if it sees other words."""
        found = self.model.encode(" ".join(words), add_special_tokens=False)
        cuts = np.flatnonzero(np.diff(np.array(found.word_ids, np.int64), prepend=-1))
        if len(cuts) != len(words):
            return []
        raw = np.array(found.ids, self.kind).tobytes()
        at = [*(cuts * self.kind.itemsize).tolist(), len(raw)]
        return [raw[a:b] for a, b in pairwise(at)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.parts(t) for t in texts]
        if self.memo_bytes > MEMO_BYTES:
            self.older, self.memo, self.memo_bytes = self.memo, {}, 0
        todo = []
        for p in set().union(*parts).difference(self.memo):
            if (ids := self.older.get(p)) is None:
                todo.append(p)
            else:
                self._keep([p], [ids])
        plain = [p for p in todo if self.parted and _WORD.fullmatch(p)]
        for some, ids in ((x, self._words(x)) for x in (plain[k : k + 10_000] for k in range(0, len(plain), 10_000))):
            self._keep(some, ids)
        rest = [p for p in todo if p not in self.memo]
        for k in range(0, len(rest), 10_000):
            some = rest[k : k + 10_000]
            self._keep(some, [array(self.code, e.ids).tobytes() for e in self.model.encode_batch_fast(some, add_special_tokens=False)])
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, own)), self.kind) for own in parts]
        if not self.parted:
            self.memo.clear()
            self.memo_bytes = 0
        return out


def encoder(path: str) -> Encoder:
    """One a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batch_texts: pa.Array, path: str, end_id: int | None = END_ID, group_bytes: int = 4 << 20) -> Iterator[np.ndarray]:
    """The ids of each text in turn as uint32, ``end_id`` behind them."""
    coder = encoder(path)
    raw, at = buffers(batch_texts)
    view = memoryview(np.ascontiguousarray(raw)).cast("B")
    tail = np.array([] if end_id is None else [end_id], "<u4")
    k = 0
    while k < len(at) - 1:
        last = max(k + 1, int(np.searchsorted(at, at[k] + group_bytes, "right")) - 1)
        for ids in coder.encode([str(view[at[i] : at[i + 1]], "utf-8") for i in range(k, last)]):
            yield np.concatenate([ids.astype("<u4"), tail])
        k = last
