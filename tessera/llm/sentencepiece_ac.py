"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a text once. At each position its output links list every piece that ends there, longest first, and
the best state of the position is relaxed from the state where that piece starts. For unigram models the state is the
best sum of scores (Viterbi). BPE models have no additive score: there the state is the last piece of the only merge
sequence that ends here, and a piece relaxes it only if it may follow the last piece of the state where it starts: that
is, if merging the two pieces' characters gives back just these two. One left-to-right pass so gives the ids that the merge
rules give. Characters in no piece become byte pieces, or one unknown id for a run of them.

Words (a run of blanks and what follows) of BPE models are encoded once per worker and looked up after that: no piece spans the start of a
blank run, which is checked when the model is loaded. Unigram texts are read whole: their sums are kept in single precision from the first
character on, as the library does, so that equal scores fall the same way.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_ids import small_batches
from .common import tune

BLANK = "▁"
#: Words that a worker remembers.
REMEMBER = 1_200_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised protocol buffer message."""
    p = 0

    def varint() -> int:
        nonlocal p
        out = shift = 0
        while True:
            b = raw[p]
            p += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while p < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[p : p + size]
            p += size


class Model:
    """Pieces, scores and rules of a model file; encodes and decodes texts."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        message = list(_fields(sp.serialized_model_proto()))
        trainer = dict(_fields(next(v for k, v in message if k == 2)))
        normal = dict(_fields(next(v for k, v in message if k == 3)))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2) or normal.get(2):
            raise ValueError("only unigram and BPE models without a character map are supported")
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in range(n)) else []
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.scores = {self.pieces[i]: sp.get_score(i) for i in usual}
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        self.single = {i: np.float32(sp.get_score(i)) for i in usual}
        self.letters = {c for p in self.scores for c in p}
        self.by_word = self.bpe and not any(re.search(f"[^{BLANK}]{BLANK}", p) or "\n" in p for p in self.scores)
        automaton = ahocorasick.Automaton()
        for i in usual:
            automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
        automaton.make_automaton()
        self.automaton = automaton
        self.text_of = [b"" if sp.is_control(i) else bytes([self.byte_ids.index(i)]) if sp.is_byte(i) else " ⁇ ".encode() if i == self.unknown else self.pieces[i].replace(BLANK, " ").encode() for i in range(n)]
        self.known: dict[str, bytes] = {}
        self.follows: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the merge rules make of a text: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, last: int, piece: int) -> bool:
        """Whether merging the characters of both pieces gives the two; last is -1 at the start of a run."""
        ok = self.follows.get((last, piece))
        if ok is None:
            two = [self.pieces[piece]] if last < 0 else [self.pieces[last], self.pieces[piece]]
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            ok = self.follows[last, piece] = self.merged("".join(two)) == two
        return ok

    def _run_bpe(self, text: str) -> list[int]:
        """Ids of a run of characters that all occur in pieces."""
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        reached = [True] + [False] * n
        for end, (piece, length) in self.automaton.iter(text):
            i = end + 1
            start = i - length
            if not reached[i] and reached[start] and self._may_follow(last[start], piece):
                last[i], size[i], reached[i] = piece, length, True
        out = []
        i = n
        while i:
            if not reached[i]:  # a letter that is in pieces, but is none itself
                return self._by_merging(text)
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _by_merging(self, text: str) -> list[int]:
        ids = {p: i for i, p in enumerate(self.pieces)}
        return [x for part in self.merged(text) for x in ([ids[part]] if part in self.scores else self._fallback(part))]

    def _run_unigram(self, text: str) -> list[int]:
        n = len(text)
        worst, score_of, unknown_score = np.float32(-np.inf), self.single, np.float32(self.unknown_score)
        best = [np.float32(0.0)] + [worst] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        by_end: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            by_end[end].append(found)
        for i in range(1, n + 1):
            single = False
            for piece, length in by_end[i - 1]:
                score = best[i - length] + score_of[piece]
                single |= length == 1
                if score > best[i]:
                    best[i], back[i] = score, (piece, length)
            if not single and best[i - 1] + unknown_score > best[i]:
                best[i], back[i] = best[i - 1] + unknown_score, (-1, 1)
        parts = []
        i = n
        while i:
            piece, length = back[i]
            parts.append((piece, text[i - length : i]))
            i -= length
        return [x for piece, part in reversed(parts) for x in ([piece] if piece >= 0 else self._fallback(part))]

    def _fallback(self, part: str) -> list[int]:
        return [self.byte_ids[b] for b in part.encode()] if self.byte_ids else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        if not self.bpe:
            return self._run_unigram(word)
        out: list[int] = []
        start = 0
        for i, c in enumerate(word):
            if c not in self.letters:
                out += self._run_bpe(word[start:i]) if i > start else []
                out += self._fallback(c)
                start = i + 1
        return out + (self._run_bpe(word[start:]) if start < len(word) else [])

    def _words(self, text: str) -> list[str]:
        if self.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return []
        text = (" " if self.prefix else "") + text
        if not self.by_word:
            return [text.replace(" ", BLANK)]
        if "  " in text or BLANK in text or "\x00" in text:
            return re.findall(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+", text.replace(" ", BLANK))
        return text.replace(" ", "\x00" + BLANK).replace("\n", "\x00\n\x00").split("\x00")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes."""
        cut = [self._words(t) for t in texts]
        if not self.by_word:
            whole = [np.array(self.encode_word(w[0]), "<u4").tobytes() if w else b"" for w in cut]
            return whole if self.byte_ids else [self._one_unknown(ids) for ids in whole]
        new = {w for words in cut for w in words}
        if len(self.known) + len(new) > REMEMBER:
            self.known = {w: i for w, i in self.known.items() if w in new}
        for w in new.difference(self.known):
            self.known[w] = np.array(self.encode_word(w), "<u4").tobytes()
        look = self.known.__getitem__
        joined = [b"".join(map(look, words)) for words in cut]
        return joined if self.byte_ids else [self._one_unknown(ids) for ids in joined]

    def _one_unknown(self, ids: bytes) -> bytes:
        """Neighbouring unknown characters are one unknown piece, across words too."""
        one = np.array([self.unknown], "<u4").tobytes()
        if one + one not in ids:
            return ids
        found = np.frombuffer(ids, "<u4")
        again = (found[1:] == self.unknown) & (found[:-1] == self.unknown)
        return found[np.concatenate(([True], ~again))].tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8 (as bytes: ids from elsewhere need not be whole characters)."""
        out = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out[1:] if self.prefix and out[:1] == b" " else out


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_ids, ids_crc32, decoded_sha256, round_trip (decoding gives the text back), and the ids if asked for.

    Defined results: a null text counts as empty and has no ids; very long texts are encoded whole; repeated rows alike; an
    empty table gives an empty result; other columns are ignored.
    """
    tune(docs.sparkSession)
    names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, part in small_batches(texts):
                ids = m.encode(part)
                back = [m.decode(i) for i in ids]
                columns = [
                    pa.array(doc_ids[first : first + len(part)], pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([b == t.encode() for b, t in zip(back, part, strict=True)]),
                ]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if keep_ids else "")
    return docs.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            texts = [m.decode(np.array(i or [], "<u4").tobytes()).decode(errors="replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
