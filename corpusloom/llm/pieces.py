"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over a text once. For each boundary it keeps the survivor, the
best last piece of all encodings that end there, and a back pointer. No piece
is longer than the longest of the model, so only the survivors of that many
boundaries can still be built upon. Whenever the back pointers of all of them
lead to one earlier boundary, the ids before it are final: they are committed
and forgotten. A text of any length needs a window, not a lattice.

What makes a survivor best depends on the model. In a unigram model it is the
sum of the pieces' scores. A BPE model's scores are merge ranks, and their sum
has no meaning; an encoding is right if merging would leave each two
neighbouring pieces as they are, and of the encodings that end at a boundary
exactly one has that property in every place. So there a last piece survives
if merging leaves it apart from the survivor before it. The ids equal those of
the sentencepiece library.

Where a model has no piece that goes on after the end of a word, all paths
converge between words; ids of a word then don't depend on its neighbours, and
a worker remembers them.

Defined cases: a null text has null ids; an empty text has none; characters
that the model lacks become byte pieces, or the unknown id where it has no
byte pieces; a literal U+2581 decodes to a space, as in the library; repeated
rows are encoded alike; an empty table gives an empty result; extra columns
pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh, ship
from corpusloom.llm.hashing import byte_runs

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Bytes of words, and pairs of pieces, that a worker remembers; results don't depend on it. When as many are new,
#: words that weren't met since the last time are forgotten, so that there are twice as many at most.
REMEMBER, REMEMBER_PAIRS = 45 << 20, 500_000
#: What an entry takes besides the characters of its word, some 200 bytes; words longer than LONG_WORD aren't remembered.
ENTRY, LONG_WORD = 200, 1000
#: Characters that are encoded at a time, whole texts at least.
CHUNK_CHARS = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces, scores and rules of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            message = dict(_fields(f.read()))  # the last of repeated fields is enough: pieces come from the library
        trainer, normalizer = (dict(_fields(message.get(k, b""))) for k in (2, 3))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = bool(normalizer.get(3, 1))
        self.plain = normalizer.get(1) == b"identity" and not normalizer.get(4, 1) and normalizer.get(5, 1) and not normalizer.get(2)
        self.ids, self.scores, self.bytes, self.surface = {}, {}, {}, []
        lib = self.library
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.surface.append(" ⁇ ".encode() if lib.is_unknown(i) else b"")
            else:
                self.surface.append(piece.encode())
                if not lib.is_unused(i):
                    self.ids[piece], self.scores[piece] = i, lib.get_score(i)
        self.unknown = lib.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        self.lowest = min(self.scores.values(), default=0.0)
        multi = [p for p in self.ids if len(p) > 1]
        self.by_word = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in multi)
        self.endings = {p[i:] for p in self.ids for i in range(len(p))}
        self.pairs: dict[str, dict[str, bool]] = {}  # of a piece: which pieces stay apart from it
        self.n_pairs = 0
        self.packed = {p: np.array(self.id_list(p), dtype="<u4").tobytes() for p in self.ids}

    def normalize(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return (SPACE + text if self.prefix and text else text).replace(" ", SPACE)

    def apart(self, a: str, b: str) -> bool:
        """Whether merging the characters of both leaves the two pieces as they are.

        The best-ranked pair merges first, of equal ones the leftmost; a merge across the
        border settles it.
        """
        score, parts, border = self.scores.get, [*a, *b], len(a)
        while True:
            best, at, left = None, 0, parts[0]
            for i in range(1, len(parts)):
                right = parts[i]
                s = score(left + right)
                if s is not None and (best is None or s > best):
                    best, at = s, i
                left = right
            if best is None:
                return border == 1 and len(parts) == 2
            if at == border:
                return False
            border -= at < border
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]

    def id_list(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[x] for x in piece.encode()] if self.bytes else [self.unknown]


class StreamingViterbi:
    """Takes characters, gives back ids as soon as they are final."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.text = ""  # since the last committed boundary
        self.last: list[str] = [""]  # of each boundary: the survivor's last piece
        self.after: list[dict | None] = [None]  # of a BPE model: what is known of pieces after it
        self.score: list[float] = [0.0]  # of a unigram model
        self.before = ""  # the last committed piece
        self.widest = 0

    def feed(self, text: str) -> list[int]:
        self.text += text
        out: list[int] = []
        step, width = self._bpe if self.model.kind == BPE else self._unigram, 4 * self.model.longest
        while len(self.last) <= len(self.text):
            step(min(len(self.text), max(width, len(self.last))))  # beyond the usual width if paths didn't meet
            if len(self.last) > width:
                out += self._commit(self._meet())
        return out

    def finish(self) -> list[int]:
        out = self._commit(len(self.last) - 1)
        self.before, self.after[0] = "", None
        return out

    def short(self, text: str) -> list[str]:
        """The pieces of a text that fits in the window.

        Survivors only hang on what stands before them, so those of the
        beginning that the text shares with the one before it are kept: texts in order
        are searched from where they part.
        """
        same, old = 0, self.text
        for a, b in zip(text, old, strict=False):
            if a != b:
                break
            same += 1
        self.text = text
        del self.last[same + 1 :], self.after[same + 1 :], self.score[same + 1 :]
        (self._bpe if self.model.kind == BPE else self._unigram)(len(text))
        pieces, at = [], len(text)
        while at > 0:
            pieces.append(self.last[at])
            at -= len(pieces[-1])
        pieces.reverse()
        return pieces

    def _bpe(self, to: int) -> None:
        """Survivors of the boundaries up to ``to``."""
        m, text, last, after = self.model, self.text, self.last, self.after
        ids, endings, pairs = m.ids, m.endings, m.pairs
        for end in range(len(last), to + 1):
            start = end - 1
            piece = text[start:end]
            fitting = [(start, piece)]  # what may end here, shortest first
            while start > 0:
                start -= 1
                piece = text[start:end]
                if piece not in endings:
                    break
                if piece in ids:
                    fitting.append((start, piece))
            while fitting:
                start, piece = fitting.pop()
                known = after[start]
                if known is None:
                    break
                fits = known.get(piece)
                if fits is None:
                    fits = known[piece] = m.apart(last[start] or self.before, piece)
                    m.n_pairs += 1
                if fits:
                    break
            last.append(piece)
            known = pairs.get(piece)
            if known is None:
                known = pairs[piece] = {}
            after.append(known)
        if m.n_pairs > REMEMBER_PAIRS:
            m.pairs = {}
            m.n_pairs = 0

    def _unigram(self, to: int) -> None:
        m, text, last, score = self.model, self.text, self.last, self.score
        for end in range(len(last), to + 1):
            best, found = None, ""
            for start in range(max(0, end - m.longest), end):
                piece = text[start:end]
                s = m.scores.get(piece)
                if s is None:
                    if start < end - 1:
                        continue
                    s = m.lowest - 10.0
                if best is None or score[start] + s > best:
                    best, found = score[start] + s, piece
            last.append(found)
            score.append(best)

    def _meet(self) -> int:
        """The last boundary that all survivors' back pointers lead to."""
        top = len(self.last) - 1
        self.widest = max(self.widest, top)
        open_ends = set(range(max(0, top - self.model.longest + 1), top + 1))
        while len(open_ends) > 1:
            latest = max(open_ends)
            open_ends.remove(latest)
            open_ends.add(latest - len(self.last[latest]))
        return open_ends.pop()

    def _commit(self, boundary: int) -> list[int]:
        pieces, at = [], boundary
        while at > 0:
            pieces.append(self.last[at])
            at -= len(self.last[at])
        if pieces:
            self.before = pieces[0]
        if self.model.kind == BPE:
            self.after = [self.model.pairs.setdefault(self.before, {}) if self.before else None, *self.after[boundary + 1 :]]
        self.text, self.last = self.text[boundary:], ["", *self.last[boundary + 1 :]]
        if self.model.kind == UNIGRAM:
            self.score = [s - self.score[boundary] for s in self.score[boundary:]]
        return [i for p in reversed(pieces) for i in self.model.id_list(p)]


_SPLIT = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class Encoder:
    def __init__(self, path: str, remember: int = REMEMBER):
        self.model, self.remember = PieceModel(path), remember
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _size(self, words: Iterable[str], n: int) -> int:
        return sum(map(len, words)) * 2 + n * ENTRY

    def _recall(self, words: set[str]) -> set[str]:
        """Takes over what is known of the words from the older memory; gives back those that are in neither."""
        old = words & self.older.keys()
        self.known.update({w: self.older[w] for w in old})
        self.held += self._size(old, len(old))
        return words - old

    def _stream(self, text: str) -> bytes:
        search = StreamingViterbi(self.model)
        ids: list[int] = []
        for i in range(0, len(text), 4096):
            ids += search.feed(text[i : i + 4096])
        return np.array(ids + search.finish(), dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        search, packed, known, width = StreamingViterbi(self.model), self.model.packed, self.known, 4 * self.model.longest
        for w in sorted(words):
            if len(w) > width:
                known[w] = self._stream(w)
            else:
                known[w] = b"".join([packed[p] if p in packed else np.array(self.model.id_list(p), dtype="<u4").tobytes() for p in search.short(w)])

    def _words(self, norm: str) -> list[str]:
        if not self.model.by_word:
            return [norm]
        if SPACE * 2 in norm or "\0" in norm:
            return _SPLIT.findall(norm)
        return norm.replace("\n", "\0\n\0").replace(SPACE, "\0" + SPACE).split("\0")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        split = [self._words(self.model.normalize(t)) for t in texts]
        words = set().union(*split)
        new = self._recall(words.difference(self.known))
        size = self._size(new, len(new))
        if self.held + size > self.remember:
            self.older, self.known, self.held = self.known, {"": b""}, 0
            new = self._recall(words.difference(self.known))
            size = self._size(new, len(new))
        self._learn(new)
        self.held += size
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in [w for w in words if len(w) > LONG_WORD]:
            del self.known[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        surface = self.model.surface
        data = b"".join([surface[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text, an array of int, in a new column.

    ``decoded`` names a further column for the text that the ids stand for, as
    ``decode`` gives it, made by the same worker.
    """
    ship(docs.sparkSession)
    (ids,) = fresh(docs, ids)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    if decoded:
        added.append(T.StructField(*fresh(docs.withColumn(ids, F.lit(0)), decoded), T.StringType()))
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            column = batch.column(at)
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in column.cast(pa.large_binary())]
            for a, b in byte_runs(sizes, CHUNK_CHARS):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                coded = coder.encode_all([t or "" for t in texts])
                ends = np.cumsum([0, *[len(c) // 4 for c in coded]])
                values = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
                out = [*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([t is None for t in texts]))]
                if decoded:
                    out.append(pa.array([None if t is None else coder.decode(c) for t, c in zip(texts, coded, strict=True)], pa.string()))
                yield pa.record_batch(out, names=schema.names)

    return docs.mapInArrow(work, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for, in a new column."""
    ship(rows.sparkSession)
    (text,) = fresh(rows, text)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    at = rows.columns.index(ids)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(model).decode
        for batch in batches:
            col = batch.column(at)
            values, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            good = col.is_valid().to_pylist()
            texts = [run(values[a:b].astype("<u4").tobytes()) if ok else None for a, b, ok in zip(offsets, offsets[1:], good, strict=False)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(work, schema)
