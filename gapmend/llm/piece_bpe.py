"""Exact encoding and decoding with a SentencePiece merge model, by backtracking.

A merge model joins, again and again, the two neighbouring symbols whose joint piece has the highest
score (the leftmost of equals). Its result is the only sequence of pieces in which every two neighbours are
compatible: merging their joint text again gives just these two. So a text is encoded from left to right
with the longest piece at each position, found by an Aho-Corasick automaton; a piece that is not compatible
with the one before it is exchanged for the next shorter one; where none is left, the position is marked as
failed in a bitfield and the last piece is taken back. No position is tried again after it failed, so the
work grows with the length of the text.

Two letters that stand side by side in no piece can never be merged across, so texts are cut there, before
blanks above all, and the encoded parts are remembered by each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapmend.llm.common import worker_cache

#: Mark of a blank inside pieces.
BLANK = "▁"
#: Words, parts of words and pairs of pieces remembered by a worker; later ones are worked out anew.
MEMO_WORDS, MEMO_PARTS, MEMO_PAIRS = 750_000, 250_000, 400_000
#: Documents handed on together.
TOGETHER = 200

ENCODED = "ids binary, n_tokens bigint"


def _proto(model_file: str):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=model_file).serialized_model_proto())
    return proto


class Surfaces:
    """What each id of a model file stands for when decoded."""

    def __init__(self, model_file: str):
        import codecs

        codecs.register_error("gapmend_each_byte", lambda e: ("\ufffd", e.start + 1))
        proto = _proto(model_file)
        kind = proto.pieces[0].Type
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.of = [b"" if p.type == kind.CONTROL else proto.trainer_spec.unk_surface.encode() if p.type == kind.UNKNOWN
                   else bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(BLANK, " ").encode() for p in proto.pieces]
        self.control = frozenset(i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL)
        self.blank_first = frozenset(i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL and p.piece[:1] == BLANK)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become blanks, the blank put before a text goes, byte pieces become letters (one
        U+FFFD for each byte that belongs to none), begin and end ids vanish."""
        raw = b"".join(map(self.of.__getitem__, ids))
        if self.prefix and next((i for i in ids if i not in self.control), None) in self.blank_first:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "gapmend_each_byte")


class MergeModel:
    """The pieces of a model file and the search over them."""

    def __init__(self, model_file: str):
        import ahocorasick

        proto = _proto(model_file)
        norm, kind = proto.normalizer_spec, proto.pieces[0].Type
        if (proto.trainer_spec.model_type != proto.trainer_spec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix
                or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces)):
            raise ValueError("only merge models without normalisation, user-defined and unused pieces are encoded")
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.bos, self.eos, self.unk = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id, proto.trainer_spec.unk_id
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.score = {p: proto.pieces[i].score for p, i in normal.items()}
        self.bigrams = {p[k:k + 2] for p in normal for k in range(len(p) - 1)}
        self.cut_blanks = not any(b[1] == BLANK != b[0] for b in self.bigrams)
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.byte_ids = byte if len(byte) == 256 else None
        # only pieces that merging their own text gives back can ever stand in a result
        self.ids = {p: np.array([i], "<u4").tobytes() for p, i in normal.items() if self._merges_whole(p)}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) for p in self.ids}
        self.search = ahocorasick.Automaton()
        for p in self.ids:  # a single letter needs no search
            if len(p) > 1:
                self.search.add_word(p, p)
        self.search.make_automaton()
        self.words, self.parts, self.pairs = {}, {}, {}

    def _merge(self, symbols: list[str], border: int) -> list[str] | None:
        """Merge until nothing fits; None as soon as a merge would span the ``border`` (a number of letters)."""
        score = self.score
        best = [score.get(a + b) for a, b in zip(symbols, symbols[1:])]
        while True:
            top, at = None, -1
            for k, s in enumerate(best):
                if s is not None and (top is None or s > top):
                    top, at = s, k
            if at < 0:
                return symbols
            start = sum(map(len, symbols[:at])) if border else 0
            if border and start < border < start + len(symbols[at]) + len(symbols[at + 1]):
                return None
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del best[at]
            if at > 0:
                best[at - 1] = score.get(symbols[at - 1] + symbols[at])
            if at < len(best):
                best[at] = score.get(symbols[at] + symbols[at + 1])

    def _merges_whole(self, piece: str) -> bool:
        return len(self._merge(list(piece), 0)) == 1

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the letters of two pieces again leaves their border in place."""
        known = a[-1] + b[0] not in self.bigrams or self._merge(list(a + b), len(a)) is not None
        if len(self.pairs) < MEMO_PAIRS:
            self.pairs[a, b] = known
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose blanks are marks already; an unknown letter is a piece of its own."""
        n = len(text)
        if not n:
            return []
        longest = list(text)
        for end, piece in self.search.iter(text):  # ends ascend, so the longest piece of a start comes last
            longest[end + 1 - len(piece)] = piece
        failed = bytearray(n + 1)
        pairs, shorter = self.pairs, self.shorter
        piece = last = longest[0]
        out, at = [piece], len(piece)
        while at < n:
            piece = longest[at]
            while True:
                if not failed[at + len(piece)]:
                    fits = not out or pairs.get((last, piece))
                    if fits or fits is None and self.compatible(last, piece):
                        break
                piece = shorter.get(piece)
                while piece is None:  # nothing goes on from here: take the last piece back
                    failed[at] = 1
                    out.pop()
                    at -= len(last)
                    piece = shorter.get(last)
                    last = out[-1] if out else ""
            out.append(piece)
            at += len(piece)
            last = piece
        return out

    def _piece_ids(self, piece: str) -> bytes:
        found = self.ids.get(piece)
        if found is None:
            raw = [self.unk] if self.byte_ids is None else [self.byte_ids[b] for b in piece.encode("utf-8")]
            found = np.array(raw, "<u4").tobytes()
        return found

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = b"".join(map(self._piece_ids, self.pieces(part)))
            if len(self.parts) < MEMO_PARTS:
                self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a stretch of text, cut where two letters stand side by side in no piece."""
        whole = self.ids.get(word)
        if whole is not None:
            return whole
        pairs = list(map(str.__add__, word, word[1:]))
        if self.bigrams.issuperset(pairs):
            return self._part(word)
        cuts = [k for k, p in enumerate(pairs, 1) if p not in self.bigrams]
        return b"".join([self._part(word[i:j]) for i, j in zip([0, *cuts], [*cuts, len(word)])])

    def encode(self, text: str) -> bytes:
        """The ids of a text, without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        marked = self.prefix + text.replace(" ", BLANK)
        if not self.cut_blanks:
            return self._word(marked)
        words = self.words
        if marked[0] == BLANK and BLANK * 2 not in marked:
            cut = marked.split(BLANK)[1:]
        else:
            cut = re.findall(f"^[^{BLANK}]+|{BLANK}+[^{BLANK}]*", marked)
            if cut[0][0] != BLANK:
                return self._word(cut[0]) + b"".join([self._known(w[1:]) for w in cut[1:]])
            cut = [w[1:] for w in cut]
        got = list(map(words.get, cut))
        if None in got:
            got = [self._known(w) if g is None else g for w, g in zip(cut, got)]
        return b"".join(got)

    def _known(self, word: str) -> bytes:
        """Ids of a stretch behind its first blank mark."""
        got = self.words.get(word)
        if got is None:
            got = self._word(BLANK + word)
            if len(self.words) < MEMO_WORDS:
                self.words[word] = got
        return got


def _loaded(kind, model_file: str):
    cache = worker_cache(f"{kind.__name__}:{model_file}")
    if "model" not in cache:
        cache["model"] = kind(model_file)
    return cache["model"]


def encode(docs: DataFrame, model_file: str, add_bos: bool = True, add_eos: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens) of every row: the ids of its whole text as little-endian unsigned 32-bit integers.

    A null or empty text has the begin and end ids only; long texts are encoded whole; repeated rows and null ids are
    rows like others; other columns of ``docs`` are not read; an empty table gives no rows. ``model_file`` must be
    readable where tasks run. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(MergeModel, model_file)
        head = np.array([m.bos] if add_bos else [], "<u4").tobytes()
        tail = np.array([m.eos] if add_eos else [], "<u4").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                part = b.slice(i, TOGETHER)
                got = [head + m.encode(t or "") + tail for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary()), pa.array([len(g) // 4 for g in got], pa.int64())],
                                                 names=["key", "ids", "n_tokens"])

    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {ENCODED}").withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of encode() with ``text``, decoded from ``ids``; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(Surfaces, model_file)
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                part = b.slice(i, TOGETHER)
                texts = [m.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(texts, pa.string())],
                                                 names=["key", "ids", "n_tokens", "text"])

    rows = encoded.select(encoded[id_col].alias("key"), "ids", "n_tokens")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {ENCODED}, text string").withColumnRenamed("key", id_col)
