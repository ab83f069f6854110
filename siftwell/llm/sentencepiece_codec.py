"""Exact SentencePiece (BPE, byte fallback) encoding by backtracking, and decoding.

A text is cut at spaces and line ends, where no piece of the vocabulary can cross, so that a word is
encoded once and remembered. Within a word an Aho-Corasick automaton gives the longest piece at every
position. The encoder walks left to right: a piece is taken if the position behind it isn't marked in
the bitfield of failed positions and if merging it anew with the piece before it would leave the two
apart; else the next shorter piece is tried, and with none left the position is marked as failed and
the piece before it is taken back. A sequence whose neighbours all pass is the merge order's own result.

Runs of spaces have pieces that all share one score, so their merges go by position; they come last and
are computed by merging (a run's pieces repeat, so this costs nothing for long ones). Characters outside
the vocabulary become byte pieces.

Null or empty text gives the begin and end ids alone, and decodes to empty text. Very long texts and very long words are encoded whole,
in time linear in their length. Repeated rows each have their own, equal result; so have repeated and null ids. Pieces of
equal score (ties) are taken as the library takes them, the leftmost first. An empty table gives an empty result. Further
columns of docs, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready, text_of

SPACE = "▁"
#: Words remembered per generation and task; two generations are held.
REMEMBERED = 1 << 19
#: Longer words are encoded each time they occur.
LONGEST_REMEMBERED = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder for one model; not thread-safe (it remembers words)."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = [0] * 256
        self.kind, self.pieces, scores = [""] * size, [""] * size, {}
        ids: dict[str, int] = {}
        for i in range(size):
            self.pieces[i] = piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)], self.kind[i] = i, "byte"
            elif sp.is_control(i) or sp.is_unknown(i):
                self.kind[i] = "control"
            else:
                ids[piece], scores[piece] = i, sp.get_score(i)
        self.ids = ids
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece crosses a word's start; this codec needs pieces that begin with the space")
        order = sorted(scores, key=lambda p: -scores[p])
        self.rank = {p: n for n, p in enumerate(order) if len(p) > 1 and p.strip(SPACE)}
        self.single = {p for p in ids if len(p) == 1}
        self.newline_splits = "\n" not in self.single and not any("\n" in p for p in ids)
        self.runs = {p for p in ids if not p.strip(SPACE)} | {SPACE}
        self._build()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.run_bytes: dict[int, bytes] = {}
        self.plain = [b"" if self.kind[i] == "control" else p.replace(SPACE, " ").encode() if self.kind[i] != "byte" else bytes([int(p[1:-1], 16)]) for i, p in enumerate(self.pieces)]
        self.id_bytes = {p: i.to_bytes(4, "little") for p, i in ids.items()}
        self.byte_bytes = [i.to_bytes(4, "little") for i in self.byte_ids]
        self.bare = np.array([ids.get(SPACE, self.unknown)], "<u4").tobytes()

    def _build(self) -> None:
        """Each piece's last merge, the pieces that merging reaches, and the automaton over them."""
        self.split: dict[str, tuple[str, str]] = {}
        for piece in sorted(self.rank, key=len):
            last = self._merge(piece)
            if last is not None:
                self.split[piece] = last
        reached = self.single | self.split.keys()
        self.shorter: dict[str, str | None] = {}
        for piece in reached:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in reached), None)
        #: Pieces that grew out of a merge of lower priority than their own; times of merges don't follow ranks there.
        self.irregular = {p for p, (a, b) in self.split.items() if self.rank.get(a, -1) > self.rank[p] or self.rank.get(b, -1) > self.rank[p]}
        for piece in sorted(self.split, key=len):
            if self.irregular.intersection(self.split[piece]):
                self.irregular.add(piece)
        self.automaton = ahocorasick.Automaton()
        for piece in reached:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def _merge(self, text: str) -> tuple[str, str] | None:
        """The last two parts that merging leaves for text before they become one; None if they never do."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def _merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            ranks = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not ranks:
                return parts
            _, at = min(ranks)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging left + right anew ends in these two pieces.

        The right edge of left and the left edge of right shrink back through their merges; a pair of edges
        that stand side by side at some time and could merge before either is used up puts the two together.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        if left in self.irregular or right in self.irregular:
            answer = self._merged(left + right) == [left, right]
        else:
            rank, split, never = self.rank, self.split, 1 << 60
            a, b, used_a, used_b, answer = left, right, never, never, True
            while True:
                r = rank.get(a + b)
                # Of equal merges the leftmost goes first: a's own merge lies left of this one, b's right of it.
                if r is not None and r < used_a and r <= used_b:
                    answer = False
                    break
                made_a, made_b = rank.get(a, -1), rank.get(b, -1)
                if made_a < 0 and made_b < 0:
                    break
                if made_a > made_b or made_a == made_b and a in split:
                    used_a, a = made_a, split[a][1]
                else:
                    used_b, b = made_b, split[b][0]
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        self.pairs[left, right] = answer
        return answer

    def _backtrack(self, text: str) -> list[str]:
        """The pieces of text, all of whose characters are in the vocabulary."""
        if text in self.shorter:
            return [text]
        longest: list[str] = [""] * (len(text) + 1)
        for stop, piece in self.automaton.iter(text):
            longest[stop - len(piece) + 1] = piece  # a longer one ends later and so comes later
        failed, out, at, end, last = 0, [], 0, len(text), ""
        known, shorter = self.pairs, self.shorter
        piece: str | None = longest[0]
        while at < end:
            while piece:
                if not failed >> (at + len(piece)) & 1:
                    if not out:
                        break
                    fits = known.get((last, piece))
                    if self.apart(last, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                at += len(piece)
                last = piece
                piece = longest[at]
            else:
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
        return out

    def _word(self, word: str) -> bytes:
        """The ids of a piece of text without inner spaces, as little-endian 32-bit integers."""
        one, single = self.id_bytes, self.single
        if single.issuperset(word):
            return b"".join([one[p] for p in self._long(word)])
        out, start = [], 0
        for i, ch in enumerate(word):
            if ch not in single:
                if start < i:
                    out += [one[p] for p in self._long(word[start:i])]
                out += [self.byte_bytes[b] for b in ch.encode()]
                start = i + 1
        if start < len(word):
            out += [one[p] for p in self._long(word[start:])]
        return b"".join(out)

    def _long(self, text: str) -> list[str]:
        """Backtracking over parts that no merge can cross, so that bitfields stay short in endless words."""
        if len(text) <= 512:
            return self._backtrack(text)
        cuts = [0]
        for i in range(1, len(text)):
            if i - cuts[-1] >= 256 and not self._crossed(text[i - 1], text[i]):
                cuts.append(i)
        return [p for a, b in zip(cuts, [*cuts[1:], len(text)]) for p in self._backtrack(text[a:b])]

    def _crossed(self, left: str, right: str) -> bool:
        if not hasattr(self, "inner"):
            self.inner = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        return (left, right) in self.inner

    def _spaces(self, n: int) -> bytes:
        """The ids of a run of n spaces. Merges of one score go from left to right."""
        if n not in self.run_bytes:
            out: list[int] = []
            longest = max(map(len, self.runs))
            whole, rest = divmod(n, longest)
            parts = [SPACE] * rest
            grown = True
            while grown:
                grown = False
                for i in range(len(parts) - 1):
                    if parts[i] + parts[i + 1] in self.runs:
                        parts[i : i + 2] = [parts[i] + parts[i + 1]]
                        grown = True
                        break
            out = [self.ids.get(SPACE * longest, self.unknown)] * whole + [self.ids.get(p, self.unknown) for p in parts]
            if n > 256:
                return np.array(out, "<u4").tobytes()
            self.run_bytes[n] = np.array(out, "<u4").tobytes()
        return self.run_bytes[n]

    def _recall(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._word(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        """The ids of text between the begin and the end id, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [np.array([self.begin], "<u4").tobytes()]
        if text:
            lines = text.replace(SPACE, " ").split("\n") if self.newline_splits else [text.replace(SPACE, " ")]
            lines[0] = " " + lines[0]
            newline = np.array([self.byte_ids[10]], "<u4").tobytes()
            get, bare = self.young.get, self.bare
            for n, line in enumerate(lines):
                if n:
                    out.append(newline)
                first, *words = line.split(" ")
                if first:
                    out.append(get(first) or self._recall(first))
                spaces = 0
                for word in words:
                    if not word:
                        spaces += 1
                        continue
                    word = SPACE + word
                    ids = get(word) or self._recall(word)
                    if self.young.get is not get:
                        get = self.young.get
                    if spaces:
                        if ids[:4] == bare:
                            out.append(self._spaces(spaces + 1))
                            ids = ids[4:]
                        else:
                            out.append(self._spaces(spaces))
                        spaces = 0
                    out.append(ids)
                if spaces:
                    out.append(self._spaces(spaces))
        out.append(np.array([self.end], "<u4").tobytes())
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces vanish, the space put before the text goes, broken bytes become U+FFFD."""
        plain = b"".join(map(self.plain.__getitem__, ids))
        if plain[:1] == b" " and self._opens_with_space(ids):
            plain = plain[1:]
        return _lenient(plain)

    def _opens_with_space(self, ids: list[int]) -> bool:
        first = next((i for i in ids if self.kind[i] != "control"), None)
        return first is not None and self.kind[first] == ""


def _lenient(raw: bytes) -> str:
    """UTF-8 with each byte that isn't part of a character as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as e:
                out += [raw[at : at + e.start].decode(), "�"]
                at += e.start + 1
        return "".join(out)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids): a row per row of docs, with the begin and the end id. model: the path, read by the driver alone."""
    return _run(docs, id_col, text_col, model, False)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, text) from arrays of ids; a null array is an empty text."""
    ready(encoded.sparkSession)
    proto = encoded.sparkSession.sparkContext.broadcast(Path(model or default_model()).read_bytes())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(proto.value)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(batches, "doc_id long, text string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, then decoded from its ids."""
    return _run(docs, id_col, text_col, model, True)


def _run(docs: DataFrame, id_col: str, text_col: str, model: str | None, digests: bool) -> DataFrame:
    ready(docs.sparkSession)
    proto = docs.sparkSession.sparkContext.broadcast(Path(model or default_model()).read_bytes())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(proto.value)
        for part in parts:
            rows = [codec.encode_bytes(t) for t in part.column(1).to_pylist()]
            if digests:
                counts = pa.array([len(r) // 4 for r in rows], pa.int64())
                of_ids = [hashlib.sha256(r).hexdigest() for r in rows]
                of_text = [hashlib.sha256(codec.decode(np.frombuffer(r, "<u4").tolist()).encode()).hexdigest() for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                flat = pa.array(np.frombuffer(b"".join(rows), "<i4"))
                ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(batches, schema)
