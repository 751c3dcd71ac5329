"""SentencePiece encoding and decoding by an automaton over all pieces.

An Aho-Corasick automaton reads the text once. At each position it follows its output links to all pieces
that end there, and each relaxes the best score at that position (Viterbi). Characters that no piece covers
are written as bytes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from limnograph.llm.common import map_rows

#: Where the vocabulary of the public tokenizer lies; never copied, always a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A character written as bytes costs so much more than the worst piece.
UNKNOWN = 10.0
#: Stretches whose best pieces a Python worker remembers.
_REMEMBERED = 400_000


class Pieces:
    """A vocabulary as (piece, score) pairs; ``None`` for ids that are no text; ``byte_ids`` for the 256 bytes."""

    def __init__(self, scored: list[tuple[str, float] | None], byte_ids: list[int]):
        self._byte_ids = byte_ids
        self._text: list[bytes | None] = [None] * len(scored)
        self._automaton = ahocorasick.Automaton()
        known = [s for s in scored if s is not None and s[0]]
        self._unknown = min((s for _, s in known), default=0.0) - UNKNOWN
        taken: set[str] = set()
        for i, entry in enumerate(scored):
            if entry is None or not entry[0]:
                continue
            piece, score = entry
            self._text[i] = piece.replace(SPACE, " ").encode()
            if piece not in taken:  # of pieces given twice the first id counts
                taken.add(piece)
                self._automaton.add_word(piece, (len(piece), score, i))
        self._any = bool(taken)
        if self._any:
            self._automaton.make_automaton()
        for b, i in enumerate(byte_ids):
            self._text[i] = bytes([b])
        self._single = frozenset(p for p in taken if len(p) == 1)
        self._stretches = re.compile(_stretches(taken))
        self._memory: dict[str, bytes] = {}

    def best(self, text: str) -> array:
        """Ids of the best segmentation of marked text; of equal scores, the longest last piece wins."""
        size = len(text)
        score = [0.0] + [float("-inf")] * size
        back = [0] * (size + 1)
        used = [-1] * (size + 1)
        # A character with a piece of its own is never better off as bytes.
        bare = [] if self._single.issuperset(text) else [i for i, c in enumerate(text) if c not in self._single]
        bare.append(size)
        next_bare, at = bare[0], 0
        for end, (length, value, piece) in (self._automaton.iter(text) if self._any else ()):
            while next_bare < end:  # all pieces that end there are known
                if score[next_bare] + self._unknown > score[next_bare + 1]:
                    score[next_bare + 1], back[next_bare + 1], used[next_bare + 1] = (
                        score[next_bare] + self._unknown, next_bare, -1)
                at += 1
                next_bare = bare[at]
            end += 1
            start = end - length
            total = score[start] + value
            if total > score[end] or (total == score[end] and start < back[end]):
                score[end], back[end], used[end] = total, start, piece
        for i in bare[at:-1]:
            if score[i] + self._unknown > score[i + 1]:
                score[i + 1], back[i + 1], used[i + 1] = score[i] + self._unknown, i, -1
        out: list[int] = []
        while size:
            start = back[size]
            if used[size] >= 0:
                out.append(used[size])
            else:
                out += [self._byte_ids[b] for b in reversed(text[start:size].replace(SPACE, " ").encode())]
            size = start
        out.reverse()
        return array("i", out)

    def encode(self, text: str | None) -> array:
        """Ids of ``text`` with a space mark put before it; a mark that stands in the text itself becomes bytes."""
        out, memory = array("i"), self._memory
        if not text:
            return out
        found: list[bytes] = []
        for i, part in enumerate(text.split(SPACE)):
            if i:
                found.append(array("i", [self._byte_ids[b] for b in SPACE.encode()]).tobytes())
            marked = part.replace(" ", SPACE)
            if i == 0:
                marked = SPACE + marked
            for stretch in self._stretches.findall(marked):
                ids = memory.get(stretch)
                if ids is None:
                    ids = self.best(stretch).tobytes()
                    if len(stretch) <= 32:
                        if len(memory) >= _REMEMBERED:
                            memory.clear()
                        memory[stretch] = ids
                found.append(ids)
        out.frombytes(b"".join(found))
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text again; ids that are no text give nothing, broken bytes a replacement character."""
        data = b"".join(t for i in ids or () if 0 <= i < len(self._text) and (t := self._text[i]) is not None)
        return data.decode(errors="replace").removeprefix(" ")


def _stretches(pieces: set[str]) -> str:
    """A pattern that cuts text where no piece reaches across, so that the best segmentation of each stretch is final.

    Space marks begin a stretch if no piece has one after another character. Letters and digits end where
    others begin, but for those that some piece joins with others.
    """
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    if any(a != SPACE and b == SPACE for a, b in pairs):
        return "(?s).+"
    pairs = [(a, b) for a, b in pairs if SPACE not in (a, b)]
    joined: set[str] = set()
    while True:
        inner = lambda c: c.isalnum() and c not in joined
        more = {c for a, b in pairs if inner(a) != inner(b) for c in (a, b) if inner(c)}
        if not more:
            break
        joined |= more
    odd = re.escape("".join(sorted(joined)))
    # [^\W_] is what isalnum() accepts
    inside, outside = f"[^\\W_{odd}]", f"(?:[^\\w{SPACE}]|[_{odd}])"
    return f"{SPACE}*{inside}+|{SPACE}*{outside}+|{SPACE}+"


def read_model(path: str) -> tuple[list[tuple[str, float] | None], list[int]]:
    """Pieces and scores of a SentencePiece model file with bytes as a last resort."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    byte_ids = [i for i in range(size) if sp.is_byte(i)]
    if len(byte_ids) != 256:
        raise ValueError("the model has no pieces for the 256 bytes")
    plain = [None if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
             else (sp.id_to_piece(i), sp.get_score(i)) for i in range(size)]
    return plain, byte_ids


@lru_cache(maxsize=2)
def from_file(path: str) -> Pieces:
    return Pieces(*read_model(path))


def _shared(spark: SparkSession, model: str) -> Callable[[], Pieces]:
    """Executors need not have the model file: the driver reads it, and pieces and scores (fixed size) are broadcast.

    A worker keeps the automaton beside the broadcast value for its next tasks.
    """
    shared = spark.sparkContext.broadcast((*read_model(model), {}))

    def pieces() -> Pieces:
        scored, byte_ids, made = shared.value
        if not made:
            made["pieces"] = Pieces(scored, byte_ids)
        return made["pieces"]

    return pieces


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (the best segmentation of the whole text) and ``n_tokens``.

    A NULL text has NULL ids and 0 tokens, an empty one no ids. Rows are never left out; equal texts have
    equal ids; of equally good segmentations, that with the longest last piece is taken at each position.
    Columns named like a new one give way.
    """
    shared = _shared(docs.sparkSession, model)

    def make():
        pieces = shared()

        def run(texts):
            ids = [None if t is None else pieces.encode(t) for t in texts]
            counts = [0 if x is None else len(x) for x in ids]
            ends = accumulate(counts, initial=0)
            starts = [None if x is None else n for x, n in zip([*ids, ()], ends, strict=True)]
            flat = [np.frombuffer(x, np.int32) for x in ids if x]
            values = pa.array(np.concatenate(flat) if flat else [], pa.int32())
            return [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values), counts]

        return run

    return map_rows(docs, [text], "ids array<int>, n_tokens long", make, keep)


def decode(tokens: DataFrame, model: str = MODEL, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the text of the ids; NULL ids have a NULL text."""
    shared = _shared(tokens.sparkSession, model)

    def make():
        pieces = shared()
        return lambda rows: [[None if x is None else pieces.decode(x) for x in rows]]

    return map_rows(tokens, [ids], "decoded string", make, keep)
