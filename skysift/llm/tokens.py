"""Whole texts to token ids with a public tokenizer file, as little-endian 32-bit ids.

The two vocabularies used here never let a token cross the start of a blank that a visible character
follows, so a text may be cut there and its pieces encoded apart. Pieces recur: those of a batch of texts are
told apart by Arrow, each worker encodes a distinct piece once and remembers its bytes (at most CACHE_PIECES of
them, the older half being dropped when they are full), and Arrow lays the ids of the pieces side by side. A
text that holds white space or format characters for which this does not hold, or the string of a special
token, is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered pieces of one worker process.
CACHE_PIECES = 600_000
#: Control, format and unusual white-space characters, and blanks before white space (for Arrow's regular expressions): such texts are encoded whole.
UNUSUAL = (
    r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{300}-\x{36f}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{fe00}-\x{fe0f}\x{feff}]"
    r"|\x20[\x20\n]"
)
#: A word with a sign or line break after it, and perhaps another word: its runs are tokens of their own, whichever of the two vocabularies cuts them.
COMPOUND = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*\n?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?]*)")
#: Bytes of text that are told apart together, and pieces that are encoded in one row.
BATCH_BYTES, ROW_PIECES = 8 << 20, 50


class PieceEncoder:
    """encode(texts) gives each text's ids as bytes, encode_column those of all texts side by side; null counts as empty.

    The string of a special token in a text becomes that token, as the library does by default; with
    ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer
        from tokenizers.processors import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        names = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([UNUSUAL, *map(re.escape, names)])
        #: Whether a blank belongs to the token after it; else blanks leave no token.
        self.blanks = bool(self.tokenizer.encode(" ", add_special_tokens=False).ids)
        if self.blanks:
            self.tokenizer.post_processor = ByteLevel(trim_offsets=False)  # offsets then hold the blank, ids stay the same
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _row_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that follow a blank, encoded in rows and told apart by the token of their first character."""
        rows = [pieces[i : i + ROW_PIECES] for i in range(0, len(pieces), ROW_PIECES)]
        out: list[bytes] = []
        for row, e in zip(rows, self.tokenizer.encode_batch([" " + " ".join(row) for row in rows], add_special_tokens=False)):
            at, cuts = 0 if self.blanks else 1, []
            for p in row:
                cuts.append(e.char_to_token(at))
                at += len(p) + 1
            if None in cuts:
                out += self._ids([" " + p for p in row])
                continue
            ids = array("I", e.ids).tobytes()
            out += [ids[4 * a : 4 * b] for a, b in zip(cuts, [*cuts[1:], len(ids) // 4])]
        return out

    def _learn(self, known: dict[str, bytes], pieces: Iterable[str], first: bool) -> None:
        missing = [p for p in pieces if p not in known]
        for i in range(0, len(missing), 50_000):
            some = missing[i : i + 50_000]
            known.update(zip(some, self._ids(some) if first else self._row_ids(some)))

    def _make_room(self) -> None:
        if len(self.first) > CACHE_PIECES // 4:
            self.first.clear()
        if len(self.later) > CACHE_PIECES // 2:
            self.older, self.later = self.later, {}

    def _first_ids(self, texts: pa.Array, whole: list[bool], pieces: list[str]) -> list[bytes]:
        """Ids of each text's first piece, or of the whole text."""
        self._learn(self.first, set(pieces), True)
        return [self._ids([texts[i].as_py()])[0] if w else self.first[p] for i, (w, p) in enumerate(zip(whole, pieces))]

    def _later_ids(self, pieces: list[str], used: list[bool]) -> list[bytes]:
        """Ids of distinct pieces that follow a blank; those that aren't used may be left empty."""
        later, older = self.later, self.older
        ids = list(map(later.get, pieces))
        missing = [i for i, x in enumerate(ids) if x is None and used[i]]
        alone: list[str] = []
        compounds: list[str] = []
        runs: list[str] = []  # four for each of them: one flat list of strings is nothing that the garbage collector walks through
        for i in missing:
            p = pieces[i]
            if p in older:
                later[p] = older[p]
            elif not p.isalpha() and (found := COMPOUND.fullmatch(p)):
                compounds.append(p)
                runs += found.groups()
            else:
                alone.append(p)
        heads = runs[::4]
        for p in set(heads):
            if p in older:
                later[p] = older[p]
        self._learn(later, set(heads).union(alone), False)
        del runs[::4]
        self._learn(self.first, set(runs), True)
        rest = list(map(self.first.__getitem__, runs))
        later.update(zip(compounds, map(b"".join, zip(map(later.__getitem__, heads), rest[::3], rest[1::3], rest[2::3]))))
        for i in missing:
            ids[i] = later[pieces[i]]
        return ids

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self._make_room()
        whole = pc.match_substring_regex(texts, self.whole)
        cut = pc.split_pattern(pc.if_else(whole, pa.scalar("", texts.type), texts), " ")
        begins = cut.offsets.to_numpy().astype(np.int64)
        found = cut.flatten().dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = found.indices.to_numpy().copy()
        firsts = self._first_ids(texts, whole.to_pylist(), [pieces[i] for i in place[begins[:-1]].tolist()])
        place[begins[:-1]] = len(pieces) + np.arange(len(texts))
        used = np.zeros(len(pieces) + len(texts), dtype=bool)
        used[place] = True
        ids = pa.array([x or b"" for x in self._later_ids(pieces, used.tolist())] + firsts, pa.large_binary()).take(pa.array(place))
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, dtype=np.int64)[begins] // 4
        return at, np.frombuffer(data or b"", dtype="<u4", count=at[-1])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(at, ids): the ids of text i are ids[at[i] : at[i + 1]]."""
        if not len(texts):
            return np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u4")
        texts = pc.fill_null(texts, "")
        batch = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(texts)]
        parts = [self._encode(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
        pa.default_memory_pool().release_unused()  # what a batch took would stay with the worker else
        if len(parts) == 1:
            return parts[0]
        counts = np.concatenate([np.diff(at) for at, _ in parts])
        return np.concatenate([[0], np.cumsum(counts)]), np.concatenate([ids for _, ids in parts])

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        at, ids = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """One encoder for each worker process and file."""
    key = path, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]
