"""Token ids of whole texts, with a bounded memory of word units.

A byte-level BPE vocabulary of this kind never merges across a single white
space between two other characters: such a space opens the next unit and a
line feed is a unit of its own.  So a text is the concatenation of its units,
and units seen before need not be encoded again.  Texts with white space at an
end or side by side go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: White space at an end of a unit (but for its line feed) or side by side.
_ODD = re.compile(r".\s\s|.\s$|^[^\n\S]|^\n\s|^\n?$", re.S)
#: Latin letters, then marks: the vocabulary cuts between the two.
_PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,!?;:#*$%&|]*)")
_OPENERS = ("Ġ", "Ċ")  # how the vocabulary writes space and line feed
#: The vocabulary's letter for each byte: visible ones stand for themselves, the
#: others follow from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_VISIBLE)))}


class UnitEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, max_units: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.line_feed = np.array([vocab["Ċ"]], "<u4").tobytes()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for token, i in vocab.items() if token.startswith(_OPENERS)]] = True
        self.max_units = max_units
        self.known = _Known({"": None})
        self.raw = [np.array([i], "<u4").tobytes() for i in range(len(self.opens))]
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word(self, lead: str, word: str) -> bytes:
        """One word, which the vocabulary never divides before merging."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        tokens = self.tokenizer.model.tokenize(letters if lead else "Ġ" + letters)
        return (self.line_feed if lead else b"") + b"".join([self.raw[t.id] for t in tokens])

    def _learn(self, units: list[str]) -> dict[str, bytes | None]:
        """Ids of units; None where a unit depends on its neighbours."""
        out: dict[str, bytes | None] = {}
        rest = []
        for unit in units:
            if unit.isascii() and unit.isalpha():
                out[unit] = self._word("", unit)
                continue
            plain = _PLAIN.fullmatch(unit)
            if not plain:
                rest.append(unit)
                continue
            lead, word, marks = plain.groups()
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                    self.marks[""] = b""
                self.marks[marks] = self._whole(marks).tobytes()
            stem = lead + word
            ids = self.known.get(stem) or out.get(stem)
            if ids is None:
                ids = out[stem] = self._word(lead, word)
            if marks:
                out[unit] = ids + self.marks[marks]
        odd = [u for u in rest if _ODD.search(u)]
        if odd:
            out |= dict.fromkeys(odd)
            rest = [u for u in rest if u not in out]
        if rest:  # all in one text, cut where a unit opens
            ids = self._whole("".join(u if u[0] == "\n" else " " + u for u in rest))
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(rest):
                raw, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
                out |= {u: raw[a:b] for u, a, b in zip(rest, ends, ends[1:])}
            else:
                out |= {u: self._whole(u if u[0] == "\n" else " " + u).tobytes() for u in rest}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        known.missed = set()
        # a text's first unit has no white space before it: it is learnt after a line feed
        split = [("\n" + t).replace("\n", " \n")[1:].split(" ") if t else [] for t in texts]
        parts = [list(map(known.__getitem__, units)) for units in split]
        found = self._learn(list(known.missed)) if known.missed else {}
        out = []
        for text, units, ids in zip(texts, split, parts):
            i = -1
            for _ in range(ids.count(_NEW)):
                i = ids.index(_NEW, i + 1)
                ids[i] = found[units[i]]
            try:
                out.append(b"".join(ids)[4:])
            except TypeError:  # a unit that depends on its neighbours
                out.append(self._whole(text).tobytes())
        if len(known) + len(found) <= self.max_units:
            known.update(found)  # full: what came first, thus the frequent units, stays
        return out


#: Stands for the ids of a unit that is not known yet.
_NEW = object()


class _Known(dict):
    """Ids of known units; units that are not there are noted in ``missed``."""

    missed: set[str]

    def __missing__(self, key: str) -> object:
        self.missed.add(key)
        return _NEW


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder a Python worker; workers serve many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    """Where the public 50k byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
