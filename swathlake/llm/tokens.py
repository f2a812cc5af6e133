"""Token ids of texts by the tokenizers library, with a bounded cache of pieces."""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept by a task, and the longest of them.
MOST_PIECES, LONGEST = 1_000_000, 40
END_ID = 0

_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
#: Texts of these characters only are cut here; any other goes to the library whole.
_plain = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*\Z")
#: Byte-level pieces: contractions, letters, digits, other marks, blanks.
_piece = re.compile(rf" ?[{_L}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _byte_characters() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces as bytes, learnt when first asked for."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.long = model.tokenize, []

    def __missing__(self, w: str) -> bytes:
        if w.isascii() and (bare := w.removeprefix(" ")).isalnum():
            mapped = w if len(bare) == len(w) else "Ġ" + bare
        else:
            mapped = w.encode().decode("latin-1").translate(_byte_characters())
        out = self[w] = array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
        if len(w) > LONGEST:
            self.long.append(w)
        return out

    def trim(self) -> None:
        for w in self.long:
            del self[w]
        self.long.clear()
        if len(self) > MOST_PIECES:
            self.clear()


class Encoder:
    """encode(texts) gives what the library's encode(text, add_special_tokens=False) gives for each, as one array with offsets."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.pieces, self.size = _Pieces(self.library.model), self.library.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        out, of = [], self.pieces.__getitem__
        for t in texts:
            if not t:
                out.append(b"")
            elif _plain.match(t):
                out.append(b"".join(map(of, _piece.findall(t))))
            else:
                out.append(array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes())
        self.pieces.trim()
        return np.frombuffer(b"".join(out), np.uint32), np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each text's."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    at = np.ones(len(out), bool)
    at[offsets[1:] + np.arange(n)] = False
    out[at] = ids
    return out, offsets + np.arange(n + 1)
