"""Token ids of whole texts by a public tokenizer whose pre-tokens never cross white space.

``word_bpe_49k`` drops white space, lower-cases and splits at it, so a text's ids are its words' ids in turn.  Texts are cut
into pre-tokens by the tokenizer's own pattern, and pre-tokens are looked up in a bounded cache; unknown ones are encoded
together, joined by blanks, and told apart by the end-of-word mark of their last token.  Words with other characters than
printable ASCII and Latin-1 letters go to the tokenizer as they are.
"""

from __future__ import annotations

import re

import numpy as np

CACHE = 1_000_000
END_ID = 1

_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \n]+")
_ODD = "\0"  # before a word that the tokenizer gets as it is; no pre-token begins with it
_JOINED = 4000  # pre-tokens encoded in one call


def _pieces(text: str | None) -> list[str]:
    if not text:
        return []
    if _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
        return _PRE.findall(text.lower())
    out = []
    for word in text.replace("\n", " ").split(" "):
        if _PLAIN.fullmatch(word) and "<|" not in word:
            out += _PRE.findall(word.lower())
        elif word:
            out.append(_ODD + word)
    return out


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.stops = np.zeros(max(vocab.values()) + 1, bool)
        for token, k in vocab.items():
            self.ends[k] = token.endswith("</w>")
            self.stops[k] = token.endswith((".</w>", "!</w>", "?</w>"))
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p[0] != _ODD]
        for p in pieces.difference(new):
            self.known[p] = self._encode(p[1:]).tobytes()
        for k in range(0, len(new), _JOINED):
            some = new[k : k + _JOINED]
            ids = self._encode(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                at, data = [0, *(4 * cuts).tolist()], ids.tobytes()
                self.known |= {p: data[a:b] for p, a, b in zip(some, at, at[1:])}
            else:
                self.known |= {p: self._encode(p).tobytes() for p in some}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = {}
        split = [_pieces(t) for t in texts]
        if missing := set().union(*split).difference(self.known):
            self._learn(missing)
        known = self.known.__getitem__
        return [b"".join(map(known, x)) for x in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
