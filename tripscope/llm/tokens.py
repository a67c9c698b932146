"""Token ids of the public tokenizers, with a bounded memory of the pieces seen."""

from __future__ import annotations

import base64
import json
import os
import unicodedata
from array import array

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Stands for the end of a word; no UTF-8 text has this byte.
_END = b"\xff"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _word_ranked(path: str):
    """Ids of one word in lower case by merging in the order of ids, for vocabularies whose last letter of a word is marked ``</w>``."""
    import tiktoken

    letters = _byte_letters()
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ranks = {}
    for piece, rank in model["vocab"].items():
        body = piece.removesuffix("</w>")
        if all(c in letters for c in body):
            ranks[bytes(letters[c] for c in body) + (_END if body != piece else b"")] = rank
    single = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return lambda word: single(word.encode() + _END)


def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder(dict):
    """Ids as packed little-endian values of ``typecode`` (``I`` or ``H``), by piece of text; no token spans two pieces.

    Texts are cut at single spaces between two other characters (``byte``), or at spaces and line breaks (``word``), where the tokenizer's
    own first split always cuts as well. Pieces are encoded once per worker and kept up to ``BOUND``. Special tokens are ordinary text.
    """

    BOUND = 1_000_000

    def __init__(self, path: str, kind: str, typecode: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.kind, self.typecode = kind, typecode
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The same vocabulary in the faster library, where there is a file of ranks beside it.
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.ranked = _ranked(ranks) if kind == "byte" and os.path.exists(ranks) else None
        self.word_ranked = _word_ranked(path) if kind == "word" else None

    def _packed(self, text: str) -> bytes:
        if self.ranked is not None:
            return array(self.typecode, self.ranked(text)).tobytes()
        return array(self.typecode, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        if len(self) >= self.BOUND:
            self.clear()
        body = piece[1:] if piece[:1] == " " else piece
        if self.kind == "byte" and (not body or body[-1].isspace() or (body is not piece and body[0].isspace())):
            value = None  # next to other white space a cut would change how the run is split
        elif body[-1:] in (".", ",") and body[:-1].isalpha():
            value = self[piece[:-1]] + self[body[-1]]
        elif self.kind == "word" and piece.isascii() and piece != (low := piece.lower()):
            value = self[low]
        elif self.kind == "word" and (word := piece.lower()).isalpha() and "\u03a3" not in piece and unicodedata.is_normalized("NFC", piece):
            value = array(self.typecode, self.word_ranked(word)).tobytes()
        else:
            value = self._packed(piece)
        self[piece] = value
        return value

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        if self.kind == "word":
            return b"".join([self[p] for p in text.replace("\n", " ").split(" ")])
        if "\0" not in text:
            try:
                return b"".join([self[p] for p in text.replace(" ", "\0 ").split("\0")])
            except TypeError:
                pass
        return self._packed(text)


_HELD: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str, typecode: str) -> Encoder:
    """The encoder of this worker."""
    key = (path, kind, typecode)
    if key not in _HELD:
        _HELD[key] = Encoder(*key)
    return _HELD[key]
