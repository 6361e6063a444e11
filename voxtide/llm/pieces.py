"""Chunks of text that no piece of a byte-fallback vocabulary crosses.

In such vocabularies a blank is written as the mark U+2581, which pieces hold only at their
beginning, so a text can be cut before each run of blanks; line ends are in no piece at all. Chunks
repeat a lot and are worked on once per batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MARK = "▁"
_MARK_BYTES = MARK.encode()


def chunks(text: bytes) -> list[bytes]:
    """The chunks of a text, written so that the usual ones are plain words.

    A chunk stands for a mark and then itself, with blanks for further marks; one that begins with a
    line end has no mark. The vocabulary's leading blank is included. An empty text has no chunk.
    """
    if not text:
        return []
    text = text.replace(_MARK_BYTES, b" ").replace(b"\n", b" \n")
    parts = text.split(b" ")
    # " \n" was put in; a blank that stood there already shows as an empty part before it
    if b"" not in parts:
        return parts
    out, blanks = [], 0
    for at, part in enumerate(parts):
        if part.startswith(b"\n"):
            if blanks:
                out.append(b" " * (blanks - 1))
            out.append(part)
            blanks = 0
        elif part:
            out.append(b" " * blanks + part)
            blanks = 0
        else:
            blanks += 1
    if blanks:
        out.append(b" " * (blanks - 1))
    return out


def symbols(chunk: bytes) -> str:
    """The characters a chunk stands for."""
    text = chunk.decode("utf-8", "replace")
    return text if text.startswith("\n") else MARK + text.replace(" ", MARK)


@dataclass
class Vocabulary:
    """Pieces with ids and scores; characters without a piece are spelled in bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    first_byte: int  # id of the piece of byte 0
    names: list[str]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in range(n)]
        bytes_ = [i for i in range(n) if model.is_byte(i)]
        if len(bytes_) != 256 or bytes_ != list(range(bytes_[0], bytes_[0] + 256)):
            raise ValueError("the vocabulary needs pieces for all 256 bytes, in order")
        for i in plain:
            if MARK in names[i].lstrip(MARK) or "\n" in names[i]:
                raise ValueError(f"piece {names[i]!r} crosses chunks")
        probe = [model.encode(t, out_type=str) for t in (" ", "a   ﬁ ", "\t")]
        if "".join(probe[0]) != MARK * 2 or re.search(r"ﬁ", "".join(probe[1])) is None:
            raise ValueError("the vocabulary must keep texts as they are, with a leading blank")
        return cls({names[i]: i for i in plain}, {names[i]: model.get_score(i) for i in plain}, bytes_[0], names)
