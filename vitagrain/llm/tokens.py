"""Whole texts to token ids through the tokenizers library, word by word from a cache.

A plain joint (one space between two characters that are no white space) is a
pre-token boundary in both public BPE vocabularies, and their normalisers work
character by character across it. A line feed between two such characters is one as well (a
pre-token of its own, or none where the vocabulary drops white space). So each piece
between joints is encoded by the library once per worker and the ids of a text are
joined bytes. Letters and the punctuation behind them are pre-tokens of their own.
"""

from __future__ import annotations

import os
from string import ascii_letters, punctuation

from vitagrain.llm.bpe import Generations, alphabet, chunks_of, odd_space, packed, vocabulary_path

#: Behind letters these are one pre-token; an apostrophe may begin a contraction instead.
MARKS = punctuation.replace("'", "")
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Letters below this code point are letters in every version of Unicode.
LATIN_END = "\u0250"
#: A first piece of that many characters (a whole text without spaces, it may be) is not kept.
LONG_PIECE = 200


def pieces_of(text: str) -> list[str]:
    """Pieces between plain joints: all but the first stand for a space and the piece, or begin with their line feed."""
    if "\n" in text and "\n\n" not in text and text[0] != "\n" and text[-1] != "\n" and not odd_space(text) \
            and not any(c in text for c in _BLANKS):
        return text.replace("\n", " \n").split(" ")
    return chunks_of(text)


class LibraryCodec:
    """Little-endian unsigned 32-bit ids of texts by one vocabulary file of the library."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        held = tokenizers.Tokenizer.from_file(vocabulary_path(vocabulary))
        held.no_truncation()
        held.no_padding()

        def one(text: str) -> bytes:
            return packed(held.encode_batch_fast([text], add_special_tokens=False)[0].ids)  # fast: without offsets

        space = held.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]  # what stands for the space, if it is kept
        stands_for = {b: c for c, b in alphabet().items()}
        normal = held.normalizer.normalize_str if held.normalizer else str
        model = held.model
        # letters of ASCII pass both normalisers one by one: as they are or in lower case
        latin = {ascii_letters: str, ascii_letters.lower(): str.lower}.get(normal(ascii_letters), normal)
        line_feed = one("\n")
        marks = Generations(one, 20_000)

        def piece(word: str, ahead: str, lead: str) -> bytes:
            """Ids of `ahead` (a space or nothing, `lead` in the vocabulary) and the word.

            Letters alone are one pre-token and go straight to the library's model.
            """
            if word.isalpha() and word.isascii():
                return packed([token.id for token in model.tokenize(lead + latin(word))])
            if word.isalpha() and max(word) < LATIN_END and (plain := normal(word)).isalpha():
                mapped = plain.encode().decode("latin-1").translate(stands_for)
                return packed([token.id for token in model.tokenize(lead + mapped)])
            letters = word.rstrip(MARKS)
            # (a letter whose normal form ends in a mark would join the punctuation)
            if letters != word and letters.isalpha() and (letters.isascii() or normal(letters)[-1].isalpha()):
                return (self.rest if ahead else self.heads)[letters] + marks[word[len(letters):]]
            return one(ahead + word)

        def later(word: str) -> bytes:
            return line_feed + self.heads[word[1:]] if word[:1] == "\n" else piece(word, " ", space)

        self.one = one
        self.rest = Generations(later)
        self.heads = Generations(lambda word: piece(word, "", ""), 100_000)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = pieces_of(text)
        head = self.heads[pieces[0]] if len(pieces[0]) < LONG_PIECE else self.one(pieces[0])
        return head + b"".join(map(self.rest.__getitem__, pieces[1:]))


_HELD: dict[str, LibraryCodec] = {}


def codec(vocabulary: str) -> LibraryCodec:
    """One codec for each vocabulary and Python worker."""
    if vocabulary not in _HELD:
        _HELD[vocabulary] = LibraryCodec(vocabulary)
    return _HELD[vocabulary]
